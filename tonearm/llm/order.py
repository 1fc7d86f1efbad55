"""Places of rows in a sorted order: ranges are sorted, the rows of each group counted in each partition, and the counts' sums added.

Defined results: rows with equal keys get places one after the other, in no fixed order; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Runs of a group in a partition up to which their offsets are broadcast (some 60 bytes each); beyond, they are joined by a shuffle.
BROADCAST_RUNS = 200_000


def placed(df: DataFrame, group: str, keys: list[str], name: str) -> DataFrame:
    """df(group, keys, ...) -> its columns with `place`, from 0 in each group in order of keys, and the group's size `n`.

    Rows come sorted within partitions; a hot group is dealt over as many ranges as it needs.
    """
    source = common.stored(df.withColumn("__tie", F.monotonically_increasing_id()), name)
    ranged = source.repartitionByRange(group, *keys, "__tie").sortWithinPartitions(group, *keys, "__tie").drop("__tie")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    at = ranged.columns.index(group)
    ordered = common.stored(ranged.mapInArrow(lambda batches: _number(batches, at), f"{fields}, part int, seq long"), f"{name}-in-order")
    runs = ordered.groupBy("part", group).agg(F.count("*").alias("n_run"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = source.groupBy(group).agg(F.count("*").alias("n"))
    runs = common.stored(runs.withColumn("at", F.coalesce(F.sum("n_run").over(before), F.lit(0))).join(sizes, group).select("part", group, "at", "n"), f"{name}-runs")
    common.drop(source)
    few = runs.count() <= BROADCAST_RUNS
    out = ordered.join(F.broadcast(runs) if few else runs, ["part", group]).select(*df.columns, (F.col("at") + F.col("seq")).alias("place"), "n")
    return out if few else out.repartitionByRange(group, "place").sortWithinPartitions(group, "place")


def _number(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Each row's partition, and its place in its group's run there."""
    part, run, seq = TaskContext.get().partitionId(), object(), 0
    for batch in batches:
        places = []
        for grp in batch.column(at).to_pylist():
            seq = seq + 1 if grp == run else 0
            run = grp
            places.append(seq)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "seq"])
