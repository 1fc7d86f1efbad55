"""Pages of a table in a stored order, by offset or from a key on, without sorting the table for each.

The table is dealt to ranges of the keys once and written sorted, a folder for each range; a small table counts the rows of each
and says which keys it has. A page reads the folders that its rows are in.

Defined results: null keys come first; rows with equal keys follow one another in no fixed order unless the keys tell all rows
apart; an offset beyond the end gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_ordered(table: DataFrame, keys: list[str], path: str, ranges: int | None = None) -> None:
    """ranges: how many folders; as many as shuffle partitions if not given."""
    dealt = table.repartitionByRange(ranges, *keys) if ranges else table.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).withColumn("range", F.spark_partition_id()).write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    at = F.struct(*keys)
    counts = table.sparkSession.read.parquet(f"{path}/rows").groupBy("range").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def _ranges(spark: SparkSession, path: str) -> list:
    """One row for each folder, in order, with how many rows are before it."""
    rows, before = [], 0
    for r in spark.read.parquet(f"{path}/ranges").orderBy("range").collect():
        rows.append((r, before))
        before += r["n"]
    return rows


def _of_ranges(spark: SparkSession, path: str, wanted: list[int]) -> tuple[DataFrame, list[str]]:
    keys = spark.read.parquet(f"{path}/ranges").schema["first"].dataType.names
    rows = spark.read.parquet(f"{path}/rows")
    return rows.where(F.col("range").isin(wanted)).orderBy("range", *keys).drop("range"), keys


def page_at(spark: SparkSession, path: str, skip: int = 0, limit: int = 100) -> DataFrame:
    """Rows skip + 1 to skip + limit."""
    if skip < 0 or limit < 1:
        raise ValueError("skip must not be negative, and limit at least 1")
    hit = [(r["range"], before) for r, before in _ranges(spark, path) if before < skip + limit and before + r["n"] > skip]
    rows, _ = _of_ranges(spark, path, [k for k, _ in hit])
    return rows.offset(skip - (hit[0][1] if hit else 0)).limit(limit)


def page_after(spark: SparkSession, path: str, after: dict, limit: int = 100) -> DataFrame:
    """The first rows behind the key values of after, which names every key: the last row of the page before."""
    ranges = _ranges(spark, path)
    keys = spark.read.parquet(f"{path}/ranges").schema["first"].dataType.names
    placed = lambda values: tuple((v is not None, v) for v in values)  # noqa: E731  null first
    mark, wanted, n = placed(after[k] for k in keys), [], 0
    for r, _ in ranges:
        if not wanted and placed(r["last"]) <= mark:
            continue
        wanted.append(r["range"])
        n += r["n"] if placed(r["first"]) > mark else 0  # of the folder that the mark is in, perhaps none
        if n >= limit:
            break
    rows, _ = _of_ranges(spark, path, wanted)
    behind = F.lit(False)
    for k in reversed(keys):
        later = F.col(k).isNotNull() if after[k] is None else F.coalesce(F.col(k) > F.lit(after[k]), F.lit(False))
        behind = later | (F.col(k).eqNullSafe(F.lit(after[k])) & behind)
    return rows.where(behind).limit(limit)
