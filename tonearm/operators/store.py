"""Tables kept in folders by a hash of their key: edits rewrite the folders that they touch, and derived facets follow.

Defined results: a null key has a folder of its own; an edit of no rows writes nothing; a repeated edit gives the same table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .simjoin import ensure_checkpoint_dir

BUCKETS = 64


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors both see it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def bucket_of(key: str, buckets: int) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"), F.lit(buckets))


def write_buckets(table: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> None:
    rows = table.withColumn("bucket", bucket_of(key, buckets))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def edit_buckets(spark: SparkSession, path: str, keys: DataFrame, edit: Callable[[DataFrame], DataFrame], key: str = "id", buckets: int = BUCKETS) -> list[int]:
    """edit(rows) -> rows, over the folders of keys(key) only; gives their numbers. Folders change when all are written.

    The list of touched folders is at most `buckets` long. What edit leaves out of a folder goes; a folder that it empties is emptied.
    """
    touched = sorted(r[0] for r in keys.select(bucket_of(key, buckets)).distinct().collect())
    if not touched:
        return []
    rows = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    new = edit(rows.drop("bucket")).withColumn("bucket", bucket_of(key, buckets))
    ensure_checkpoint_dir(spark)
    new = new.repartition("bucket").checkpoint()  # what is overwritten is read no more
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    left = {r[0] for r in new.select("bucket").distinct().collect()}
    for k in set(touched) - left:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={k}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched


def _pairs(fields: tuple[str, ...]) -> str:
    """Of each field its name and the matched or own value."""
    return f"stack({len(fields)}, " + ", ".join(f"'{f}', coalesce(matched_{f}, {f})" for f in fields) + ") as (field, value)"


def facet_counts(tracks: DataFrame, *fields: str) -> DataFrame:
    """(bucket, field, value, n): all facets of a table with folders in one pass over it."""
    return tracks.select("bucket", F.expr(_pairs(fields))).where("value is not null and value <> ''").groupBy("bucket", "field", "value").agg(F.count("*").alias("n"))


def write_facets(spark: SparkSession, table: str, path: str, *fields: str, touched: list[int] | None = None) -> None:
    """The facets of the table's folders, or of those that an edit has touched; other folders' stay as they are."""
    rows = spark.read.parquet(table)
    if touched is None:
        facet_counts(rows, *fields).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    elif touched:
        schema = spark.read.parquet(path).schema
        new = facet_counts(rows.where(F.col("bucket").isin(touched)), *fields)
        # a folder that has lost all its values keeps one without a count
        none = spark.createDataFrame([(k, None, None, 0) for k in touched], "bucket int, field string, value string, n long")
        new.unionByName(none).select(*schema.names).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def stored_facets(spark: SparkSession, path: str) -> DataFrame:
    """field, value, n over all folders."""
    return spark.read.parquet(path).groupBy("field", "value").agg(F.sum("n").alias("n")).where("n > 0")


def read_versions(spark: SparkSession, path: str, columns: str, defaults: dict[int, dict[str, Column]] | None = None) -> DataFrame:
    """One table of files of several versions, in folders version=1, 2, ..., with the columns (DDL) of today.

    A column that a version lacks takes the default of the first later version that names one, else null. A column of
    another type is cast; one that today's table has no more is left out. A version's files may differ among themselves.
    """
    wanted, out = StructType.fromDDL(columns), None
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    for version in sorted(int(n.split("=")[1]) for n in names if n.startswith("version=")):
        rows = spark.read.option("mergeSchema", True).parquet(f"{path}/version={version}")
        since = [d for v, d in sorted((defaults or {}).items()) if v > version]
        new = lambda name: next((d[name] for d in since if name in d), F.lit(None))  # noqa: B023, E731
        rows = rows.select(F.lit(version).alias("version"), *((F.col(f"`{f.name}`") if f.name in rows.columns else new(f.name)).cast(f.dataType).alias(f.name) for f in wanted))
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], StructType.fromDDL(f"version int, {columns}")) if out is None else out
