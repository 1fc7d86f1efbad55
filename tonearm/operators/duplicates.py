"""Duplicates by content hash, and the space they waste."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(files: DataFrame, key: str = "fingerprint_hash") -> DataFrame:
    """Groups of two files or more: count, total size, space that keeping the largest saves."""
    return files.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_files"), F.sum("file_size").alias("total_size"), (F.sum("file_size") - F.max("file_size")).alias("wasted")).where("n_files > 1")


def group_members(files: DataFrame, key: str = "fingerprint_hash") -> DataFrame:
    """Each group's members by identifier."""
    return files.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "file_size"))).alias("members")).where(F.size("members") > 1)


def wasted_space(files: DataFrame, key: str = "fingerprint_hash") -> DataFrame:
    return duplicate_groups(files, key).agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"))


def keep_largest(files: DataFrame, key: str = "fingerprint_hash") -> DataFrame:
    """Members of duplicate groups; the largest file of a group stays, of equals the first."""
    w = Window.partitionBy(key)
    rows = files.where(F.col(key).isNotNull()).withColumns({"n": F.count("*").over(w), "rn": F.row_number().over(w.orderBy(F.desc("file_size"), "id"))}).where("n > 1")
    return rows.select("id", key, "file_size", "rn", F.when(F.col("rn") == 1, "KEEP (largest)").otherwise("duplicate").alias("action"))
