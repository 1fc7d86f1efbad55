"""Aggregates that depend on the order in which values were first seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_seen_mode(rows: DataFrame, keys: list[str], value: Column, position: Column, name: str) -> DataFrame:
    """keys and name: each group's most frequent value that isn't null; of equals the one seen first."""
    counted = rows.select(*keys, value.alias("v"), position.alias("p")).where("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("n"), F.min("p").alias("p"))
    return counted.groupBy(*keys).agg(F.max_by("v", F.struct(F.col("n"), -F.col("p"))).alias(name))


def common_prefix(low: Column, high: Column) -> Column:
    """The common prefix of all strings between low and high, in byte order."""
    n = F.least(F.length(low), F.length(high))
    lengths = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(low, F.lit(1), k) == F.substring(high, F.lit(1), k))
    return F.when(n > 0, F.substring(low, F.lit(1), F.coalesce(F.array_max(lengths), F.lit(0)))).otherwise("")


def shared_value(value: Column) -> Column:
    """The one value of a group that isn't empty, null where there are several or none."""
    v = F.when(value != "", value)
    return F.when(F.min(v) == F.max(v), F.max(v))
