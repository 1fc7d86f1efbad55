"""Counts of a job, taken in the pass that does its work.

Defined results: rows with an error count as failed, others as written; without rows all counts are 0 and there is no error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def counted(rows: DataFrame, error: str, key: str, name: str = "job", **kinds: str) -> tuple[DataFrame, Observation]:
    """rows as they are, and an Observation that has, once they were written, processed, written, failed, the first and the last
    error by key (key, error), and for each kind how many errors fit its pattern."""
    seen = Observation(name)
    failed = F.col(error).isNotNull()
    at = F.when(failed, F.struct(F.col(key).cast("string").alias("key"), F.col(error).alias("error")))
    by_kind = [F.count_if(failed & F.col(error).rlike(pattern)).alias(kind) for kind, pattern in kinds.items()]
    return rows.observe(seen, F.count(F.lit(1)).alias("processed"), F.count_if(~failed).alias("written"), F.count_if(failed).alias("failed"), F.min(at).alias("first_error"), F.max(at).alias("last_error"), *by_kind), seen


def job_row(rows: DataFrame, seen: Observation) -> DataFrame:
    """What was counted as a table of one row; rows must have been written."""
    found = seen.get
    names = [k for k in found if not k.endswith("_error")]
    errors = [k for k in found if k.endswith("_error")]
    values = tuple(found[k] for k in names) + tuple(v for k in errors for v in (found[k] or (None, None)))
    schema = ", ".join([f"{k} long" for k in names] + [f"{k}_{part} string" for k in errors for part in ("key", "text")])
    return rows.sparkSession.createDataFrame([values], schema)
