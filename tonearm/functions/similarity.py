"""Similarities of names: token overlap as an expression, the token-set ratio as a vectorised function."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ratios import pair_ratios


def overlap_score(shared: Column, a: Column, b: Column) -> Column:
    """From the sizes of an intersection and of both sets: Jaccard, or for a contained set 0.5 and half its share if that is more."""
    least, most = F.least(a, b), F.greatest(a, b)
    jaccard = shared / (a + b - shared)
    return F.when(least == 0, 0.0).when(shared == least, F.greatest(jaccard, 0.5 + least / most * 0.5)).otherwise(jaccard)


def token_similarity(a: Column, b: Column) -> Column:
    """overlap_score of two arrays of distinct tokens."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(overlap_score(F.size(F.array_intersect(a, b)), F.size(a), F.size(b)))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the rows as bits of one integer."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    mask = (1 << len(a)) - 1
    v = mask
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & mask
    return len(a) - v.bit_count()


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: the best normalised similarity among the shared words, and these with either side's rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    gap = 1 if both else 0
    n, m = len(both) + gap + len(left), len(both) + gap + len(right)
    best = 100 * (1 - (len(left) + len(right) - 2 * lcs(left, right)) / (n + m))
    if both:
        for rest, whole in ((left, n), (right, m)):
            best = max(best, 100 * (1 - (gap + len(rest)) / (len(both) + whole)))
    return best


def _ratios(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(pair_ratios(a, b))


def _ratios_of_some(a: pa.Array, b: pa.Array) -> pa.Array:
    empty = [pc.equal(pc.binary_length(x).fill_null(0), 0) for x in (a, b)]
    return pa.array(pair_ratios(a, b), mask=pc.or_(*empty).to_numpy(zero_copy_only=False))


@lru_cache(4)
def _function(f, context):
    """One function for all calls in a Spark context, so that Spark knows equal calls."""
    return F.arrow_udf(f, "double")


def token_set_ratio_udf(a: Column, b: Column) -> Column:
    """token_set_ratio by Arrow batches; null is empty. Equal calls in one select are one."""
    return _function(_ratios, SparkContext._active_spark_context)(a, b)


def token_set_ratio_of_some(a: Column, b: Column) -> Column:
    """The same, but null where a side is empty: said in the function, as a condition around it would work out both sides once more."""
    return _function(_ratios_of_some, SparkContext._active_spark_context)(a, b)


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the scores that are there, by their weights; 0 if none is."""
    total = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in parts), F.lit(0.0))
    value = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in parts), F.lit(0.0))
    return F.when(total > 0, value / F.nullif(total, F.lit(0.0))).otherwise(0.0)
