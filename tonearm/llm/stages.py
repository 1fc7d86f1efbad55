"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and works on all that the stage before it kept.

All but the last return the columns of documents. Exact copies and contaminated documents go by identifier and text,
near copies by identifier, which is one document there; rows with a null identifier stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, common, decontaminate, dedup_exact, jaccard_join, toxicity

#: Identifiers of dropped documents are broadcast up to this many (8 bytes each), and joined by a shuffle beyond.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs without the rows of bad: those with its doc_id and, if it says so, with text_sha256 as the digest of their text."""
    by_text = "text_sha256" in bad.columns
    keys = [F.col("doc_id").alias("__bad_id"), *([F.col("text_sha256").alias("__bad_text")] if by_text else [])]
    bad = common.stored(bad.select(*keys).distinct(), "dropped")
    same = F.col("doc_id") == F.col("__bad_id")
    if by_text:
        same &= _digest() == F.col("__bad_text")
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad, same, "left_anti")


def _digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity model rejects go. It learns from the labels' training fold."""
    common.tune(spark)
    return toxicity.clean_documents(docs, toxicity.train(docs, common.read(spark, sf_dir, "labels")))


def drop_copies(spark, docs, sf_dir):
    """Of documents with equal texts the one with the largest identifier stays; of a row that is repeated, one."""
    common.tune(spark)
    marks = common.stored(dedup_exact.exact_duplicates(docs, keep="max"), "copies")
    kept = without(docs, marks.where("not kept and doc_id <> keep_id").select("doc_id", "text_sha256"))
    again = marks.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if common.is_empty(again):
        return kept
    again = common.stored(again, "repeated-rows")
    repeated = kept.join(again, kept["doc_id"].eqNullSafe(again["doc_id"]), "left_semi")
    first = repeated.withColumn("__row", F.row_number().over(Window.partitionBy("doc_id", F.coalesce("text", F.lit(""))).orderBy(F.lit(0)))).where("__row = 1").select(docs.columns)
    return kept.join(again, kept["doc_id"].eqNullSafe(again["doc_id"]), "left_anti").unionByName(first)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of linked documents stays: the one with the smallest identifier."""
    common.tune(spark)
    return without(docs, jaccard_join.near_duplicates(docs).where("doc_id <> component_id").select("doc_id"))


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a noticeable part of a benchmark text go."""
    common.tune(spark)
    found = decontaminate.contamination(decontaminate.find_matches(docs, common.read(spark, sf_dir, "benchmark")))
    return without(docs, found.where("contaminated").select("doc_id", "text_sha256"))


def encode(spark, docs, sf_dir):
    """What is left, encoded and decoded: counts and digests."""
    common.tune(spark)
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]


def run(spark, sf_dir):
    """All stages over documents; what a stage keeps is written and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, "stage")
    return docs
