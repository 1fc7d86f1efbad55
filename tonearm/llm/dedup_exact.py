"""Exact duplicates through a log-structured merge index of text digests, in DataFrame operations only.

* A batch of documents is read once and fills MEMTABLES *memtables* by input partition, of (digest, row) entries. Each
  is flushed as a run of level 0, sorted by digest: one entry a digest, with the row that stays and how many rows have it.
* Each run has a *filter*, a bitmap over hashes of its digests. Where a newer run meets it, only the digests that pass the
  filter are merged with the run itself; the others stand beside it.
* *Compaction*: FANOUT runs of a level are merged, two sorted runs at a time by a sort-merge full outer join, to one run
  of the next level, that keeps the smallest (or largest) identifier and the counts' sum. A batch is judged by all levels merged.
* A digest held by several rows is a *hit*. Hits get byte verification: the smallest and the largest text of
  the digest must be the same bytes. Should they ever differ, the rows of that digest are grouped by text.

Defined results: a null text is the empty text; empty texts equal each other; a row repeated with its
identifier counts as another copy, and one of the two stays; rows with a null identifier sort below all
others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Hits (32 bytes each) and filters (by bytes) are broadcast up to so many, and joined by a shuffle beyond.
BROADCAST_HITS, BROADCAST_FILTER = 100_000, 16 << 20
#: Memtables of a batch, runs of a level before they are merged, and bits of a filter for each digest.
MEMTABLES, FANOUT, FILTER_BITS = 5, 4, 10
_BUCKET = 1 << 15  # bits of one bitmap of Spark's bitmap functions


def _digest():
    return F.unhex(F.sha2("text", 256)).alias("digest")


def fill_memtables(docs: DataFrame, batch: int = 0, tables: int = MEMTABLES) -> DataFrame:
    """docs(doc_id, text) -> stored entries (memtable, doc_id, row, digest); row tells all rows of the index apart."""
    row = F.struct(F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("at"))
    return common.stored(docs.select((F.spark_partition_id() % tables).alias("memtable"), "doc_id", row.alias("row"), _digest()), "lsm-memtables")


def flush(entries: DataFrame, keep: str = "min") -> DataFrame:
    """A run (digest, keeper struct(doc_id, row), group_size) of a memtable's entries."""
    best = F.max if keep == "max" else F.min
    return entries.groupBy("digest").agg(best(F.struct("doc_id", "row")).alias("keeper"), F.count("*").alias("group_size"))


def merge_runs(older: Run, newer: Run, keep: str = "min") -> DataFrame:
    """Two runs as one: what passes the older run's filter by a sort-merge full outer join, the rest beside it."""
    tested = older.tested(newer.entries)
    new = tested.where("maybe").select("digest", F.col("keeper").alias("keeper2"), F.col("group_size").alias("size2"))
    best = F.greatest if keep == "max" else F.least
    sizes = F.coalesce("group_size", F.lit(0)) + F.coalesce("size2", F.lit(0))
    met = older.entries.hint("merge").join(new, "digest", "full_outer").select("digest", best("keeper", "keeper2").alias("keeper"), sizes.cast("long").alias("group_size"))
    return met.unionByName(tested.where("not maybe").select("digest", "keeper", "group_size"))


class Run:
    """A stored run and its filter: rows of (bucket, bitmap)."""

    def __init__(self, entries: DataFrame):
        self.entries = common.stored(entries.sortWithinPartitions("digest"), "lsm-run")
        self.bits = max(_BUCKET, self.entries.count() * FILTER_BITS)
        at = self._at()
        self.filter = common.stored(self.entries.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")), "lsm-filter")

    def _at(self):
        return F.pmod(F.xxhash64("digest"), F.lit(self.bits)) + 1

    def tested(self, entries: DataFrame) -> DataFrame:
        """The entries, with whether their digest may be in this run."""
        filters = F.broadcast(self.filter) if self.bits // 8 <= BROADCAST_FILTER else self.filter
        bit = F.bitmap_bit_position(self._at())
        byte = F.conv(F.hex(F.substring("bitmap", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        found = entries.withColumn("bucket", F.bitmap_bucket_number(self._at())).join(filters, "bucket", "left")
        return found.select(*entries.columns, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)).alias("maybe"))

    def passing(self, entries: DataFrame) -> DataFrame:
        """Entries whose digest may be in this run."""
        return self.tested(entries).where("maybe").select(entries.columns)

    def drop(self) -> None:
        common.drop(self.entries, self.filter)


class DigestIndex:
    """Batches of documents one after the other; keep: whether of equal texts the smallest or the largest identifier stays."""

    def __init__(self, keep: str = "min"):
        self.keep, self.levels, self.sources, self.batches = keep, [[]], [], 0

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, judged against all batches up to this one."""
        docs = common.clean_columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
        rows = fill_memtables(docs, self.batches)
        for k in range(MEMTABLES):
            self.levels[0].append(Run(flush(rows.where(F.col("memtable") == k), self.keep)))
            self._compact_levels()
        self.sources.append(docs)
        self.batches += 1
        hits = common.stored(self._merged([r for level in reversed(self.levels) for r in level]).where("group_size > 1"), "lsm-hits")
        return self._judged(docs, rows, hits)

    def _merged(self, runs: list[Run]) -> DataFrame:
        """Runs, the oldest first, as one; all but the last merge are stored with filters of their own."""
        done, rest = runs[0], runs[1:]
        for k, run in enumerate(rest):
            entries = merge_runs(done, run, self.keep)
            if k + 1 == len(rest):
                return entries
            made = Run(entries)
            if done is not runs[0]:
                done.drop()
            done = made
        return done.entries

    def _compact_levels(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) < FANOUT:
                continue
            merged = Run(self._merged(level))
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(merged)
            for run in level:
                run.drop()
            self.levels[k] = []

    def _judged(self, docs: DataFrame, rows: DataFrame, hits: DataFrame) -> DataFrame:
        near = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
        everything = self.sources[0]
        for more in self.sources[1:]:
            everything = everything.unionByName(more)
        clashes = common.stored(_clashing(everything, near), "lsm-clashes")
        out = rows.join(near, "digest", "left").select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("group_size").isNull() | (F.col("keeper.row") == F.col("row"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
        return out if common.is_empty(clashes) else _split(out, everything, docs, clashes, self.keep)


def _clashing(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests whose rows do not all have the same bytes."""
    rows = docs.select(_digest(), "text").join(hits.select("digest"), "digest", "left_semi")
    return rows.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high").select("digest")


def _split(out: DataFrame, everything: DataFrame, docs: DataFrame, clashes: DataFrame, keep: str) -> DataFrame:
    """Rows of clashing digests judged by their text instead."""
    rows = lambda df: df.select("doc_id", "text", _digest()).join(clashes, "digest", "left_semi")
    largest = keep == "max"
    groups = rows(everything).groupBy("digest", "text").agg((F.max("doc_id") if largest else F.min("doc_id")).alias("keep_id"), F.count("*").alias("group_size"))
    w = Window.partitionBy("digest", "text").orderBy(F.col("doc_id").desc_nulls_last() if largest else F.col("doc_id").asc_nulls_first())
    own = rows(docs).withColumn("k", F.row_number().over(w)).join(groups, ["digest", "text"])
    own = own.select("doc_id", "keep_id", "group_size", ((F.col("k") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return out.join(clashes.select(F.lower(F.hex("digest")).alias("text_sha256")), "text_sha256", "left_anti").select(own.columns).unionByName(own)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256; docs are the only batch of an index."""
    return DigestIndex(keep).add(docs, id_col, text_col)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.read(spark, sf_dir, "documents"), keep="max")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
