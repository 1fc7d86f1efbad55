"""Benchmark decontamination with suffix arrays over the training words.

The documents are split into words once. Every Arrow batch of them is a shard: it keeps the suffixes that begin like some
test suffix (no other can match), cut to a window, and stores them sorted, dealt to buckets by their first words. Test
suffixes are dealt the same way, and each is binary-searched in the suffixes that its bucket has of all shards. Neighbouring hits
on one diagonal join into the longest verbatim matches.

What tells a suffix's beginning is a hash of its first HEAD words. Up to `block_words` of those are sent to the tasks as a
sorted list, more as a filter of bounded size that lets some others pass; the test set itself is only ever dealt out by
Spark. A bucket with many suffixes, as of a passage that a third of the documents have, is salted.

Defined results: null or empty texts have no words and are clean; a test item without words matches nothing;
an item shorter than a window is one window; items that repeat are all reported; an empty test set leaves
every document clean; extra columns are ignored; rows that repeat are judged each.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import common
from .url_filter import Bloom

WINDOW, HEAD = 13, 3
#: Beginnings that are sent as a list at most; bits of the filter beyond; suffixes that a salt of a bucket gets, and hits of a task.
BLOCK_WORDS, FILTER_KEYS, SALT_SUFFIXES, TASK_HITS = 1_000_000, 10_000_000, 200_000, 500_000
MEMO_WORDS = 1_000_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Words' hashes, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def beginnings(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on; places from which fewer follow have none of their own."""
    code = np.full(max(0, len(hashes) - n + 1), n, np.uint64)
    for k in range(n):
        code = _mixed(code * _FACTOR + hashes[k : k + len(code)])
    return code


def _key(words: list[bytes]) -> bytes:
    """Words that end with a space each, so that a window's key is the beginning of a suffix's only if its words are."""
    return b" ".join(words) + b" "


def _windows(window: int, buckets: int, schema: pa.Schema):
    """Each test suffix: its item, place, words, key, beginning and bucket."""

    def run(batches: Iterator[pa.RecordBatch]):
        common.holds("decontamination")
        memo = _Hashes()
        for batch in batches:
            rows = []
            for item, text in zip(common.column(batch, "item_id").to_pylist(), common.texts(common.column(batch, "text"))):
                ws = common.words(text)
                n = min(window, len(ws))
                if n:
                    head = min(HEAD, n)
                    codes = beginnings(np.array([memo[w] for w in ws], np.uint64), head).tolist()
                    rows += [(item, s, n, _key(ws[s : s + n]), codes[s] - (1 << 63), head, codes[s] % buckets) for s in range(len(ws) - n + 1)]
            if rows:
                yield common.batch_of(schema, *map(list, zip(*rows)))

    return run


class _Beginnings:
    """The hashes of test suffixes' first words, by how many words they are of."""

    def __init__(self, lists: dict[int, np.ndarray], filters: dict[int, Bloom]):
        self.lists, self.filters = lists, filters

    def lengths(self) -> list[int]:
        return sorted({*self.lists, *self.filters})

    def among(self, codes: np.ndarray, n: int) -> np.ndarray:
        if n in self.filters:
            return self.filters[n].passes(codes.view(np.int64), _mixed(codes + np.uint64(1)).view(np.int64))
        known = self.lists[n]
        return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


def _beginnings_of(windows: DataFrame, most: int) -> _Beginnings:
    codes = windows.select("head", "code").distinct()
    counts = {r["head"]: r["n"] for r in codes.groupBy("head").agg(F.count("*").alias("n")).collect()}
    if sum(counts.values()) <= most:
        found: dict[int, list[int]] = {}
        for r in codes.collect():
            found.setdefault(r["head"], []).append(r["code"] + (1 << 63))
        return _Beginnings({n: np.sort(np.array(x, np.uint64)) for n, x in found.items()}, {})

    def pair(code):
        code = (code ^ np.int64(-(1 << 63))).view(np.uint64)
        return code.view(np.int64), _mixed(code + np.uint64(1)).view(np.int64)

    return _Beginnings({}, {n: Bloom.of(codes.where(F.col("head") == n).select("code"), min(count, FILTER_KEYS), 0.01, 0, pair) for n, count in counts.items()})


_SHARD = "doc long, doc_id {kind}, text_sha256 string, n_words long, bucket int, key binary, word long"


def _shards(sent, window: int, buckets: int, schema: pa.Schema):
    """A row for each document, and the shard's suffixes in order of bucket and words."""

    def run(batches: Iterator[pa.RecordBatch]):
        common.holds("decontamination")
        known: _Beginnings = sent.value
        memo, doc = _Hashes(), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = common.texts(common.column(batch, "text"))
            docs = [common.words(t) for t in texts]
            size = np.array([len(ws) for ws in docs], np.int64)
            ends = np.cumsum(size)
            hashes = np.fromiter((h for ws in docs for h in map(memo.__getitem__, ws)), np.uint64, int(size.sum()))
            digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
            keys = np.arange(doc, doc + len(docs))
            doc += len(docs)
            none = len(docs)
            yield common.batch_of(schema, keys, common.column(batch, "doc_id"), digests, size, pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()), pa.nulls(none, pa.int64()))
            found = []
            for n in known.lengths():
                codes = beginnings(hashes, n)
                at = np.flatnonzero(known.among(codes, n)) if len(codes) else np.zeros(0, np.int64)
                of = np.searchsorted(ends, at, "right")
                inside = at + n <= ends[of]
                for p, d, bucket in zip(at[inside].tolist(), of[inside].tolist(), (codes[at[inside]] % np.uint64(buckets)).tolist()):
                    w = p - int(ends[d] - size[d])
                    found.append((bucket, _key(docs[d][w : w + window]), int(keys[d]), w))
            found.sort()
            for k in range(0, len(found), 10_000):
                bucket, key, own, word = zip(*found[k : k + 10_000])
                none = len(bucket)
                yield common.batch_of(schema, list(own), pa.nulls(none, schema.field("doc_id").type), pa.nulls(none, pa.string()), pa.nulls(none, pa.int64()), list(bucket), list(key), list(word))

    return run


def _search(schema: pa.Schema):
    """Every test suffix of a bucket in the suffixes of all shards."""

    def run(suffixes: pa.Table, tests: pa.Table) -> pa.Table:
        out = []
        if suffixes.num_rows and tests.num_rows:
            suffixes = suffixes.take(pc.sort_indices(suffixes, sort_keys=[("key", "ascending")]))
            array = suffixes.column("key").to_pylist()
            doc, word = (suffixes.column(c).to_numpy() for c in ("doc", "word"))
            for item, s, n, key in zip(*(tests.column(c).to_pylist() for c in ("item_id", "item_word", "n_words", "key"))):
                first, last = bisect_left(array, key), bisect_left(array, key[:-1] + b"!")  # the byte behind a space
                if last > first:
                    k = last - first
                    out.append(pa.table([pa.array(doc[first:last]), pa.array([item] * k, schema.field("item_id").type), pa.array(word[first:last]), pa.array(np.full(k, s)), pa.array(np.full(k, n))], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _longest(schema: pa.Schema):
    """Hits of some documents as their longest matches: those of neighbouring windows on one diagonal are one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        items = table.column("item_id").combine_chunks().dictionary_encode()
        item = items.indices.fill_null(len(items.dictionary)).to_numpy(zero_copy_only=False)
        doc, word, at, n = (table.column(c).to_numpy() for c in ("doc", "word", "item_word", "n_words"))
        order = np.lexsort((word, word - at, item, doc))
        doc, item, word, at, n = doc[order], item[order], word[order], at[order], n[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (word[1:] - at[1:] != word[:-1] - at[:-1]) | (word[1:] > word[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        matches = pa.StructArray.from_arrays([table.column("item_id").combine_chunks().take(pa.array(order[first])), pa.array(word[first]), pa.array(at[first]), pa.array(word[last] + n[last] - word[first])], names=["item_id", "word", "item_word", "n_words"])
        docs, begin = np.unique(doc[first], return_index=True)
        return pa.table([pa.array(docs), pa.ListArray.from_arrays(pa.array(np.append(begin, len(first)), pa.int32()), matches)], schema=schema)

    return run


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row's doc_id, text_sha256, n_words and matches: the longest verbatim matches of at least a window, with places in words."""
    spark = docs.sparkSession
    docs, benchmark = common.clean_columns(docs, doc_id=id_col, text=text_col), common.clean_columns(benchmark, item_id="item_id", text="text")
    kind, item = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id")))
    arrow = lambda ddl: to_arrow_schema(_parse_datatype_string(ddl))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ddl = f"item_id {item}, item_word long, n_words long, key binary, code long, head int, bucket int"
    windows = common.stored(benchmark.mapInArrow(_windows(window, buckets, arrow(ddl)), ddl), "test-suffixes")
    sent = spark.sparkContext.broadcast(_beginnings_of(windows, block_words))
    ddl = _SHARD.format(kind=kind)
    shards = common.stored(docs.mapInArrow(_shards(sent, window, buckets, arrow(ddl)), ddl), "shards")
    suffixes = shards.where("bucket is not null").select("bucket", "key", "doc", "word")
    salts = max(1, -(-suffixes.count() // SALT_SUFFIXES))
    left = suffixes.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)))
    right = windows.select("item_id", "item_word", "n_words", "key", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    ddl = f"doc long, item_id {item}, word long, item_word long, n_words long"
    hits = common.stored(left.groupBy("bucket", "salt").cogroup(right.groupBy("bucket", "salt")).applyInArrow(_search(arrow(ddl)), ddl), "test-hits")
    ddl = f"doc long, matches array<struct<item_id:{item},word:bigint,item_word:bigint,n_words:bigint>>"
    tasks = max(buckets, -(-hits.count() // TASK_HITS))
    matches = hits.groupBy(F.pmod(F.xxhash64("doc"), F.lit(tasks)).alias("task")).applyInArrow(_longest(arrow(ddl)), ddl)
    return shards.where("bucket is null").select("doc", "doc_id", "text_sha256", "n_words").join(matches, "doc", "left").drop("doc")


def contamination(matched: DataFrame, share: int = 20) -> DataFrame:
    """find_matches' rows with n_hit (words inside a match), item_ids and contaminated: n_hit > 0 and share * n_hit >= n_words."""
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["word"].alias("a"), (m["word"] + m["n_words"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))
    union = F.aggregate(spans, zero, lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["hit"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(acc["end"], s["a"]))).alias("hit")))
    out = matched.withColumn("n_hit", F.coalesce(union["hit"], F.lit(0).cast("long")))
    out = out.withColumn("item_ids", F.array_sort(F.transform(F.array_distinct(F.transform(F.coalesce("matches", F.array()), lambda m: m["item_id"])), lambda i: i.cast("string"))))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(find_matches(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


#: The contract in SQL: windows as texts of words, matched by equality; a hit word is inside any of them.
SQL = r"""
WITH lower_docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least(13, len(ws)) AS n FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(ws[s : s + n - 1], ' ') AS w FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM sized)),
lengths AS (SELECT DISTINCT n FROM sized),
places AS (SELECT doc_id, n, p, array_to_string(ws[p : p + n - 1], ' ') AS w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM lower_docs, lengths)),
hits AS (SELECT doc_id, item_id, p, n FROM places JOIN windows USING (n, w)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM lower_docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
