"""Repeated byte strings of at least LENGTH bytes, found by a distributed merge sort of suffixes and removed.

Suffixes are sparse: a string of LENGTH bytes is anchored at the GRAM-byte gram of the smallest hash in it, so that
equal strings have their anchors at the same place, and only anchored suffixes are sorted. An anchor carries the
bytes to its right (the suffix), those to its left, and the range of string starts that it anchors.

1. Grams of anchors are counted; those that occur once are set aside by a Bloom filter of the others.
2. Each task sorts its remaining suffixes and front-codes them: a run stores of each suffix only what it doesn't
   share with the one before. Runs are exchanged by gram.
3. Runs are merged by a loser tree whose matches compare known common prefixes first and read bytes only beyond
   them. The merge yields every suffix's common prefix with the one before.
4. Two suffixes with R common bytes to the right and L to the left repeat the strings that start at most L and at
   least LENGTH - R bytes before them. The starts are gathered by document, and covered bytes removed.

A gram with more than HOT_ANCHORS anchors is not merged in one task: its strings are dealt out by their hashes and
equal hashes are repeats.

Defined results: null text is empty; strings never span documents; rows are told apart by identifier and text
together, and a row that repeats another is another occurrence of its strings; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .url_filter import Bloom

LENGTH, GRAM = 400, 32
HOT_ANCHORS = 20_000
#: Anchors that a bucket of runs gets, and strings of hot grams that a salt gets, on average.
BUCKET_ANCHORS, SALT_STRINGS = 250_000, 1_000_000
MAX_FILTER_BITS = 1 << 27
#: Ranges (16 bytes each) are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_RANGES = 500_000
#: Texts are searched in pieces of so many string starts; positions in a piece fit 24 bits.
PIECE = 1 << 20
PAIRS = 48

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, PIECE + LENGTH + 1), _powers(_INVERSE, PIECE + LENGTH + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all strings of so many bytes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    return _mix((sums[length:] - sums[:-length]) * _DOWN[: n - length + 1])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """Yields (position, gram's hash, first start, last start) arrays: starts first..last have their anchor at the position."""
    width, n = length - gram + 1, len(data) - length + 1
    for begin in range(0, n, PIECE):
        starts = min(PIECE, n - begin)
        piece = np.frombuffer(data, np.uint8, starts + length - 1, begin)
        hashes = string_hashes(piece, gram)
        marked = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(len(hashes), dtype=np.uint64)
        padded = np.full(-(-len(marked) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(marked)] = marked
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], starts) - 1
        yield at[first] + begin, hashes[at[first]], first + begin, last + begin


class Anchored:
    """One suffix: right[0:] from the anchor on, left backwards from it; low..high: how far before it strings start."""

    __slots__ = ("right", "left", "low", "high", "doc", "position")

    def __init__(self, right, left, low, high, doc, position):
        self.right, self.left, self.low, self.high, self.doc, self.position = right, left, low, high, doc, position


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which known bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n  # equal up to low, different before high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


_HEAD = struct.Struct("<HHHHHqI")


def front_code(run: list[Anchored]) -> bytes:
    out, before = [], b""
    for s in run:
        k = shared(before, s.right)
        out.append(_HEAD.pack(k, len(s.right) - k, len(s.left), s.low, s.high, s.doc, s.position))
        out += (s.right[k:], s.left)
        before = s.right
    return b"".join(out)


def front_decode(data: bytes):
    """Yields (suffix, common prefix with the one before)."""
    at, before = 0, b""
    while at < len(data):
        k, n, m, low, high, doc, position = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        before = before[:k] + data[at : at + n]
        yield Anchored(before, data[at + n : at + n + m], low, high, doc, position), k
        at += n + m


class LoserTree:
    """Merges sorted runs. A node keeps the loser of its match and the prefix it shares with the winner.

    Two suffixes that are both known to share a and b bytes with the same winner are ordered by a and b alone
    unless a = b; only then bytes from there on are read.
    """

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.heads: list = [None] * self.size  # (suffix, prefix shared with the last winner)
        for k in range(len(runs)):
            first = next(self.runs[k], None)
            self.heads[k] = first and (first[0], 0)
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, x: int, y: int) -> int:
        """The winner; the loser stays, and what it shares with the winner is noted."""
        a, b = self.heads[x], self.heads[y]
        if a is None or b is None:
            win, lose = (x, y) if b is None else (y, x)
        elif a[1] != b[1]:  # who shares more with the last winner, which is below both, is smaller; the other keeps its prefix
            win, lose = (x, y) if a[1] > b[1] else (y, x)
        else:
            k = shared(a[0].right, b[0].right, a[1])
            win, lose = (x, y) if a[0].right[k : k + 1] <= b[0].right[k : k + 1] else (y, x)
            self.heads[lose] = (self.heads[lose][0], k)
        self.losers[node] = lose
        return win

    def __iter__(self):
        """Yields (suffix, common prefix with the one before)."""
        while (head := self.heads[self.winner]) is not None:
            yield head
            run = self.winner
            then = next(self.runs[run], None)
            self.heads[run] = then
            node, win = (run + self.size) // 2, run
            while node:
                win = self._play(node, win, self.losers[node])
                node //= 2
            self.winner = win


def repeated_starts(group: list[Anchored], prefixes: list[int], length: int = LENGTH):
    """group: sorted suffixes that share a gram, with their common prefixes. Yields (suffix, first, last): starts that repeat."""
    own: dict[tuple, list[int]] = {}
    for k, s in enumerate(group):
        own.setdefault((s.right, s.left, s.low, s.high), []).append(k)
    kept = sorted(ks[0] for ks in own.values())
    for ks in own.values():
        if len(ks) > 1:
            for k in ks:
                yield group[k], group[k].position - group[k].high, group[k].position - group[k].low
    if len(kept) <= PAIRS:
        yield from _by_pairs(group, prefixes, kept, own, length)
    else:
        yield from _by_offsets(group, prefixes, kept, own, length)


def _by_pairs(group, prefixes, kept, own, length):
    for x, k in enumerate(kept):
        a, right, at = group[k], LENGTH * 4, k
        for j in kept[x + 1 :]:
            right = min(right, min(prefixes[at + 1 : j + 1]))
            at = j
            if right < length - a.high:
                break
            b = group[j]
            least = length - right
            if least > b.high:
                continue
            left = shared(a.left, b.left)
            for s in (a, b):
                low, high = max(s.low, least), min(s.high, left)
                if low <= high:
                    for e in own[s.right, s.left, s.low, s.high]:
                        yield group[e], group[e].position - high, group[e].position - low


def _by_offsets(group, prefixes, kept, own, length):
    """The same for many suffixes: for each distance before the anchor, equal left sides within runs of equal right sides."""
    n = len(kept)
    common_ = np.array([min(prefixes[a + 1 : b + 1]) for a, b in zip(kept, kept[1:])], np.int64)
    low, high = (np.array([getattr(group[k], f) for k in kept], np.int64) for f in ("low", "high"))
    widest = int(high.max())
    left = np.zeros((n, widest + 1), np.uint64)
    for r, k in enumerate(kept):
        data = np.frombuffer(group[k].left, np.uint8)[:widest]
        left[r, : len(data)] = data.astype(np.uint64) + np.uint64(1)
    hashed = np.zeros(n, np.uint64)
    again = np.zeros((n, widest + 1), bool)
    for d in range(widest + 1):
        run = np.concatenate([[0], np.cumsum(common_ < length - d)]).astype(np.uint64)
        member = np.flatnonzero((low <= d) & (d <= high))
        if len(member) > 1:
            key = _mix(hashed[member] + _mix(run[member] + np.uint64(1)))
            _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
            again[member, d] = counts[back] > 1
        hashed = hashed * np.uint64(_BASE) + left[:, d]
    for r, k in enumerate(kept):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], again[r], [False]]).astype(np.int8)))
        s = group[k]
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            for e in own[s.right, s.left, s.low, s.high]:
                yield group[e], group[e].position - b + 1, group[e].position - a


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = common.clean_columns(docs, doc_id=id_col, text=text_col)
    return docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("doc"))


def _gram_counts(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            grams = [g for text in common.texts(common.column(batch, "text")) if len(text) * 4 >= LENGTH for _, g, *_ in anchors(text.encode("utf-8", "surrogatepass"))]
            if grams:
                grams, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    counted = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return common.stored(counted.where("n > 1"), "grams")


def _starts(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(doc, starts): the ranges of repeated strings' starts."""
    spark = docs.sparkSession
    n = grams.count()

    again = Bloom.of(grams.select("gram"), min(n, MAX_FILTER_BITS // 12), 0.003, 0, lambda a: (a, _mix(a.view(np.uint64) + np.uint64(1)).view(np.int64)))
    hot = sorted(r["gram"] for r in grams.where(F.col("n") > HOT_ANCHORS).select("gram").collect())  # at most anchors / HOT_ANCHORS
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = grams.agg(F.coalesce(F.sum(F.when(F.col("n") <= HOT_ANCHORS, F.col("n"))), F.lit(0)).alias("runs"), F.coalesce(F.sum(F.when(F.col("n") > HOT_ANCHORS, F.col("n"))), F.lit(0)).alias("dealt")).first()
    buckets = max(2 * parts, -(-known["runs"] // BUCKET_ANCHORS))
    salts = max(64, -(-known["dealt"] * GRAM // SALT_STRINGS))  # an anchor stands for some GRAM starts
    sent = spark.sparkContext.broadcast((again, np.array(hot, np.int64)))

    def send(batches):
        common.holds("substrings")
        again, hot = sent.value
        for batch in batches:
            runs: dict[int, list[Anchored]] = {}
            dealt = [[], [], []]
            for doc, text in zip(common.column(batch, "doc").to_pylist(), common.texts(common.column(batch, "text"))):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) < LENGTH:
                    continue
                for position, gram, first, last in anchors(data):
                    signed = gram.view(np.int64)
                    ok = again.passes(signed, _mix(gram + np.uint64(1)).view(np.int64))
                    is_hot = np.isin(signed, hot) if len(hot) else np.zeros(len(gram), bool)
                    for p, g, a, b in zip(*(x[ok & ~is_hot].tolist() for x in (position, gram, first, last))):
                        runs.setdefault((g >> 8) % buckets, []).append(Anchored(data[p : b + LENGTH], data[a:p][::-1], p - b, p - a, doc, p))
                    for a, b in zip(*(x[ok & is_hot].tolist() for x in (first, last))):
                        strings = string_hashes(np.frombuffer(data, np.uint8, b - a + LENGTH, a), LENGTH)
                        dealt[0].append(strings)
                        dealt[1].append(np.full(len(strings), doc, np.int64))
                        dealt[2].append(np.arange(a, b + 1, dtype=np.int64))
            out = []
            for bucket, run in runs.items():
                run.sort(key=lambda s: s.right)
                out.append((bucket, False, front_code(run)))
            if dealt[0]:
                strings, doc, start = (np.concatenate(x) for x in dealt)
                salt = (strings % np.uint64(salts)).astype(np.int64)
                for k in np.unique(salt).tolist():
                    at = salt == k
                    out.append((buckets + k, True, b"".join(x[at].tobytes() for x in (strings.view(np.int64), doc, start))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.binary())], names=["bucket", "dealt", "run"])

    def merged(runs):
        group, prefixes = [], []
        for s, k in LoserTree([front_decode(r) for r in runs]):
            if k < GRAM and group:
                if len(group) > 1:
                    yield from repeated_starts(group, prefixes)
                group, prefixes = [], []
            group.append(s)
            prefixes.append(k)
        if len(group) > 1:
            yield from repeated_starts(group, prefixes)

    def receive(key, table):
        runs = table.column("run").to_pylist()
        if table.column("dealt")[0].as_py():
            dealt = [np.frombuffer(r, np.int64).reshape(3, -1) for r in runs]
            strings, doc, start = np.concatenate(dealt, axis=1)
            _, back, counts = np.unique(strings, return_inverse=True, return_counts=True)
            doc, first = doc[counts[back] > 1], start[counts[back] > 1]
            last = first
        else:
            found = [(s.doc, a, b) for s, a, b in merged(runs)]
            doc, first, last = (np.array([f[k] for f in found], np.int64) for k in range(3))
        doc, first, last = merge_ranges(doc, first, last)
        part, out = doc % parts, []
        for k in np.unique(part).tolist():
            at = part == k
            out.append((k, b"".join(x[at].tobytes() for x in (doc, first, last))))
        return pa.table({"part": pa.array([k for k, _ in out], pa.int32()), "ranges": pa.array([r for _, r in out], pa.binary())})

    def gather(key, table):
        ranges = [np.frombuffer(r, np.int64).reshape(3, -1) for r in table.column("ranges").to_pylist()]
        doc, first, last = merge_ranges(*np.concatenate(ranges, axis=1))
        docs, at = np.unique(doc, return_index=True)
        starts = pa.StructArray.from_arrays([pa.array(first), pa.array(last)], names=["first", "last"])
        return pa.table({"doc": pa.array(docs), "starts": pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)), pa.int32()), starts)})

    found = docs.select("doc", "text").mapInArrow(send, "bucket int, dealt boolean, run binary").groupBy("bucket").applyInArrow(receive, "part int, ranges binary")
    return common.stored(found.groupBy("part").applyInArrow(gather, "doc long, starts array<struct<first:bigint,last:bigint>>"), "repeats")


def merge_ranges(doc: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Ranges first..last of each doc in order, those that overlap or touch as one."""
    if not len(doc):
        return doc, first, last
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    apart = np.cumsum(new) << 40  # documents apart, so that one running maximum serves all
    reach = np.maximum.accumulate(last + apart)
    at = np.flatnonzero(new | np.concatenate([[True], (first + apart)[1:] > reach[:-1] + 1]))
    ends = np.append(at[1:], len(doc)) - 1
    return doc[at], first[at], (reach - apart)[ends]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's doc_id, text and spans: array of struct(begin, end), the maximal runs of bytes to remove, in order."""
    docs = _keyed(docs, id_col, text_col)
    by_doc = _starts(docs, _gram_counts(docs))
    small = (by_doc.agg(F.sum(F.size("starts"))).first()[0] or 0) <= BROADCAST_RANGES
    by_doc = F.broadcast(by_doc) if small else by_doc
    zero = F.lit(None).cast("array<struct<begin:bigint,end:bigint>>")

    def add(spans, s):
        begin, end = s["first"], s["last"] + LENGTH
        one = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        prior = F.element_at(spans, -1)
        grown = F.array(F.struct(prior["begin"].alias("begin"), F.greatest(prior["end"], end).alias("end")))
        return F.when(spans.isNull(), one).when(begin <= prior["end"], F.concat(F.slice(spans, 1, F.size(spans) - 1), grown)).otherwise(F.concat(spans, one))

    return docs.join(by_doc, "doc", "left").select("doc_id", "text", F.coalesce(F.aggregate("starts", zero, add), F.array().cast("array<struct<begin:bigint,end:bigint>>")).alias("spans"))


def removed(spans: DataFrame) -> DataFrame:
    """repeated_spans' rows as counts, the digest of what stays, the share of bytes removed (0 of none), and whether any are."""
    kind = spans.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, gone, digest = [], [], []
            cuts = common.column(batch, "spans").to_pylist()
            for text, cut in zip(common.texts(common.column(batch, "text")), cuts):
                data, at, h = text.encode("utf-8", "surrogatepass"), 0, hashlib.sha256()
                for c in cut:
                    h.update(data[at : c["begin"]])
                    at = c["end"]
                h.update(data[at:])
                n.append(len(data))
                gone.append(sum(c["end"] - c["begin"] for c in cut))
                digest.append(h.hexdigest())
            counts = [pa.array(x, pa.int64()) for x in (n, gone, [len(c) for c in cuts])]
            share = pa.array([g / max(k, 1) for g, k in zip(gone, n)], pa.float64())
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), *counts, pa.array(digest, pa.string()), share, pa.array([g > 0 for g in gone], pa.bool_())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_share", "repeats"])

    return spans.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed_share double, repeats boolean")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return removed(repeated_spans(common.read(spark, sf_dir, "documents")))
