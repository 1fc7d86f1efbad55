"""Documents whose 5-word shingle sets have a Jaccard similarity of at least 0.8, as components of linked documents.

Shingles are ordered: those that few texts have first (by their hash), then the frequent ones. A set of n shingles
can link only with a set that shares one of the first n - ceil(0.8 n) + 1. While these are all rare, each is
indexed by itself. A prefix that reaches into the frequent class is extended by e shingles, so that a link shares
1 + e of it: either a rare shingle, which is indexed by itself, or 1 + e frequent ones, of which two fall into the
same of e residue classes, so that pairs of frequent shingles of one class are indexed (k = 2). e depends on the
size band of the sets, and sets of neighbouring bands index for both.

The frequent class comes from counts over all documents: each window of WINDOW_TOKENS shingles of a task is counted
exactly and the shingles that it has more than once are reported; those whose reports add up to MIN_FREQUENT are
frequent. They are sent as a Bloom filter; where they are more than the filter is made for, the bound is doubled until
they are not. Any such filter gives an order that all documents agree on, so none gives wrong results: a shingle that
many windows have once each may count as rare, and then has a longer bucket.

Candidates are verified in two rounds. First, each document's neighbours in the index are tried, the closest two
by their bitmaps; links found are contracted to components. Then every pair of an index bucket that is not yet in
one component is tried: bitmaps bound the intersection from above, and what they don't rule out is counted exactly;
of two components the likeliest pairs come first, and none is left out.
Documents whose bitmaps rule out all pairs are looked at in one round alone.
Buckets are cut by sizes: a shingle's place in a set bounds the sizes of sets that it may be the first to share with.
Buckets are split into blocks of BLOCK_DOCS documents, so no task gets an unbounded group. Sets that are equal are
represented by the smallest identifier from the start.

Shingles are compared by 64-bit hashes. Defined results: null or empty texts, and texts of white space, have no
shingles and link with nothing; texts of fewer words are one shingle; rows that repeat an identifier are one node; a
null identifier has a null component; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import common
from .graph import components
from .url_filter import Bloom

SHINGLE = 5
#: Linked when 5 * intersection >= 4 * union.
WINDOW_TOKENS = 1_000_000
MIN_FREQUENT = 48
#: Bits of the filter of frequent shingles, and how many shingles it is made for.
MAX_FILTER_BITS = 1 << 27
MAX_FREQUENT = MAX_FILTER_BITS // 12
BITMAP_BITS = (64, 1 << 16)
BLOCK_DOCS, TASK_ROWS = 2048, 20_000
#: Neighbours in the index that the first round compares; the second leaves out none.
NEIGHBOURS = 24
#: Rounds that try only the best pairs of components, before the one that leaves out none.
BEST_ROUNDS = 2
#: Identifiers (8 bytes each) are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_IDS = 500_000
#: Texts are hashed in pieces of so many bytes.
PIECE_BYTES = 1 << 20

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_BANDS = 1.25 ** np.arange(0, 200)


def _mix(x: np.ndarray) -> np.ndarray:
    """A full mix of 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15
_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def _raised(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


_UP, _DOWN = (_raised(base, PIECE_BYTES + 2) for base in (_BASE, pow(_BASE, -1, 1 << 64)))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a piece; long single words get tables of their own."""
    up, down = (_UP, _DOWN) if len(data) < len(_UP) else (_raised(_BASE, len(data) + 1), _raised(pow(_BASE, -1, 1 << 64), len(data) + 1))
    edges = np.flatnonzero(np.diff(data == 32, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up[: len(data)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _hashed_texts(texts: list[str]):
    """Yields (word hashes, their first places, where texts begin) of texts that lie one behind the other, PIECE_BYTES at a time or one text."""
    held, size = [], 0
    for t in [*texts, None]:
        data = None if t is None else t.encode("utf-8", "surrogatepass").lower().translate(_SPACE)
        if held and (data is None or size + len(data) >= PIECE_BYTES):
            joined = b" ".join(held)
            hashes, starts, at = [], [], 0
            while at < len(joined):  # one long text in pieces between words
                end = len(joined) if len(joined) - at <= PIECE_BYTES else (joined.rfind(b" ", at, at + PIECE_BYTES) + 1) or (joined.find(b" ", at + PIECE_BYTES) + 1) or len(joined)
                h, s = _word_hashes(np.frombuffer(joined, np.uint8, end - at, at))
                hashes.append(h)
                starts.append(s + at)
                at = end
            none = np.zeros(0, np.int64)
            yield np.concatenate([none.view(np.uint64), *hashes]), np.concatenate([none, *starts]), np.cumsum([0, *(len(d) + 1 for d in held)])
            held, size = [], 0
        if data is not None:
            held.append(data)
            size += len(data) + 1


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    out = []
    for a, starts, begins in _hashed_texts(texts):
        first = np.searchsorted(starts, begins).tolist()
        n = len(a)
        full = np.full(max(n - SHINGLE + 1, 0), SHINGLE, np.uint64)
        for i in range(SHINGLE):
            full += a[i : n - SHINGLE + 1 + i] * _FACTORS[i] if n >= SHINGLE else np.uint64(0)
        full = _mix(full)
        for lo, hi in zip(first, first[1:]):
            k = hi - lo
            if k >= SHINGLE:
                x = np.sort(full[lo : hi - SHINGLE + 1])
                out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            elif k:
                out.append(_mix(np.uint64(k) + (a[lo:hi] * _FACTORS[:k]).sum(keepdims=True)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def needed(n: int, m: int) -> int:
    """The least intersection of sets of n and m that links them."""
    return -(-4 * (n + m) // 9)


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the hashes' low bits; maps fold onto smaller ones by exclusive or."""
    bits = min(max(1 << max(2 * len(tokens) - 1, 0).bit_length(), BITMAP_BITS[0]), BITMAP_BITS[1])
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def least_difference(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At least so many elements are in one of the sets only. x, y: rows of bytes, each side of one width."""
    w = min(x.shape[1], y.shape[1])
    x, y = (np.bitwise_xor.reduce(z.reshape(len(z), -1, w), axis=1) if z.shape[1] > w else z for z in (x, y))
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def index_keys(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that a set is indexed by, and the size that a set has at most which has the key as its first shingle in common and links; frequent: which of its sorted hashes are.

    A set of n whose first i shingles are not in the other has n - i in common with it at most, which is enough for (5 n - 9 i) / 4 at most.
    """
    n = len(tokens)
    if n < 4:  # linked with equal sets at most, and these are one already
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rare, often = tokens[~frequent], tokens[frequent]
    p = n - (4 * n + 4) // 5 + 1
    most = (5 * n - 9 * np.arange(min(p, len(rare)))) // 4
    if p <= len(rare):
        return rare[:p], most
    out = [rare]
    band = int(np.searchsorted(_BANDS, n, "right")) - 1
    for b in (band, band + 1):
        e = max(1, int(0.2 * _BANDS[b - 1]))
        part = often[: p + e - len(rare)]
        cls = (part >> np.uint64(17)) % np.uint64(e)
        order = np.argsort(cls, kind="stable")
        part, cls = part[order], cls[order]
        for gap in range(1, len(part)):
            same = cls[gap:] == cls[:-gap]
            if not same.any():
                break
            low, high = np.minimum(part[:-gap], part[gap:])[same], np.maximum(part[:-gap], part[gap:])[same]
            out.append(_mix(low * _FACTORS[0] + high * _FACTORS[1] + np.uint64(b)))
    keys, at = np.unique(np.concatenate(out), return_index=True)
    return keys, np.where(at < len(most), most[np.minimum(at, len(most) - 1)] if len(most) else 0, 5 * n // 4)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_SIGNATURE = ("doc", "n", "d1", "d2", "bits", "tokens", "counts")


def _signatures(docs: DataFrame) -> DataFrame:
    """(doc, n, d1, d2, bits) of each document, and rows of the shingles that a window has more than once."""

    def run(batches):
        common.holds("jaccard")
        held, size = [], 0

        def report():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            tokens, counts = tokens[counts > 1], counts[counts > 1]
            packed = (pa.array([x.tobytes()], pa.binary()) for x in (tokens, counts.astype(np.int64)))
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.binary()), *packed], names=_SIGNATURE)

        for batch in batches:
            sets = shingle_sets(common.texts(common.column(batch, "text")))
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            d1, d2 = ([int.from_bytes(d[k : k + 8], "little", signed=True) for d in digests] for k in (0, 8))
            none = pa.nulls(len(sets), pa.binary())
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc"), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary()), none, none], names=_SIGNATURE)
            for s in sets:
                held.append(s)
                size += len(s)
                if size >= WINDOW_TOKENS:
                    yield report()
                    held, size = [], 0
        if size:
            yield report()

    return common.stored(docs.mapInArrow(run, "doc long, n long, d1 long, d2 long, bits binary, tokens binary, counts binary"), "shingle-signatures")


def _second_hash(tokens: np.ndarray) -> np.ndarray:
    return _mix(tokens + np.uint64(1))


def _frequent_filter(signatures: DataFrame) -> Bloom:
    reports = signatures.where("tokens is not null").select("tokens", "counts")

    def spread(batches):
        for batch in batches:
            for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, np.int64)), pa.array(np.frombuffer(c, np.int64))], names=["token", "n"])

    least = MIN_FREQUENT
    counted = reports.mapInArrow(spread, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted = common.stored(counted.where(F.col("n") >= least), "frequent-shingles")
    while (n := counted.where(F.col("n") >= least).count()) > MAX_FREQUENT:
        least *= 2
    out = Bloom.of(counted.where(F.col("n") >= least).select("token"), n, 0.003, 0, lambda a: (a, _signed(_second_hash(a.view(np.uint64)))))
    common.drop(counted)
    return out


def _index(docs: DataFrame, often: Bloom) -> DataFrame:
    """(key, n, most, doc) of the documents; n: the size of the document's set, most: the size of another that may link by the key."""
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        common.holds("jaccard")
        often = sent.value
        for batch in batches:
            ds, sets = common.column(batch, "doc").to_pylist(), shingle_sets(common.texts(common.column(batch, "text")))
            if not ds:
                continue
            flat = np.concatenate(sets)
            frequent = np.split(often.passes(_signed(flat), _signed(_second_hash(flat))), np.cumsum([len(s) for s in sets[:-1]]))
            keys, most = zip(*(index_keys(s, f) for s, f in zip(sets, frequent)))
            times = [len(k) for k in keys]
            sizes = np.array([len(s) for s in sets], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(keys))), pa.array(np.repeat(sizes, times)), pa.array(np.concatenate(most).astype(np.int32)), pa.array(np.repeat(np.array(ds, np.int64), times))], names=["key", "n", "most", "doc"])

    return docs.mapInArrow(run, "key long, n int, most int, doc long")


def _buckets(index: DataFrame) -> DataFrame:
    """(key, doc, prev) of documents that share a key and may link by their sizes and its places; prev is the one before by size.

    Of two sets that link, the first shingle they have in common stands in both so early that either's `most` reaches the
    other's size. A bucket is cut where no `most` so far reaches the next size, and a document whose own `most` is below
    its size stays only if a size so small is there. So what unrelated documents happen to share is mostly left out.
    """
    w = Window.partitionBy("key").orderBy("n", "doc")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    begins = F.coalesce(F.max("most").over(w.rowsBetween(Window.unboundedPreceding, -1)) < F.col("n"), F.lit(True))
    rows = index.withColumns({"begins": begins, "after": F.lead("n").over(w)}).withColumn("start", F.max(F.when(F.col("begins"), F.col("n"))).over(so_far))
    rows = rows.where(F.when(F.col("begins"), F.col("after") <= F.col("most")).otherwise(F.col("start") <= F.col("most")))
    run = Window.partitionBy("key", "start").orderBy("n", "doc")
    rows = rows.withColumns({"prev": F.lag("doc").over(run), "next": F.lead("doc").over(run)}).where("prev is not null or next is not null")
    return rows.select(F.xxhash64("key", "start").alias("key"), "doc", "prev")


def _bounded(ids: DataFrame) -> DataFrame:
    """Broadcast up to BROADCAST_IDS rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _exact(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, by counting their sets' intersections."""
    pairs = common.stored(pairs, "jaccard-pairs")
    ids = common.stored(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "jaccard-ids")
    wanted = docs.join(_bounded(ids), "doc", "left_semi")

    def sets(batches):
        common.holds("jaccard")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc"), pa.array([s.tobytes() for s in shingle_sets(common.texts(common.column(batch, "text")))], pa.binary())], names=["doc", "s"])

    tokens = common.stored(wanted.mapInArrow(sets, "doc long, s binary").dropDuplicates(["doc"]), "jaccard-sets")
    both = pairs.join(tokens.select(F.col("doc").alias("a"), F.col("s").alias("sa")), "a").join(tokens.select(F.col("doc").alias("b"), F.col("s").alias("sb")), "b")

    def count(batches):
        for batch in batches:
            ok = []
            for x, y in zip(common.column(batch, "sa"), common.column(batch, "sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                ok.append(len(np.intersect1d(x, y, assume_unique=True)) >= needed(len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = common.stored(both.select("a", "b", "sa", "sb").mapInArrow(count, "a long, b long"), "jaccard-links")
    common.drop(pairs, ids, tokens)
    return links


def _closest(buckets: DataFrame, signatures: DataFrame) -> DataFrame:
    """Of each document's neighbours before it in the index (by size), the NEIGHBOURS that are so under the most keys; of these, the two with the most similar bitmaps."""
    pairs = buckets.where("prev is not null").groupBy(F.col("prev").alias("a"), F.col("doc").alias("b")).agg(F.count("*").alias("n"))
    pairs = pairs.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))).where(F.col("k") <= NEIGHBOURS).select("a", "b")
    left, right = (signatures.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    found = common.stored(pairs, "jaccard-neighbours")
    pairs = found.join(left, "a").join(right, "b").where("5 * na >= 4 * nb and 5 * nb >= 4 * na").select("a", "b", "na", "nb", "bitsa", "bitsb")

    def run(batches):
        for batch in batches:
            keep, far = [], []
            for na, nb, x, y in zip(*(common.column(batch, c).to_pylist() for c in ("na", "nb", "bitsa", "bitsb"))):
                d = int(least_difference(np.frombuffer(x, np.uint8)[None], np.frombuffer(y, np.uint8)[None])[0])
                keep.append(d <= na + nb - 2 * needed(na, nb))
                far.append(d / (na + nb))
            out = pa.RecordBatch.from_arrays([common.column(batch, "a"), common.column(batch, "b"), pa.array(far, pa.float64())], names=["a", "b", "far"])
            yield out.filter(pa.array(keep, pa.bool_()))

    near = pairs.mapInArrow(run, "a long, b long, far double")
    out = common.stored(near.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("far", "a"))).where("k <= 2").select("a", "b"), "jaccard-closest")
    common.drop(found)
    return out


def _block_pairs(group, own, i, j, n, root):
    """Row numbers (x, y) of the pairs of equal groups, of different components, of sizes that may link; rows are sorted by group and n."""
    for gap in range(1, len(group)):
        x = np.flatnonzero(group[gap:] == group[:-gap])
        if not len(x):
            return
        y = x + gap
        ok = (root[x] != root[y]) & (5 * n[x] >= 4 * n[y]) & ((i[x] == j[x]) | (own[x] != own[y]))
        if ok.any():
            yield x[ok], y[ok]


def possible_pairs(group, own, i, j, doc, root, n, bits: list[bytes]):
    """(doc, doc, root, root, share of differing bits) of pairs that bitmaps don't rule out."""
    order = np.lexsort((doc, n, group))
    group, own, i, j, doc, root, n = (z[order] for z in (group, own, i, j, doc, root, n))
    bits = [bits[k] for k in order.tolist()]
    width = np.fromiter(map(len, bits), np.int64, len(bits))
    row, maps = np.zeros(len(bits), np.int64), {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        row[at] = np.arange(len(at))
        maps[w] = np.frombuffer(b"".join(bits[k] for k in at.tolist()), np.uint8).reshape(-1, w)
    for x, y in _block_pairs(group, own, i, j, n, root):
        kinds = width[x] * (1 << 32) + width[y]
        for kind in np.unique(kinds).tolist():
            m = np.flatnonzero(kinds == kind)
            wx, wy = kind >> 32, kind & 0xFFFFFFFF
            for c in range(0, len(m), 1 << 14):
                p, q = x[m[c : c + (1 << 14)]], y[m[c : c + (1 << 14)]]
                d = least_difference(maps[wx][row[p]], maps[wy][row[q]])
                both = n[p] + n[q]
                ok = d <= both - 2 * -(-4 * both // 9)
                p, q = p[ok], q[ok]
                flip = doc[p] > doc[q]
                p, q = np.where(flip, q, p), np.where(flip, p, q)
                yield doc[p], doc[q], root[p], root[q], d[ok] / both[ok]


def _across(buckets: DataFrame, signatures: DataFrame, roots: DataFrame, best: bool) -> tuple[DataFrame, DataFrame]:
    """(a, b, ra, rb, far): the pairs of buckets that are in different components ra, rb and that bitmaps don't rule out; or of any two components the best that each task has.

    And the buckets' rows of documents that are in such a pair at all. As components only grow, later rounds find no pair of others.

    Buckets with the same smallest component have much the same documents: up to TASK_ROWS rows they go to one task
    together, where each document's bitmap is needed once; larger sets of buckets are dealt out by block.
    """
    rows = buckets.select("key", "doc").join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").select("key", "doc", F.coalesce("root", "doc").alias("root"))
    rooted = common.stored(rows, "jaccard-rooted")
    keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("docs"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y")).where("low < high")
    blocks = F.ceil(F.col("docs") / BLOCK_DOCS).cast("int")
    keys = common.stored(keys.groupBy("docs", "x", "y").agg(F.min("key").alias("key"), F.min("low").alias("low")).select("key", "low", "docs", blocks.alias("blocks")), "jaccard-keys")  # buckets of the same documents once
    work = keys.agg(F.sum(F.col("docs") * F.col("blocks"))).first()[0] or 0
    parts = work // TASK_ROWS + 1
    together = keys.groupBy("low").agg(F.sum(F.col("docs") * F.col("blocks")).alias("work")).where(F.col("work") <= TASK_ROWS).select("low", F.xxhash64("low").alias("home"))
    rows = rooted.join(keys.join(together, "low", "left").drop("docs", "low"), "key")
    own = F.pmod(F.xxhash64("doc", F.lit(2)), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    rows = rows.select("key", "doc", "root", "home", own.alias("own"), F.explode(F.array_distinct(others)).alias("block"))
    group = F.xxhash64("key", "block")
    rows = rows.select(F.coalesce("home", group).alias("home"), "doc", "root", F.struct(group.alias("group"), "own", "block.i", "block.j").alias("place"))
    rows = rows.groupBy("home", "doc").agg(F.min("root").alias("root"), F.collect_list("place").alias("places"))
    rows = rows.join(signatures.select("doc", "n", "bits"), "doc").withColumn("part", F.pmod("home", F.lit(parts)))

    def run(key, table):
        table = table.combine_chunks()
        places = table.column("places").combine_chunks()
        row = np.repeat(np.arange(table.num_rows), places.value_lengths().to_numpy())
        group, own, i, j = (places.flatten().field(c).to_numpy() for c in ("group", "own", "i", "j"))
        doc, root, n = (table.column(c).to_numpy()[row] for c in ("doc", "root", "n"))
        bits = table.column("bits").to_pylist()
        found = list(possible_pairs(group, own, i, j, doc, root, n, [bits[r] for r in row.tolist()]))
        names = ("a", "b", "ra", "rb", "far")
        a, b, ra, rb, far = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(5))
        by = (far, np.maximum(ra, rb), np.minimum(ra, rb)) if best else (far, b, a)
        order = np.lexsort(by)
        once = np.ones(len(order), bool)  # the same pair stands under many keys
        once[1:] = np.any([np.diff(z[order]) != 0 for z in by[1:]], axis=0)
        at = order[once]
        pairs = pa.table({c: pa.array(z[at], pa.float64() if c == "far" else pa.int64()) for c, z in zip(names, (a, b, ra, rb, far))})
        docs = pa.array(np.unique(np.concatenate([a, b])), pa.int64())
        return pa.concat_tables([pairs, pa.table({"a": docs} | {c: pa.nulls(len(docs), pairs.schema.field(c).type) for c in names[1:]})]) if best else pairs

    found = common.stored(rows.groupBy("part").applyInArrow(run, "a long, b long, ra long, rb long, far double"), "jaccard-found")
    pairs = found.where("b is not null").groupBy("a", "b").agg(F.min("ra").alias("ra"), F.min("rb").alias("rb"), F.min("far").alias("far"))
    out = common.stored(pairs, "jaccard-across")
    if best:
        buckets = common.stored(buckets.join(_bounded(found.where("b is null").select(F.col("a").alias("doc")).distinct()), "doc", "left_semi").select("key", "doc"), "jaccard-buckets")
    common.drop(rooted, keys, found)
    return out, buckets


def _verified_across(pairs: DataFrame, links: DataFrame, docs: DataFrame) -> DataFrame:
    """links and as many more as connect what the pairs connect: the likeliest pairs of two components are tried first."""
    tries = 1
    while not common.is_empty(pairs):
        w = Window.partitionBy(F.least("ra", "rb"), F.greatest("ra", "rb")).orderBy("far", "a", "b")
        ranked = common.stored(pairs.withColumn("k", F.row_number().over(w)), "jaccard-ranked")
        links = common.stored(links.union(_exact(ranked.where(F.col("k") <= tries).select("a", "b"), docs)), "jaccard-links")
        roots = components(links)
        left, right = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        rest = ranked.where(F.col("k") > tries).select("a", "b", "far").join(left, "a", "left").join(right, "b", "left")
        old, pairs = pairs, common.stored(rest.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"), "far").where("ra <> rb"), "jaccard-across")
        common.drop(old, ranked, roots)
        tries *= 16
    common.drop(pairs)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest identifier of the component) of every row. Identifiers are integers."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must be an integer column, not {kind.simpleString()}: give rows numbers and join the result to them")
    docs = common.clean_columns(docs, doc=id_col, text=text_col).select(F.col("doc").cast("long").alias("doc"), "text")
    signatures = _signatures(docs)
    often = _frequent_filter(signatures)
    rows = signatures.where("n is not null").select("doc", "n", "d1", "d2", "bits")
    sets = common.stored(rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc").alias("first"), F.count("*").alias("docs")).where("docs > 1").select("n", "d1", "d2", "first"), "shingle-sets")
    members = rows.select("doc", "n", "d1", "d2").join(sets, ["n", "d1", "d2"], "left").select("doc", "n", F.coalesce("first", "doc").alias("first"))
    members = common.stored(members, "shingle-members")
    named = docs.where("doc is not null")
    nodes = members.where("doc is not null").groupBy("doc").agg(F.min("first").alias("low"), F.max("first").alias("high"))
    nodes = common.stored(nodes.where("low < doc"), "shingle-copies")
    copies = nodes.where("high < doc").select("doc")
    buckets = common.stored(_buckets(_index(named.join(_bounded(copies), "doc", "left_anti"), often)), "shingle-index")
    first = common.stored(rows.where("doc is not null").join(_bounded(copies), "doc", "left_anti").select("doc", "n", "bits").dropDuplicates(["doc"]), "shingle-bitmaps")
    several = members.join(nodes.where("low < high").select("doc"), "doc", "left_semi").select(F.col("first").alias("a"), F.col("doc").alias("b"))
    several = common.stored(several, "jaccard-links")  # one identifier on rows of different texts
    common.drop(signatures, sets, nodes)
    closest = _closest(buckets, first)
    links = _exact(closest, named).union(several)
    for _ in range(BEST_ROUNDS):
        roots, old = components(links), buckets
        pairs, buckets = _across(buckets, first, roots, best=True)
        found = _exact(pairs.select("a", "b"), named)
        common.drop(roots, pairs, old)
        if common.is_empty(found):
            break
        links = common.stored(links.union(found), "jaccard-links")
    roots = components(links)
    links = _verified_across(_across(buckets, first, roots, best=False)[0], links, named)
    common.drop(closest, roots, buckets, first)
    out = members.join(components(links).select(F.col("node").alias("first"), "root"), "first", "left")
    return out.select(F.col("doc").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "first").cast(kind).alias("component_id"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))


#: The contract in SQL: shingles as texts, pairs by shared shingles, components by what is reachable.
SQL = r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[s : s + 4], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS s FROM split WHERE len(ws) > 0)),
sets AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_common FROM shingles a JOIN shingles b USING (x) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 5 * n_common >= 4 * (p.n + q.n - n_common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM split UNION SELECT r.a, w.b FROM reached r JOIN ways w ON r.b = w.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY 1) LEFT JOIN sets USING (doc_id)
"""
