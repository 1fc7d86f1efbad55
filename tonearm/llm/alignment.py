"""Alignment of two tokenizers: groups of tokens with the same bytes, linked tokens, and how often pairs are linked in the corpus.

Both tokenizers encode space + text. The ends of their tokens, in bytes, are merged: the two pointers that walk over the
ends of a batch's tokens are running counts, so they move for all its documents at once. Between two neighbouring ends lie
bytes of one token of each side, which are a link; where both sides end, a group ends. Spark counts the documents of each pair of ids,
takes the maxima of either side, and joins both back to the documents.

Documents lie in chunks of CHUNK_BYTES of text or one document. A document names its pairs by their places in the chunk's
list of distinct pairs, so what is shuffled is a row for each distinct pair of a chunk, not of a document. A frequent pair has
a row for each chunk, as thousands of others do; no key holds a large part of them.

Defined results: texts that are null, empty or do not come back byte for byte from both sides (as those that hold U+2581) have
no tokens: zeros and an empty digest. Special tokens' strings are plain text. Rows that repeat count each; a null
identifier is kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import byte_of_char, default_path
from .chunks import ChunkEncoder, groups, ragged
from .token_files import LibraryEncoder

CHUNK_BYTES = 16 << 20


def default_pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Tokens:
    """The bytes of all tokens of a vocabulary, to join ids, and their ids as text with what stands behind them."""

    def __init__(self, encoder: ChunkEncoder, tokens: list[bytes], inside: str, last: str):
        self.encoder, self.sizes = encoder, np.array([len(t) for t in tokens], np.int64)
        self.flat, self.begins = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(self.sizes) - self.sizes
        self.names = [f"{i}{mark}".encode() for mark in (inside, last) for i in range(len(tokens))]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.flat, self.begins, self.sizes, ids)[0]


def byte_level_tokens(path: str) -> Tokens:
    """Of a byte-level tokenizer file for the tokenizers library."""
    library = LibraryEncoder(path, plain=True)
    back = byte_of_char()
    size = library.library.get_vocab_size()
    tokens = [bytes(back[c] for c in library.library.id_to_token(i)) if i not in library.added else library.library.id_to_token(i).encode() for i in range(size)]
    return Tokens(library.encoder, tokens, ",", "|")


def word_cuts(data: bytes, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Pieces begin at a space behind another character, and at each text."""
    space = np.frombuffer(data, np.uint8) == 32
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = space[1:] & ~space[:-1]
    for k in np.flatnonzero(whole).tolist():
        begins[starts[k] : ends[k]] = False
    begins[starts] = True
    begins[-1] = True
    return np.flatnonzero(begins)


def piece_tokens(path: str) -> Tokens:
    """Of a sentencepiece model that puts a space before each text. Texts are cut at spaces if no piece goes on behind one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    space = model.piece_to_id("▁")
    independent = not any("▁" in p.lstrip("▁") for p in pieces) and model.encode("  a b ", out_type=str) == ["▁▁", "▁a", "▁b", "▁"]

    def encode_many(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = distinct.to_pylist()
        coded = model.encode([t[1:].decode() for t in texts], num_threads=1)
        coded = [[space] if t == b" " else ids for t, ids in zip(texts, coded)]
        return np.array([i for ids in coded for i in ids], np.int32), np.array([len(ids) for ids in coded], np.int64)

    encoder = ChunkEncoder(encode_many, np.dtype(np.int32), cut=independent, begins=word_cuts, wide=True)
    return Tokens(encoder, tokens, ",", ";")


class Aligner:
    _built: dict[tuple[str, str], Aligner] = {}

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_level_tokens(a_path), piece_tokens(b_path)
        self.names = np.array(self.a.names + self.b.names, object)
        self.width = len(self.b.sizes)

    @classmethod
    def of(cls, *paths: str) -> Aligner:
        common.holds("aligner", cls._built.clear)
        if paths not in cls._built:
            cls._built.clear()
            cls._built[paths] = cls(*paths)
        return cls._built[paths]

    def align(self, texts: pa.Array) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, list[bytes]]]:
        """For some texts at a time: numbers for each text, the documents and the id pairs of all links, and each text's groups."""
        filled = pc.fill_null(texts.cast(pa.large_string()), "")
        none, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
        for group in groups(pc.if_else(pc.equal(filled, none), none, pc.binary_join_element_wise(none, filled, space))):
            yield self._align_group(group)

    def _kept(self, side: Tokens, group: pa.Array, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, how many each text has, and whether they give each text's bytes."""
        ids, ends = side.encoder.encode_group(group)
        joined, stops = side.joined(ids), np.append(0, np.cumsum(side.sizes[ids]))[np.append(0, ends)]
        same = np.ones(len(group), bool)
        if not np.array_equal(joined, data):
            same = np.array([b - a == d - c and np.array_equal(joined[a:b], data[c:d]) for a, b, c, d in zip(stops, stops[1:], at, at[1:])], bool)
        return ids, np.diff(ends, prepend=0), same

    def _align_group(self, group: pa.Array):
        offsets = np.frombuffer(group.buffers()[1], np.int64)[group.offset : group.offset + len(group) + 1]
        data = np.frombuffer(group.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        at = offsets - offsets[0]
        (a, n_a, good_a), (b, n_b, good_b) = self._kept(self.a, group, data, at), self._kept(self.b, group, data, at)
        good = good_a & good_b & (np.diff(at) > 0)
        a, b = a[np.repeat(good, n_a)].astype(np.int64), b[np.repeat(good, n_b)].astype(np.int64)
        n_a, n_b, stops = n_a * good, n_b * good, np.cumsum(np.diff(at) * good)
        end_a, end_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        total = int(stops[-1]) if len(stops) else 0
        is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        is_a[end_a], is_b[end_b] = True, True
        passed_a, passed_b, passed = (np.cumsum(x, dtype=np.int32) for x in (is_a, is_b, is_a & is_b))
        ends = np.flatnonzero(is_a | is_b)
        pairs = a[passed_a[ends - 1]] * self.width + b[passed_b[ends - 1]] if total else np.zeros(0, np.int64)
        n_links, n_groups = (np.diff(x[stops], prepend=0) for x in (np.cumsum(is_a | is_b, dtype=np.int32), passed))
        groups_of = self._groups(a, b, end_a, end_b, is_a & is_b, passed_a, passed_b, passed, n_a + n_b)
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links}, np.repeat(np.arange(len(group)), n_links), pairs, groups_of

    def _groups(self, a, b, end_a, end_b, both, passed_a, passed_b, passed, sizes) -> list[bytes]:
        """Each text's groups as text: all tokens of a group's first side, then of its second, as text."""
        before = np.append(0, np.flatnonzero(both))
        names = np.zeros(len(a) + len(b), np.int64)
        if len(names):
            names[np.arange(len(a)) + passed_b[before[passed[end_a - 1]]]] = a + len(self.a.sizes) * both[end_a]
            names[np.arange(len(b)) + passed_a[before[passed[end_b - 1] + 1]]] = 2 * len(self.a.sizes) + b + self.width * both[end_b]
        words, out, done = self.names[names].tolist(), [], 0
        for n in sizes.tolist():
            out.append(b"".join(words[done : done + n])[:-1])
            done += n
        return out


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_ALIGNED = "chunk long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, slots binary, times binary, pairs binary, docs binary"


class _Chunk:
    """Documents whose pairs are named by their places in one list."""

    def __init__(self, key: int):
        self.key, self.rows, self.held, self.bytes = key, [], [], 0

    def add(self, doc_ids, numbers, doc_of, pairs, texts) -> None:
        codes, distinct = pd.factorize(pairs)
        key, times = np.unique(doc_of * max(1, len(distinct)) + codes, return_counts=True)
        doc, code = np.divmod(key, max(1, len(distinct)))
        cut = np.searchsorted(doc, np.arange(1, len(doc_ids)))
        self.held.append((distinct, np.bincount(code, minlength=len(distinct)), len(self.rows), len(doc_ids)))
        digests = (hashlib.sha256(t).hexdigest() if t else "" for t in texts)
        self.rows += zip(doc_ids, *(numbers[c].tolist() for c in _NUMBERS), digests, texts, np.split(code, cut), np.split(times.astype("<i4"), cut))

    def frames(self, with_groups: bool) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _ALIGNED.split(", ")]
        pairs = np.unique(np.concatenate([d for d, _, _, _ in self.held]))
        docs = np.zeros(len(pairs), np.int64)
        for distinct, n, first, size in self.held:
            place = np.searchsorted(pairs, distinct).astype("<i4")
            docs[place] += n
            rows = [(self.key, *r[:6], r[6].decode() if with_groups else None, place[r[7]].tobytes(), r[8].tobytes(), None, None) for r in self.rows[first : first + size]]
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame([(self.key, None, 0, 0, 0, 0, None, None, None, None, pairs.astype("<i8").tobytes(), docs.astype("<i8").tobytes())], columns=columns)


def _aligned(docs: DataFrame, paths: tuple[str, str], with_groups: bool) -> DataFrame:
    """A row for each document, and one for each chunk with its distinct pairs and how many of its documents hold them."""

    def run(frames):
        aligner, n, chunk = Aligner.of(*paths), 0, None
        first = TaskContext.get().partitionId() << 32
        for frame in frames:
            doc_ids, done = frame["doc_id"].tolist(), 0
            texts = pa.array(frame["text"], pa.large_string(), from_pandas=True)
            for numbers, doc_of, pairs, of in aligner.align(texts):
                size = len(of)
                chunk = chunk or _Chunk(first + n)
                chunk.add(doc_ids[done : done + size], numbers, doc_of, pairs, of)
                chunk.bytes += pc.sum(pc.binary_length(texts.slice(done, size))).as_py() or 0
                done += size
                if chunk.bytes >= CHUNK_BYTES:
                    yield from chunk.frames(with_groups)
                    n, chunk = n + 1, None
        if chunk:
            yield from chunk.frames(with_groups)

    return common.stored(docs.mapInPandas(run, _ALIGNED), "aligned")


def _spread(batches):
    """Rows of the chunks' distinct pairs."""
    for batch in batches:
        for chunk, pairs, docs in zip(*(c.to_pylist() for c in batch.columns)):
            pairs, docs = np.frombuffer(pairs, "<i8"), np.frombuffer(docs, "<i8")
            for k in range(0, len(pairs), 1 << 16):
                part = pairs[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(np.arange(k, k + len(part), dtype=np.int32)), pa.array(part), pa.array(docs[k : k + len(part)])], names=["chunk", "slot", "pair", "docs"])


_COUNTED = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, n_best_b long, count_sum long, groups_sha256 string, groups string"


def _gather(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The links of a chunk's documents with the corpus-wide counts of their pairs."""
    schema = pa.schema([(c, pa.string() if kind == "string" else pa.int64()) for c, kind in (x.split() for x in _COUNTED.split(", "))])
    n, best_a, best_b = (np.zeros(counts.num_rows, np.int64) for _ in range(3))
    slot = counts.column("slot").to_numpy()
    for held, name in ((n, "n_docs"), (best_a, "best_a"), (best_b, "best_b")):
        held[slot] = counts.column(name).to_numpy()
    sums = []
    for slots, times in zip(docs.column("slots").to_pylist(), docs.column("times").to_pylist()):
        at, times = np.frombuffer(slots, "<i4"), np.frombuffer(times, "<i4").astype(np.int64)
        sums.append([int(x[at] @ times) for x in (best_a, best_b, n)])
    added = {c: pa.array([s[k] for s in sums], pa.int64()) for k, c in enumerate(("n_best", "n_best_b", "count_sum"))}
    return pa.table([added[f.name] if f.name in added else docs.column(f.name).cast(f.type) for f in schema], schema=schema)


def align_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, with_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).

    documents: a row each with its numbers of tokens, groups and links, how many links are the corpus's most frequent ones of
    their id of side a (n_best) and of side b (n_best_b), the sum of the links' counts, the groups' digest and, if asked for, their text.
    pairs: a_id, b_id, n_docs (documents that hold the pair linked), and whether that is the highest of a_id, and of b_id.
    """
    paths = (a_path or default_path(), b_path or default_pieces_path())
    docs = common.clean_columns(docs, doc_id=id_col, text=text_col)
    kind, width = docs.schema["doc_id"].dataType, len(piece_tokens(paths[1]).sizes)
    aligned = _aligned(docs.withColumn("doc_id", F.col("doc_id").cast("string")), paths, with_groups)
    spread = aligned.where("pairs is not null").select("chunk", "pairs", "docs").mapInArrow(_spread, "chunk long, slot int, pair long, docs long")
    counts = spread.groupBy("pair").agg(F.sum("docs").alias("n_docs"))
    counts = common.stored(counts.select("pair", F.expr(f"pair div {width}").alias("a_id"), (F.col("pair") % width).alias("b_id"), "n_docs"), "pair-counts")
    most_a, most_b = (counts.groupBy(c).agg(F.max("n_docs").alias(f"most_{c}")) for c in ("a_id", "b_id"))
    ranked = counts.join(most_a, "a_id").join(most_b, "b_id")
    ranked = common.stored(ranked.select("pair", "a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("most_a_id")).alias("best_a"), (F.col("n_docs") == F.col("most_b_id")).alias("best_b")), "pair-ranks")
    back = spread.select("chunk", "slot", "pair").join(ranked.select("pair", "n_docs", F.col("best_a").cast("int").alias("best_a"), F.col("best_b").cast("int").alias("best_b")), "pair").drop("pair")
    rows = aligned.where("pairs is null").drop("pairs", "docs")
    out = rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_gather, _COUNTED).withColumn("doc_id", F.col("doc_id").cast(kind))
    return out if with_groups else out.drop("groups"), ranked.drop("pair")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return align_corpus(common.read(spark, sf_dir, "documents"))[0]
