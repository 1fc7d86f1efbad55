"""Token ids in binary files: canonical length-limited Huffman codes from global counts, decoded by tables in independent blocks.

A token file is a folder of Parquet tables: `blocks` (whole documents each, in ascending document order: their
identifiers and lengths, where the block starts in the corpus, the packed code bits, and the bit offset of every
LANE-th symbol) and `codebook` (id, code length; canonical codes follow from lengths). From the bit offsets a
block's lanes are decoded side by side, and a reader may begin at any lane.

Documents are encoded where they lie. Only if the input's partitions overlap or are out of order do packed ids
move, once, by ranges of the identifier.

Defined results: a null text is the empty text and still ends with the end id; null identifiers come first; rows
that repeat are written each; an empty table makes a file without blocks.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import common
from .bpe import default_path
from .chunks import ChunkEncoder, cuttable, in_lines, interleave

END_ID = 0
LIMIT = 20
BLOCK_TOKENS = 1 << 18
LANE = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves, level, is_leaf = counts[order].astype(np.int64), counts[order].astype(np.int64), []
    is_leaf.append(np.ones(len(leaves), bool))
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        is_leaf.append(by < len(leaves))
        level = both[by]
    take = 2 * len(leaves) - 2
    for flags in reversed(is_leaf):
        n = int(flags[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes counted up in order of (length, id)."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.argsort(lengths[used], kind="stable")].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


class Coder:
    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths, canonical_codes(lengths)
        self.limit = max(1, int(lengths.max(initial=1)))
        self._tables = None

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For each value of the next limit bits: its symbol and that symbol's length."""
        if self._tables is None:
            symbol, size = np.zeros(1 << self.limit, np.uint32), np.ones(1 << self.limit, np.uint8)
            used = np.flatnonzero(self.lengths)
            used = used[np.argsort(self.lengths[used], kind="stable")]
            spans = np.left_shift(1, self.limit - self.lengths[used])
            symbol[: spans.sum()], size[: spans.sum()] = np.repeat(used, spans), np.repeat(self.lengths[used], spans)
            self._tables = symbol, size
        return self._tables

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Packed bits, and the bit offset of every LANE-th symbol."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        at = ends - size
        word, room = at >> 5, (64 - size - (at & 31)).astype(np.uint64)
        wide = self.codes[ids] << room
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(ends[-1] >> 5) + 3 if len(ids) else 2, np.uint64)
        if len(ids):
            out[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
            out[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes(), at[::LANE].astype(np.int64)

    def decode(self, payload: bytes, lanes: np.ndarray, n: int, first_lane: int = 0) -> np.ndarray:
        """n ids from the start of first_lane on; all lanes step together."""
        symbol, size = self.tables()
        b = np.frombuffer(payload, np.uint8).astype(np.uint32)
        window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        at = np.array(lanes[first_lane : first_lane + -(-n // LANE)], np.int64)
        out = np.zeros((LANE, len(at)), np.uint32)
        shift, mask, last = 32 - self.limit, (1 << self.limit) - 1, len(window) - 1
        for k in range(min(LANE, n)):
            peek = (window[np.minimum(at >> 3, last)] >> (shift - (at & 7)).astype(np.uint32)) & mask
            out[k] = symbol[peek]
            at += size[peek]
        return out.T.ravel()[:n]


class LibraryEncoder:
    """The tokenizers library's encoding of distinct pieces; those that are words go to it as lines of one text."""

    LINES = 512
    _built: dict[str, LibraryEncoder] = {}

    def __init__(self, path: str, plain: bool = False):
        """plain: special tokens' strings in texts are text like any other."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.n_ids = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.n_ids <= 1 << 16 else "<u4")
        self.added = self.library.get_added_tokens_decoder()
        self.special = () if plain else tuple(a.content for a in self.added.values())
        self.library.encode_special_tokens = plain
        cut = cuttable(self.library.to_str())
        self.line = self._encode(["\n"])[0] if cut else []
        self.encoder = ChunkEncoder(self.encode_many, self.dtype, self.special, cut)

    @classmethod
    def of(cls, path: str) -> LibraryEncoder:
        common.holds("library", cls._built.clear)
        if path not in cls._built:
            cls._built.clear()
            cls._built[path] = cls(path)
        return cls._built[path]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_many(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ok = in_lines(pieces, self.special) if len(self.line) == 1 else np.zeros(len(pieces), bool)
        lines = pieces.filter(pa.array(ok)).cast(pa.large_string()).to_pylist()
        coded = self._encode(["\n".join(lines[k : k + self.LINES]) + "\n" for k in range(0, len(lines), self.LINES)])
        flat = np.array([i for x in coded for i in x], self.dtype)
        ends = np.flatnonzero(flat == (self.line or [0])[0])
        sizes = np.diff(ends, prepend=-1) - 1
        others = self._encode([x.decode() for x in pieces.filter(pa.array(~ok)).to_pylist()])
        return interleave(len(pieces), ok, (np.delete(flat, ends), sizes), others, self.dtype)


_ENCODED = "part int, seq long, doc_id {kind}, n_tokens long, local_start long, ids binary, low {kind}, high {kind}, total long, ordered boolean, counts binary"


def _summary(schema, part, low, high, total, ordered, counts) -> pa.RecordBatch:
    values = {"part": part, "low": low, "high": high, "total": total, "ordered": ordered, "counts": counts}
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


def _numbered(rows, schema):
    """rows: batches of (doc_ids, packed ids, width in bytes). Adds each row's place in its partition, and a last row that sums the partition up."""
    part, seq, total, low, high, ordered, counts = TaskContext.get().partitionId(), 0, 0, None, None, True, None
    for doc_ids, packed, width, counted in rows:
        n = [len(x) // width for x in packed]
        starts = np.cumsum([total, *n])
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array(range(seq, seq + len(n)), pa.int64()), pa.array(doc_ids, schema.field("doc_id").type), pa.array(n, pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(packed, pa.binary()), *(pa.nulls(len(n), schema.field(c).type) for c in ("low", "high", "total", "ordered", "counts"))], schema=schema)
        for d in doc_ids:
            ordered = ordered and d is not None and (high is None or d >= high)
            if d is not None:
                low, high = d if low is None else min(low, d), d if high is None else max(high, d)
        seq, total = seq + len(n), int(starts[-1])
        counts = counted if counts is None else counts + counted if counted is not None else counts
    if seq:
        yield _summary(schema, part, low, high, total, ordered, None if counts is None else counts.tobytes())


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode every text, append end_id, and write the token file at path."""
    spark = docs.sparkSession
    docs = common.clean_columns(docs, doc_id=id_col, text=text_col)
    ddl = _ENCODED.format(kind=docs.schema["doc_id"].dataType.simpleString())
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    tokenizer = tokenizer or default_path()

    def encode(batches):
        library = LibraryEncoder.of(tokenizer)
        dtype, n_ids = library.dtype, library.n_ids
        end = np.array([end_id], dtype).tobytes()

        def rows():
            for batch in batches:
                packed = [x + end for x in library.encoder.packed(common.column(batch, "text"))]
                yield common.column(batch, "doc_id").to_pylist(), packed, dtype.itemsize, np.bincount(np.frombuffer(b"".join(packed), dtype), minlength=n_ids)

        yield from _numbered(rows(), schema)

    encoded = common.stored(docs.mapInArrow(encode, ddl), "token-ids")
    lengths, width = _code_lengths(encoded)
    parts = _parts(encoded)
    if not _in_order(parts):

        def renumber(batches):
            yield from _numbered(((common.column(b, "doc_id").to_pylist(), common.column(b, "ids").to_pylist(), width, None) for b in batches), schema)

        moved = encoded.where("seq is not null").select("doc_id", "part", "seq", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "part", "seq")
        encoded = common.stored(moved.mapInArrow(renumber, ddl), "token-ids-ordered")
        parts = _parts(encoded)
    offsets, at = {}, 0
    for p in sorted(parts, key=lambda p: (p["low"] is not None, p["low"] if p["low"] is not None else 0, p["part"])):
        offsets[p["part"]], at = at, at + p["total"]
    book = spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int")
    book.coalesce(1).write.parquet(f"{path}/codebook")
    _blocks(encoded, lengths, offsets, width).write.option("compression", "none").parquet(f"{path}/blocks")


def _parts(encoded: DataFrame) -> list:
    """One row for each partition of the table."""
    return encoded.where("total is not null").select("part", "low", "high", "total", "ordered").collect()


def _in_order(parts: list) -> bool:
    if not all(p["ordered"] for p in parts):
        return False
    parts = sorted(parts, key=lambda p: (p["low"], p["high"]))
    return all(a["high"] < b["low"] for a, b in zip(parts, parts[1:]))


def _code_lengths(encoded: DataFrame) -> tuple[np.ndarray, int]:
    """Lengths from the counts of all partitions, summed in Spark to one row an id; and the bytes of an id."""

    def spread(batches):
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total = np.frombuffer(x, np.int64) + (0 if total is None else total)
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64()), pa.array(np.full(len(used), len(total)), pa.int32())], names=["id", "n", "ids"])

    rows = encoded.where("counts is not null").select("counts").mapInArrow(spread, "id int, n long, ids int").groupBy("id").agg(F.sum("n").alias("n"), F.max("ids").alias("ids")).collect()
    n_ids = max((r["ids"] for r in rows), default=1)
    counts = np.zeros(n_ids, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return code_lengths(counts), 2 if n_ids <= 1 << 16 else 4


def _blocks(encoded: DataFrame, lengths: np.ndarray, offsets: dict[int, int], width: int) -> DataFrame:
    kind = encoded.schema["doc_id"].dataType.simpleString()
    ddl = f"start long, n_tokens long, doc_ids array<{kind}>, sizes array<bigint>, lanes array<bigint>, payload binary"
    schema, dtype = to_arrow_schema(_parse_datatype_string(ddl)), np.dtype("<u2" if width == 2 else "<u4")

    def run(batches):
        coder, held, n, begin = Coder(lengths), [], 0, None

        def flush():
            ids = np.frombuffer(b"".join(x for _, x in held), dtype)
            payload, lanes = coder.encode(ids)
            values = begin[1], n, [d for d, _ in held], [len(x) // width for _, x in held], lanes.tolist(), payload
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        for batch in batches:
            for part, start, doc_id, ids in zip(*(common.column(batch, c).to_pylist() for c in ("part", "local_start", "doc_id", "ids"))):
                if held and (part != begin[0] or n >= BLOCK_TOKENS):
                    yield flush()
                    held, n = [], 0
                if not held:
                    begin = part, offsets[part] + start
                held.append((doc_id, ids))
                n += len(ids) // width
        if held:
            yield flush()

    return encoded.where("seq is not null").select("part", "local_start", "doc_id", "ids").mapInArrow(run, ddl)


def _coder(spark: SparkSession, path: str) -> Coder:
    rows = spark.read.parquet(f"{path}/codebook").collect()
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        lengths[r["id"]] = r["length"]
    return Coder(lengths)


def _decoded(spark: SparkSession, path: str, extra: str, of):
    """doc_id, start, n_tokens of each document, and of(ids)."""
    blocks, lengths = spark.read.parquet(f"{path}/blocks"), _coder(spark, path).lengths
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    ddl = f"doc_id {kind}, start long, n_tokens long, {extra}"
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches):
        coder = Coder(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                start, n, doc_ids, sizes, lanes, payload = (common.column(batch, c)[k].as_py() for c in ("start", "n_tokens", "doc_ids", "sizes", "lanes", "payload"))
                ids = coder.decode(payload, np.array(lanes, np.int64), n)
                ends = np.cumsum([0, *sizes])
                yield common.batch_of(schema, doc_ids, start + ends[:-1], sizes, [of(ids[a:b]) for a, b in zip(ends, ends[1:])])

    return blocks.select("start", "n_tokens", "doc_ids", "sizes", "lanes", "payload").mapInArrow(run, ddl)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids array<int>."""
    return _decoded(spark, path, "ids array<int>", lambda ids: ids.astype(np.int32).tolist())


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 as decoded from the file."""
    return _decoded(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()))


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    path = common.scratch_path(spark, "tokens")
    write_tokens(docs, path)
    return token_digests(spark, path)
