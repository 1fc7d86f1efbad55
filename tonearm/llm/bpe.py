"""Byte-level BPE by speculation: greedy longest match proposes, adjacent pairs are checked, failing words are merged exactly.

A proposal stands if every adjacent pair (a, b) of its tokens is what BPE itself makes of the bytes of a and b
together; a sequence of tokens is its bytes' encoding exactly when all its pairs are. Pairs are checked for a
whole batch at once; verdicts on pairs and encodings of chunks are remembered in each Python worker.

Defined results: a null text is the empty text and has no ids; special tokens' strings in a text become their
ids, as in the library's default; rows that repeat are encoded each; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common
from .chunks import ChunkEncoder, cuttable, in_lines, interleave, ragged

#: The pre-tokenizer's pattern of byte-level BPE: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Verdicts remembered in a worker, and the bytes of a word that lists serve for.
MEMO_PAIRS, SHORT_WORD = 200_000, 48
NEVER = 1 << 40
#: Words merged and ids spelled at once.
MERGED_ROWS, SPELLED_IDS = 8192, 1 << 19
#: Parts words in the search for proposals; no byte is this character.
APART = "\u0100"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """tokens: the bytes of each id; ranks: left id << 32 | right id -> (rank, merged id); special: string -> id."""

    def __init__(self, source: str):
        spec, chars = json.loads(source), byte_of_char()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.tokens[i] = bytes(chars[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[a] << 32 | ids[b]] = rank, ids[a + b]
        self.byte_ids = [ids[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        self.dtype = np.dtype("<u2" if len(self.tokens) <= 1 << 16 else "<u4")
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks, self.pair_ids = (np.array([r[k] for r in self.ranks.values()], np.int64)[order] for k in (0, 1))

    def rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs; rank NEVER where they don't merge. Ids below 0 are no tokens."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        ok = self.pair_keys[at] == keys
        return np.where(ok, self.pair_ranks[at], NEVER), self.pair_ids[at]


class SpeculativeBpe:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        special = set(vocabulary.special.values())
        self.greedy = ahocorasick.Automaton()
        for i, token in enumerate(vocabulary.tokens):
            if token and i not in special:
                self.greedy.add_word(token.decode("latin-1"), i)
        self.greedy.make_automaton()
        self.token_sizes = np.array([len(t) for t in vocabulary.tokens], np.int64)
        self.first_ids = np.array(vocabulary.byte_ids, np.int64)
        self.pairs: dict[int, bool] = {}
        self.sound: dict[int, bool] = {}

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Exact BPE of each word: the adjacent pair of the lowest rank merges first, the leftmost of equals."""
        out: list = [None] * len(words)
        order = sorted((k for k, w in enumerate(words) if len(w) <= SHORT_WORD), key=lambda k: len(words[k]))
        for c in range(0, len(order), MERGED_ROWS):
            part = order[c : c + MERGED_ROWS]
            for k, ids in zip(part, self._merge_rows([words[k] for k in part])):
                out[k] = ids
        return [self._merge_long(w) if ids is None else ids for w, ids in zip(words, out)]

    def _merge_rows(self, words: list[bytes]) -> list[list[int]]:
        """One merge of each word in a step. Rows are padded by -1."""
        sizes, width = np.array([len(w) for w in words]), max(1, len(words[-1]))
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < sizes[:, None], self.first_ids[data], -1)
        ranks, merged = self.v.rank(ids[:, :-1], ids[:, 1:])
        out, rows = np.full_like(ids, -1), np.arange(len(words))
        while len(rows):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            going = ranks[np.arange(len(rows)), best] < NEVER if ranks.shape[1] else np.zeros(len(rows), bool)
            out[rows[~going], : ids.shape[1]] = ids[~going]
            rows, ids, ranks, merged, best = rows[going], ids[going], ranks[going], merged[going], best[going]
            if not len(rows):
                break
            own = np.arange(len(rows))
            new = merged[own, best]
            behind = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, behind + (behind > best[:, None]), axis=1)
            ids[own, best] = new
            behind = np.arange(ranks.shape[1] - 1)
            ranks, merged = (np.take_along_axis(x, behind + (behind >= best[:, None]), axis=1) for x in (ranks, merged))
            for at in (best - 1, best):  # the pairs that the new token is in
                ok = np.flatnonzero((at >= 0) & (at < ranks.shape[1]))
                r, m = self.v.rank(ids[ok, at[ok]], ids[ok, at[ok] + 1])
                ranks[ok, at[ok]], merged[ok, at[ok]] = r, m
        left = (out >= 0).sum(axis=1).tolist()
        return [row[:n] for row, n in zip(out.tolist(), left)]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs over a linked list: n log n in the word's length."""
        ids, get = [self.v.byte_ids[b] for b in data], self.v.ranks.get
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r[0], k, r[1], a, b) for k, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get(a << 32 | b))]
        heapify(heap)
        while heap:
            _, k, merged, a, b = heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue  # one of the two was merged before
            ids[k], ids[j] = merged, -1
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (r := get(ids[left] << 32 | ids[right])):
                    heappush(heap, (r[0], left, r[1], ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words, and each one's word."""
        found = list(self.greedy.iter_long(APART.join(w.decode("latin-1") for w in words)))
        ends, ids = (np.fromiter((f[k] for f in found), np.int64, len(found)) for k in range(2))
        return ids, np.searchsorted(np.cumsum([len(w) + 1 for w in words]), ends, "right")

    def _judge(self, known: dict[int, bool], keys: np.ndarray, tokens: Callable[[int], list[int]]) -> np.ndarray:
        """Whether BPE makes the tokens of each key out of their bytes."""
        keys, back = np.unique(keys, return_inverse=True)
        keys = keys.tolist()
        new = [tokens(k) for k in keys if k not in known]
        if new:
            merged = self.merge([b"".join(map(self.v.tokens.__getitem__, ids)) for ids in new])
            known.update(zip((k for k in keys if k not in known), [a == b for a, b in zip(new, merged)]))
        return np.fromiter(map(known.__getitem__, keys), bool, len(keys))[back]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one behind the other, and how many each has."""
        if len(self.pairs) > MEMO_PAIRS:
            self.pairs = {}
        ids, word = self.propose(words)
        bad = np.bincount(word, self.token_sizes[ids], len(words)) != [len(w) for w in words]
        inside = word[:-1] == word[1:]
        fit = self._judge(self.pairs, (ids[:-1] << 32 | ids[1:])[inside], lambda k: [k >> 32, k & 0xFFFFFFFF])
        bad[word[:-1][inside][~fit]] = True
        bad[word[~self._judge(self.sound, ids, lambda k: [k])]] = True
        again = np.flatnonzero(bad).tolist()
        merged = self.merge([words[k] for k in again])
        stays = ~bad[word]
        sizes = np.bincount(word[stays], minlength=len(words))
        return interleave(len(words), ~bad, (ids[stays], sizes[~bad]), merged, np.int64)

    def encode_many(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one behind the other, and how many each has; pieces of one word are pre-tokenized as lines of one text."""
        ok = in_lines(pieces, tuple(self.v.special))
        lines = pa.array(self.words.findall("\n".join([*pieces.filter(pa.array(ok)).cast(pa.large_string()).to_pylist(), ""])), pa.string()).dictionary_encode()
        index, words = lines.indices.to_numpy(), lines.dictionary.cast(pa.binary()).to_pylist()
        others = [self._split(x.decode()) for x in pieces.filter(pa.array(~ok)).to_pylist()]
        more = [w for parts in others for w in parts if isinstance(w, bytes)]
        ids, sizes = self.encode_words(words + more)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        feed = index == (words.index(b"\n") if words else 0)
        flat, _ = ragged(ids, begins, sizes, index[~feed])
        own = np.bincount(np.cumsum(feed)[~feed], sizes[index[~feed]], int(feed.sum())).astype(np.int64)
        rest = iter([ids[a:b].tolist() for a, b in zip(begins[len(words) :].tolist(), ends[len(words) :].tolist())])
        spelled = [[i for w in parts for i in (next(rest) if isinstance(w, bytes) else [w])] for parts in others]
        return interleave(len(pieces), ok, (flat, own), spelled, np.int64)

    def _split(self, text: str) -> list:
        """Words as bytes and special tokens as ids."""
        parts: list = []
        for k, piece in enumerate(self.specials.split(text)) if self.specials else ((0, text),):
            parts += [self.v.special[piece]] if k % 2 else [w.encode() for w in self.words.findall(piece)]
        return parts

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.v.tokens.__getitem__, ids)).decode("utf-8", "replace")


class Codec:
    """A worker's encoder and decoder; built once for each vocabulary."""

    _built: dict[str, Codec] = {}

    def __init__(self, source: str):
        if not cuttable(source):
            raise ValueError("not a vocabulary of plain byte-level BPE: its normalizer, pre-tokenizer, model or added tokens ask for more")
        self.bpe = SpeculativeBpe(Vocabulary(source))
        self.dtype = self.bpe.v.dtype
        self.encoder = ChunkEncoder(self.bpe.encode_many, self.dtype, tuple(self.bpe.v.special))
        tokens = self.bpe.v.tokens
        self.spellings = [_Rows([b"%d," % i for i in range(len(tokens))]), _Rows(tokens)]

    @classmethod
    def of(cls, source: str) -> Codec:
        common.holds("bpe", cls._built.clear)
        key = hashlib.sha256(source.encode()).hexdigest()
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(source)
        return cls._built[key]

    def encode(self, texts: pa.Array | list) -> list[list[int]]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        return [np.frombuffer(x, self.dtype).tolist() for x in self.encoder.packed(texts)]

    def spelled(self, texts: pa.Array) -> tuple[list[bytes], list[bytes]]:
        """Of each text the ids as decimals with a comma behind each, and the decoded bytes."""
        out: tuple[list, list] = [], []
        for ids, ends in self.encoder.encode(texts):
            for kept, rows in zip(out, self.spellings):
                kept += rows.joined(ids, ends)
        return out


class _Rows:
    """Byte strings of the ids, joined by lists of ids."""

    def __init__(self, rows: list[bytes]):
        self.flat = np.frombuffer(b"".join(rows), np.uint8)
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Up to SPELLED_IDS ids at a time bound the memory."""
        parts, at = [], np.zeros(1, np.int64)
        for c in range(0, len(ids), SPELLED_IDS):
            data, row_ends = ragged(self.flat, self.begins, self.sizes, ids[c : c + SPELLED_IDS])
            parts.append(data.tobytes())
            at = np.concatenate([at, row_ends + at[-1]])
        data, bounds = b"".join(parts), [0, *at[ends].tolist()]
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def read_vocabulary(path: str | None = None) -> str:
    """The vocabulary file's text: a fixed size, so that it may be broadcast."""
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids array<int>."""
    docs = common.clean_columns(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        codec = Codec.of(source.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), pa.array(codec.encode(common.column(batch, "text")), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int> -> doc_id and text; null ids are no ids."""
    encoded = encoded.select("doc_id", "ids")
    kind = encoded.schema["doc_id"].dataType.simpleString()
    source = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        codec = Codec.of(source.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), pa.array([codec.bpe.decode(x or []) for x in common.column(batch, "ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Each document encoded and decoded, as counts and digests: ids and texts need not leave the worker."""
    docs = common.clean_columns(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        codec = Codec.of(source.value)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            ids, decoded = codec.spelled(common.column(batch, "text"))
            text_sha = [sha(x.decode("utf-8", "replace").encode()) for x in decoded]
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), pa.array([x.count(b",") for x in ids], pa.int64()), pa.array([sha(x[:-1]) for x in ids], pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(common.read(spark, sf_dir, "documents"))
