"""Encoding whole texts through their distinct chunks.

A byte-level pre-tokenizer starts a new token wherever white space follows another character, before the last
white space of a run that a character follows, behind that white space unless it is a space (which opens the next
token), and where ASCII punctuation follows an ASCII letter or digit. Texts may be cut at these places and encoded
piece by piece. The cuts are found for a batch of texts at once, the distinct pieces by Arrow's dictionary encoding,
and each distinct piece is encoded once while a worker remembers it.

Defined results: a null text is the empty text, of no pieces. Texts that hold a special token or white space beyond
ASCII, and all texts of tokenizers that are not of this kind, are one piece each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces that a worker remembers, and their bytes; beyond either all are forgotten. Texts are cut in groups of GROUP_BYTES or one text.
MEMO_PIECES, MEMO_BYTES, GROUP_BYTES = 1_000_000, 32 << 20, 1 << 22

_WIDE_SPACE = "\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Pieces of one word with at most a space before it: line feeds between them part them again.
_WORD = f"^ ?[^\\s\\x0b{_WIDE_SPACE}]+$"

_OTHER, _BLANK, _WHITE, _ALNUM, _MARK = range(5)
_KINDS = bytes(_BLANK if b == 32 else _WHITE if 9 <= b <= 13 else _OTHER if not 33 <= b <= 126 else _ALNUM if chr(b).isalnum() else _MARK for b in range(256))


def cuttable(source: str) -> bool:
    """Whether a tokenizer file describes plain byte-level BPE, whose texts may be cut."""
    spec = json.loads(source)
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    tokens = all(not any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized")) for t in spec.get("added_tokens", ()))
    return bool(plain and tokens and model.get("type", "BPE") == "BPE" and not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))


def cuts(data: bytes, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of texts that lie one behind the other, and the end; whole: texts that stay whole."""
    kind = np.frombuffer(data.translate(_KINDS), np.uint8)
    space = (kind == _BLANK) | (kind == _WHITE)
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = (space[1:] & ~space[:-1]) | ((kind[1:] == _MARK) & (kind[:-1] == _ALNUM))
    last = np.zeros(len(data), bool)
    last[:-1] = space[:-1] & ~space[1:]
    last[ends[ends > 0] - 1] = False  # a run at a text's end is one token
    begins[:-1] |= last
    begins[1:] |= last & (kind == _WHITE)
    for k in np.flatnonzero(whole).tolist():
        begins[starts[k] : ends[k]] = False
    begins[starts] = True
    begins[-1] = True
    return np.flatnonzero(begins)


def ragged(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked rows of flat one behind the other, and where each ends."""
    n = sizes[pick]
    ends = np.cumsum(n, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    return flat[np.arange(total, dtype=kind) + np.repeat((begins[pick] - (ends - n)).astype(kind), n)], ends


class ChunkEncoder:
    """encode_many: an array of distinct pieces -> their ids one behind the other, and how many each has."""

    def __init__(self, encode_many: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], dtype: np.dtype, special: tuple[str, ...] = (), cut: bool = True, begins: Callable[[bytes, np.ndarray, np.ndarray, np.ndarray], np.ndarray] = cuts, wide: bool = False):
        """begins: where pieces begin; wide: whether texts with white space beyond ASCII may be cut."""
        self.encode_many, self.dtype, self.cut, self.begins = encode_many, dtype, cut, begins
        self.whole = "|".join([*([] if wide else [f"[{_WIDE_SPACE}]"]), *map(re.escape, special)])
        self.forget()

    def forget(self) -> None:
        self.pieces = pa.array([], pa.large_binary())
        self.ids, self.sizes = np.zeros(0, self.dtype), np.zeros(0, np.int64)

    def _rows(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct pieces the ids of all that are remembered, and each one's begin and size in them."""
        if len(self.pieces) > MEMO_PIECES or self.pieces.nbytes > MEMO_BYTES:
            self.forget()
        at = pc.index_in(pieces, self.pieces).fill_null(-1).to_numpy().copy()
        unknown = at < 0
        if unknown.any():
            new = pieces.filter(pa.array(unknown))
            at[unknown] = len(self.pieces) + np.arange(len(new))  # the pieces are distinct
            ids, sizes = self.encode_many(new)
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.ids, self.sizes = np.concatenate([self.ids, ids.astype(self.dtype)]), np.concatenate([self.sizes, sizes])
        ends = np.cumsum(self.sizes)
        return self.ids, (ends - self.sizes)[at], self.sizes[at]

    def encode(self, texts: pa.Array):
        """Yields (ids of some texts one behind the other, where each text ends) until all texts are done."""
        for group in groups(pc.fill_null(texts.cast(pa.large_string()), "")):
            yield self.encode_group(group)

    def packed(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids as bytes."""
        out = []
        for ids, ends in self.encode(texts):
            data, at = ids.tobytes(), [0, *(ends * ids.itemsize).tolist()]
            out += [data[a:b] for a, b in zip(at, at[1:])]
        return out

    def encode_group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = bytes(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]])
        starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        if not data:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        whole = np.full(len(texts), not self.cut)
        if self.cut and self.whole:
            whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        at = self.begins(data, starts, ends, whole)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        ids, piece_ends = ragged(*self._rows(pieces.dictionary), pieces.indices.to_numpy())
        return ids, np.append(0, piece_ends)[np.searchsorted(at[:-1], ends)]


def in_lines(pieces: pa.Array, special: tuple[str, ...]) -> np.ndarray:
    """Which pieces may be written on lines of their own: one word each, without special tokens."""
    strings = pieces.cast(pa.large_string())
    ok = pc.match_substring_regex(strings, _WORD)
    if special:
        ok = pc.and_(ok, pc.invert(pc.match_substring_regex(strings, "|".join(map(re.escape, special)))))
    return ok.to_numpy(zero_copy_only=False)


def interleave(n: int, ok: np.ndarray, lines: tuple[np.ndarray, np.ndarray], others: list[list[int]], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids and sizes of n pieces in order, from those of the pieces where ok and those of the others."""
    sizes = np.zeros(n, np.int64)
    sizes[ok] = lines[1]
    sizes[~ok] = [len(x) for x in others]
    ids = np.zeros(int(sizes.sum()), dtype)
    mine = np.repeat(ok, sizes)
    ids[mine] = lines[0]
    ids[~mine] = np.array([i for x in others for i in x], dtype)
    return ids, sizes


def groups(texts: pa.Array) -> Iterator[pa.Array]:
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    begin = total = 0
    for k, n in enumerate(sizes.tolist()):
        if k > begin and total + n > GROUP_BYTES:
            yield texts.slice(begin, k - begin)
            begin, total = k, 0
        total += n
    if len(texts) > begin:
        yield texts.slice(begin)
