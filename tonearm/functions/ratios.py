"""Token-set ratios of many pairs of names at once, exact ones and upper bounds.

Words are numbers in sorted order, so that a pair's shared words and rests come from sorted keys; the common
subsequences of all rests advance together, one character of each pair a step, with 64 places of the longer rest a lane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the tables of character places that are held at once, and buckets of characters for bounds.
TABLE_BYTES, BUCKETS = 32 << 20, 32


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each run, one run behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


def _among(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the sorted keys are among the sorted others."""
    if not len(others):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(others, keys), len(others) - 1)
    return others[at] == keys


def _joined(texts: pa.Array) -> str:
    if not len(texts):
        return ""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return bytes(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]).decode()


class Names:
    """Names as sets of words, which are numbered in order of their characters."""

    def __init__(self, texts: pa.Array):
        parts = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
        flat, owner = parts.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        there = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        coded = flat.filter(pa.array(there)).dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        vocabulary = coded.dictionary.take(pa.array(order))
        self.n_words = max(1, len(order))
        keys = np.sort(owner[there] * self.n_words + rank[coded.indices.to_numpy()])
        owner, self.words = np.divmod(keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys, self.n_words)
        self.sizes = np.bincount(owner, minlength=len(texts))
        self.begins = np.cumsum(self.sizes) - self.sizes
        #: Of a word its characters and a space.
        self.weights = pc.utf8_length(vocabulary).to_numpy().astype(np.int64) + 1 if len(order) else np.ones(1, np.int64)
        self.char_begins = np.cumsum(self.weights) - self.weights
        points = np.full(int(self.weights.sum()), 32, np.uint32)
        points[spread(self.char_begins, self.weights - 1)] = np.frombuffer(_joined(vocabulary).encode("utf-32-le"), np.uint32)
        numbers = np.zeros(int(points.max()) + 1, np.int64)
        numbers[points] = 1
        self.n_chars = int(numbers.sum())
        self.chars = (np.cumsum(numbers) - 1)[points]
        self.totals = np.bincount(owner, self.weights[self.words], len(texts)).astype(np.int64) if len(owner) else np.zeros(len(texts), np.int64)

    def _words(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of the names, and which name each is of."""
        return self.words[spread(self.begins[names], self.sizes[names])], np.repeat(np.arange(len(names)), self.sizes[names])

    def ratios(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """token_set_ratio of the names a[k] and b[k]."""
        out = np.zeros(len(a))
        for k in range(0, len(a), 1 << 15):
            out[k : k + (1 << 15)] = self._ratios(a[k : k + (1 << 15)], b[k : k + (1 << 15)])
        return out

    def _ratios(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = len(a)
        (words_a, of_a), (words_b, of_b) = self._words(a), self._words(b)
        key_a, key_b = of_a * self.n_words + words_a, of_b * self.n_words + words_b
        shared_a, shared_b = _among(key_a, key_b), _among(key_b, key_a)
        total = lambda of, words: np.bincount(of, self.weights[words], n).astype(np.int64)
        both = total(of_a[shared_a], words_a[shared_a])
        left, right = self.totals[a] - both, self.totals[b] - both
        out = np.where((both > 0) & ((left == 0) | (right == 0)), 100.0, 0.0)
        at = np.flatnonzero((left > 0) & (right > 0))
        wanted = np.zeros(n, bool)
        wanted[at] = True
        rests = []
        for words, of, shared in ((words_a, of_a, shared_a), (words_b, of_b, shared_b)):
            own = words[~shared & wanted[of]]
            rests.append(self.chars[spread(self.char_begins[own], self.weights[own])])
        both, left, right = both[at], left[at], right[at]
        common = _subsequences(rests[0], np.cumsum(left) - left, left - 1, rests[1], np.cumsum(right) - right, right - 1, self.n_chars)
        out[at] = _score(both, left, right, common)
        return out

    def histograms(self) -> np.ndarray:
        """How many characters of each bucket a name's words have."""
        place = np.repeat(np.arange(self.n_words), self.weights)
        last = np.zeros(len(self.chars), bool)
        last[self.char_begins + self.weights - 1] = True
        of_word = np.bincount((place * BUCKETS + self.chars % BUCKETS)[~last], minlength=self.n_words * BUCKETS).reshape(-1, BUCKETS)
        out = np.zeros((len(self.sizes), BUCKETS), np.int32)
        filled = self.sizes > 0
        if filled.any():
            out[filled] = np.add.reduceat(of_word[self.words], self.begins[filled], 0)
        return out

    def bounds(self, a: np.ndarray, b: np.ndarray, histograms: np.ndarray) -> np.ndarray:
        """What the ratios of all names a with all names b reach at most, from shared words and counts of characters."""
        both, count = np.zeros((len(a), len(b)), np.int32), np.zeros((len(a), len(b)), np.int32)
        (words_a, of_a), (words_b, of_b) = self._words(a), self._words(b)
        for words, of in ((words_a, of_a), (words_b, of_b)):
            order = np.argsort(words, kind="stable")
            words[:], of[:] = words[order], of[order]
        for word in np.intersect1d(words_a, words_b).tolist():
            rows, columns = (of[slice(*np.searchsorted(words, (word, word + 1)))] for words, of in ((words_a, of_a), (words_b, of_b)))
            at = np.ix_(rows, columns)
            both[at] += self.weights[word]
            count[at] += 1
        least = np.zeros(both.shape, np.int32)
        for k in range(BUCKETS):
            x, y = histograms[a, k], histograms[b, k]
            if x.any() and y.any():
                least += np.minimum.outer(x, y)
        left, right = self.totals[a][:, None] - both, self.totals[b][None, :] - both
        spaces = np.minimum(self.sizes[a][:, None] - count, self.sizes[b][None, :] - count) - 1
        common = np.minimum(least - (both - count) + spaces, np.minimum(left, right) - 1)
        whole = (both > 0) & ((left == 0) | (right == 0))
        some = (left > 0) & (right > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(whole, 100.0, np.where(some, _score(both, left, right, common), 0.0))


def _score(both: np.ndarray, left: np.ndarray, right: np.ndarray, common: np.ndarray) -> np.ndarray:
    """From the characters of the shared words and of either rest, each word with a space, and the rests' common subsequence."""
    gap = both > 0
    same, a, b = both - gap, left - 1, right - 1
    n, m = same + gap + a, same + gap + b
    best = 100 * (1 - (a + b - 2 * common) / (n + m))
    for rest, whole in ((a, n), (b, m)):
        best = np.where(gap, np.maximum(best, 100 * (1 - (gap + rest) / (same + whole))), best)
    return best


def _subsequences(a, begin_a, size_a, b, begin_b, size_b, n_chars) -> np.ndarray:
    """Lengths of the longest common subsequences of the runs of a with those of b; characters are below n_chars."""
    flip = size_a < size_b
    flat = np.concatenate([a, b])
    begin_long, begin_short = np.where(flip, begin_b + len(a), begin_a), np.where(flip, begin_a, begin_b + len(a))
    long, short = np.maximum(size_a, size_b), np.minimum(size_a, size_b)
    out = np.zeros(len(long), np.int64)
    lanes = (long + 63) // 64
    for w in np.unique(lanes).tolist():
        pairs = np.flatnonzero(lanes == w)
        pairs = pairs[np.argsort(-short[pairs], kind="stable")]
        step = max(1, TABLE_BYTES // (8 * w * n_chars))
        for k in range(0, len(pairs), step):
            part = pairs[k : k + step]
            out[part] = _lanes(flat, begin_long[part], long[part], begin_short[part], short[part], n_chars, w)
    return out


def _lanes(flat, begin_long, long, begin_short, short, n_chars, w) -> np.ndarray:
    """Pairs in falling order of short; w lanes of 64 bits hold the longer side's places."""
    n, one = len(long), np.uint64(1)
    table, row = np.zeros((n, n_chars, w), np.uint64), np.arange(n)
    by_long = np.argsort(-long, kind="stable")
    size = long[by_long]
    for k in range(int(size[0])):
        at = by_long[: np.searchsorted(-size, -k, "left")]  # those longer than k
        table[at, flat[begin_long[at] + k], k >> 6] |= one << np.uint64(k & 63)
    bits = np.clip(long[:, None] - 64 * np.arange(w), 0, 64)
    mask = np.where(bits == 64, ~np.uint64(0), (one << (bits % 64).astype(np.uint64)) - one)
    state = mask.copy()
    for k in range(int(short[0])):
        active = int(np.searchsorted(-short, -k, "left"))
        found = table[row[:active], flat[begin_short[:active] + k]]
        old = state[:active]
        used = old & found
        carry = np.zeros(active, np.uint64)
        for lane in range(w):
            total = old[:, lane] + used[:, lane]
            over = total < old[:, lane]
            total = total + carry
            carry = (over | (total < carry)).astype(np.uint64)
            state[:active, lane] = (total | (old[:, lane] - used[:, lane])) & mask[:active, lane]
    return long - np.bitwise_count(state).sum(1).astype(np.int64)


def pair_ratios(a: pa.Array, b: pa.Array) -> np.ndarray:
    """token_set_ratio of each pair of strings; null is empty. Names that repeat are taken apart once."""
    both = pa.concat_arrays([x.cast(pa.large_string()).fill_null("") for x in (a, b)]).dictionary_encode()
    at = both.indices.to_numpy()
    return Names(both.dictionary).ratios(at[: len(a)], at[len(a) :])


def best_pairs(left: pa.Array, right: pa.Array, order: np.ndarray, threshold: float, top: int, tile: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each left name its best `top` right names of at least threshold, ties by order: (left, right, score).

    Pairs are taken by falling bounds, more at a time from round to round, until no bound reaches the last of a name's best.
    """
    names = Names(pa.concat_arrays([left.cast(pa.large_string()), right.cast(pa.large_string())]))
    histograms, columns = names.histograms(), np.arange(len(left), len(left) + len(right))
    for begin in range(0, len(left), tile):
        rows = np.arange(begin, min(begin + tile, len(left)))
        bound = names.bounds(rows, columns, histograms) + 1e-9
        floor, best, quota = np.full(len(rows), float(threshold)), np.full((len(rows), top), -1.0), 2 * top
        found = []
        while True:
            bound[bound < floor[:, None]] = -1
            if not (bound >= 0).any():
                break
            if quota < len(right):
                next_ = np.argpartition(-bound, quota - 1, 1)[:, :quota]
                r, c = np.repeat(np.arange(len(rows)), quota), next_.ravel()
                going = bound[r, c] >= 0
                r, c = r[going], c[going]
            else:
                r, c = np.nonzero(bound >= 0)
            score = names.ratios(rows[r], columns[c])
            bound[r, c] = -1
            kept = score >= np.maximum(threshold, floor[r])
            r, c, score = r[kept], c[kept], score[kept]
            found.append((r, c, score))
            for row in np.unique(r).tolist():
                new = score[slice(*np.searchsorted(r, (row, row + 1)))]
                best[row] = np.sort(np.concatenate([best[row], new]))[::-1][:top]
            floor = np.maximum(floor, best[:, -1])
            quota *= 4
        if not found:
            continue
        r, c, score = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((order[c], -score, r))
        r, c, score = r[by], c[by], score[by]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        kept = place < top
        yield rows[r[kept]], c[kept], score[kept]
