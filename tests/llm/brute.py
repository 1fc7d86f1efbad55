"""The contracts word by word and byte by byte, for comparison."""

import hashlib
import re

import xxhash

WINDOW, LENGTH = 13, 400


def contaminated(documents: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract word by word, for tests."""
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = []
    for doc_id, text in documents:
        ws, hit, ids = split(text), set(), set()
        for item_id, item in items:
            iw = split(item)
            n = min(window, len(iw))
            for s in range(len(iw) - n + 1 if n else 0):
                for p in range(len(ws) - n + 1):
                    if ws[p : p + n] == iw[s : s + n]:
                        hit.update(range(p, p + n))
                        ids.add(str(item_id))
        out.append((doc_id, len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


def removed(rows: list[tuple], length: int = LENGTH) -> list[tuple]:
    """The contract byte by byte, for tests."""
    seen: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, d in data:
        for s in range(len(d) - length + 1):
            k = xxhash.xxh3_128_digest(d[s : s + length])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for i, d in data:
        keep = bytearray(b"\x01" * len(d))
        for s in range(len(d) - length + 1):
            if seen[xxhash.xxh3_128_digest(d[s : s + length])] > 1:
                keep[s : s + length] = bytes(length)
        spans = sum(1 for k in range(len(d)) if not keep[k] and (k == 0 or keep[k - 1]))
        out.append((i, len(d), keep.count(0), spans, hashlib.sha256(bytes(b for b, k in zip(d, keep) if k)).hexdigest()))
    return out
