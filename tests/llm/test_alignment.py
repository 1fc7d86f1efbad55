"""Operator 13 against a sequential version that compares all token ranges of a document."""

import functools
import hashlib
from collections import Counter

import public_tokenizers

from tonearm.llm import alignment
from tonearm.llm.bpe import byte_of_char

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    return library, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text):
    """(A ids and bytes, B ids and bytes); empty if either side does not give space + text back."""
    library, model = tokenizers()
    if not text:
        return [], []
    a = [(i, bytes(byte_of_char()[c] for c in library.id_to_token(i))) for i in library.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()) for i in model.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(t for _, t in a) == whole == b"".join(t for _, t in b) else ([], [])


def ranges(side):
    out, at = [], 0
    for i, t in side:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def sequential(rows):
    held, links, counts = [], [], Counter()
    for _, text in rows:
        a, b = map(ranges, tokens(text))
        mine = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e] if len(a) < 2000 else None
        if mine is None:
            mine, k = [], 0
            for i, s, e in a:
                while b[k][2] <= s:
                    k += 1
                m = k
                while m < len(b) and b[m][1] < e:
                    mine.append((i, b[m][0]))
                    m += 1
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        parts, start = [], 0
        for end in ends:
            parts.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)) if len(a) < 2000 else "")
            start = end
        held.append((len(a), len(b), len(ends), ";".join(parts)))
        links.append(mine)
        counts.update(set(mine))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    return [(d, *h[:3], len(l), sum(counts[p] == best[p[0]] for p in l), sum(counts[p] for p in l), hashlib.sha256(h[3].encode()).hexdigest() if h[0] else "") for (d, _), h, l in zip(rows, held, links)]


TEXTS = ["Hello world, this is a test.", "Hello world, this is a test.", "  two  spaces \n\n and\ttabs  ", " ", "", None, "x", "▁marked", "<|endoftext|> and </s> <s> <unk> <0x41>", "Größe naïve 東京は大きい 😀😀 é", "a" * 300, " wide　space ", "The quick brown fox; the Quick brown fox?! 12345 3.14", "\x00\x01 control", "don't can't I'll", " lead", "trail ", "\r\n\r\n", "नमस्ते दुनिया"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_against_sequential(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "Hello world"), (None, "no id here"), (2**60 + 1, "a large id")]
    docs = spark.createDataFrame([(d, t, "c", b"p", 1) for d, t in rows], "doc_id long, text string, chunk string, pairs binary, slot int").repartition(3)
    want = sorted(sequential(rows), key=str)
    assert rows_of(alignment.align_corpus(docs)[0]) == want
    out, pairs = alignment.align_corpus(docs, with_groups=True)
    assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 for r in out.collect())
    assert pairs.count() == pairs.select("a_id", "b_id").distinct().count()
    top = {r.a_id: r.m for r in pairs.groupBy("a_id").agg({"n_docs": "max"}).withColumnRenamed("max(n_docs)", "m").collect()}
    assert all(r.best_a == (r.n_docs == top[r.a_id]) for r in pairs.collect())


def test_chunks(spark, monkeypatch):
    """Many chunks and groups of texts in one partition give the same rows."""
    rows = [(k, f"{TEXTS[k % 5] or ''} {k % 7} again and again") for k in range(60)] + [(60, "word and " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    small = alignment._aligned
    monkeypatch.setattr(alignment, "_aligned", lambda d, *a: small(d.repartition(7, "doc_id"), *a))
    got = rows_of(alignment.align_corpus(docs)[0])
    monkeypatch.undo()
    assert got == rows_of(alignment.align_corpus(docs)[0])
    want = sequential(rows)
    assert [g[:7] for g in got] == sorted((w[:7] for w in want), key=str)


def test_empty(spark):
    assert alignment.align_corpus(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0
    assert rows_of(alignment.align_corpus(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))[0]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
