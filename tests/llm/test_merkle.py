"""Operator 11 against a sequential tree, over blocks and rounds of several sizes, and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tonearm.llm import merkle, order

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, k):
    out = []
    for level in levels[:-1]:
        out.append((k & 1, level[k ^ 1] if k ^ 1 < len(level) else None))
        k >>= 1
    return out


def folded(digest, steps):
    for right, other in steps:
        digest = H(digest) if other is None else H(other, digest) if right else H(digest, other)
    return digest


def sequential(rows):
    runs = {}
    for r in rows:
        runs.setdefault(r[2], []).append(r)
    order = sorted(runs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        runs[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in runs[lang]])
    upper = tree([trees[x][-1][0] for x in order])
    root, out = upper[-1][0], []
    for g, lang in enumerate(order):
        for k, r in enumerate(runs[lang]):
            steps = path(trees[lang], k) + path(upper, g)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            got = folded(leaf(r, 1 if tampered else 0), steps)
            out.append((r[0], leaf(r), trees[lang][-1][0], root, H(*(o for _, o in steps if o)), got, got == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def op(spark, rows, monkeypatch, extra=False):
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    if extra:
        docs = docs.withColumns({"grp": F.lit(1), "key": F.lit("x"), "digest": F.lit(b"y"), "tie": F.lit(0), "part": F.lit(9), "n": F.lit(2)})
    monkeypatch.setattr(merkle.common, "read", lambda *a: docs)
    return rows_of(merkle.op11_merkle(spark, ""))


ODD = [(1, "s", "en", 3, "abc"), (2, None, "en", None, None), (7, "s", None, 0, ""), (7, "s", None, 0, ""), (None, "s", "en", 5, "é日"), (4, "", "", 9, "x" * 100_000), (2**60, "s", "日", -5, "z"), (3, "-", "-", 1, "-"), (9, "s", "en", 1, "t"), (9, "s", "en", 2, "u")]


@pytest.mark.parametrize("block, fan", [(10, 10), (2, 1), (1, 2)])
def test_odd_rows(spark, monkeypatch, block, fan):
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "FAN", fan)
    assert op(spark, ODD, monkeypatch, extra=True) == sequential(ODD)


def test_ragged_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, "s", rng.choice(["en", "en", "en", "de", None, f"x{k % 40}"]), k, f"t{k}") for k in range(700)]
    want = sequential(rows)
    for block, fan, broadcast in ((3, 2, 1000), (10, 10, 0), (4, 3, 0)):
        monkeypatch.setattr(merkle, "BLOCK", block)
        monkeypatch.setattr(merkle, "FAN", fan)
        monkeypatch.setattr(order, "BROADCAST_RUNS", broadcast)
        assert op(spark, rows, monkeypatch) == want
    assert 0 < sum(not r[6] for r in want) < len(want) / 4


def test_one_and_none(spark, monkeypatch):
    assert op(spark, ODD[:1], monkeypatch) == sequential(ODD[:1])
    assert op(spark, [], monkeypatch) == []


def test_proofs_verify(spark):
    docs = spark.createDataFrame(ODD, COLUMNS)
    rows, root = merkle.document_manifest(docs)
    assert all(merkle.fold(r.leaf, r.proof) == root and r.verified for r in rows.collect())


def test_sql(spark, monkeypatch):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents SELECT $1, $5, $3, $2, $4", ODD)
    found = con.execute(merkle.SQL)
    names = [d[0] for d in found.description]
    rows = [dict(zip(names, r)) for r in found.fetchall()]
    want = sequential(ODD)
    assert sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in rows), key=str) == want
