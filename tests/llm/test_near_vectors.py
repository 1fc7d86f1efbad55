"""Operator 12 against all pairs, with groups of near and exact copies, odd vectors, and many small blocks."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.llm import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def sequential(rows, threshold=0.95):
    vectors = [np.array(v, np.float32).astype(float) if v and None not in v and np.isfinite(v).all() and np.any(v) else None for _, v in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(vectors):
        for j, y in enumerate(vectors[:i]):
            if x is not None and y is not None and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                n[i], n[j] = n[i] + 1, n[j] + 1
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if find(k) == find(i) and rows[k][0] is not None]
        least = min(ids, default=None)
        out.append((d, n[i], least, d is not None and d == least))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def mixed(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    base[n // 3 : 2 * n // 3] = rng.normal(size=dims) * 3 + rng.normal(size=(2 * n // 3 - n // 3, dims)) * 0.35
    base[2 * n // 3 : 2 * n // 3 + 20] = base[:20] + rng.normal(size=(20, dims)) * 0.3
    base[-5:] = base[0] * 2
    return [(k, v) for k, v in zip(rng.permutation(n).tolist(), base.tolist())]


@pytest.mark.parametrize("dims, least", [(16, 1024), (24, 64), (3, 32)])
def test_against_all_pairs(spark, monkeypatch, dims, least):
    monkeypatch.setattr(near_vectors, "LEAST", least)
    rows = mixed(400, dims)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    want = sequential(rows)
    assert sum(w[1] for w in want) > 1000
    assert rows_of(near_vectors.near_vectors(df)) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0]), (3, [2.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (1, None), (2, []), (4, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.1]), (10, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (11, [-0.0, -1.0]), (12, [0.0, -1.0]), (13, [1e-30, 1e-30]), (14, [1e30, 1e30]), (15, [1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({"data": F.lit(1), "place": F.lit("x"), "copies": F.lit(2), "key": F.lit(0)})
    assert rows_of(near_vectors.near_vectors(df)) == sequential(rows)


def test_empty(spark):
    assert near_vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert rows_of(near_vectors.near_vectors(spark.createDataFrame([(1, None, 0)], SCHEMA))) == [(1, 0, 1, True)]


def test_sql():
    rows = mixed(60, 8) + [(100, None), (101, [0.0] * 8)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, 0)", rows)
    assert sorted(con.execute(near_vectors.SQL).fetchall(), key=str) == sequential(rows)


def test_bounds_keep_every_link():
    """Tiles that are left out, and pairs that end early, hold no link."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 32)) * np.linspace(2, 0.1, 32)
    x[300:450] = x[:150] + rng.normal(size=(150, 32)) * 0.05
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    values, axes = np.linalg.eigh(units.T @ units)
    axes, cuts = axes[:, ::-1], near_vectors.cuts_of(values[::-1])
    order = np.argsort(near_vectors.curve_keys(units @ axes))
    tiles, turned = [], near_vectors.rotated(units[order], axes, cuts)[0]
    for k in range(0, 600, 50):
        part = turned[k : k + 50, : near_vectors.BOX]
        tiles.append({"first": k, "copies": np.ones(50, "<i8").tobytes(), "data": x[order][k : k + 50].astype("<f8").tobytes(), "low": part.min(0), "high": part.max(0)})
    block = near_vectors._Block(tiles, axes, cuts, 32)
    got = {(int(a), int(b)) for r, c in near_vectors._links(block, block, cuts, 0.95, 1e-5) for a, b in zip(r, c)}
    cosine = units[order] @ units[order].T
    assert got == {(a, b) for a in range(600) for b in range(a + 1, 600) if cosine[a, b] >= 0.95}
