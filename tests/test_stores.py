"""Stored tables: what an edit, a page, a search and a batch read and write."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tonearm.operators import counters, paging, store, text_index
from tonearm.streaming import ingest


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}"


def files_of(path):
    out = {}
    for d, _, names in os.walk(path.removeprefix("file://")):
        out |= {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for n in names if n.endswith(".parquet")}
    return out


TEXTS = ["Golden Hour", "golden", "The HOUR of gold", "au", "x", "", None, "Ünïcode hOUR", "per%cent under_score", "aaaa", "hour hour hour"]


@pytest.mark.parametrize("text", ["hour", "HOUR", "ou", "u", "golden hour", "%", "_", "g%r", "per_cent", "zzz", "aaa", "nïc", "hour hour", "d", "our o", "en%ho"])
def test_search_by_index(spark, path, text):
    rows = [(k * 40_000, t, TEXTS[-k]) for k, t in enumerate(TEXTS)]
    table = spark.createDataFrame(rows, "id long, a string, b string")
    text_index.write_index(table.select("id", F.explode(F.array("a", "b")).alias("text")), path, 4)
    got = sorted(r["id"] for r in text_index.search_by_index(table, path, text, ["a", "b"]).collect())
    like = F.coalesce(F.col("a").ilike(f"%{text}%"), F.lit(False)) | F.coalesce(F.col("b").ilike(f"%{text}%"), F.lit(False))
    assert got == sorted(r["id"] for r in table.where(like).collect())


def test_index_reads_only_matching_lists(spark, path):
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rng = random.Random(1)
    table = spark.createDataFrame([(k, " ".join(rng.choices(words, k=3)) + (" zebra" if k == 77 else "")) for k in range(400)], "id long, text string")
    text_index.write_index(table, path)
    found = text_index.candidates(spark, path, "zebra")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan
    assert "PushedFilters" in plan and [r["id"] for r in found.collect()] == [77]
    assert text_index.candidates(spark, path, "zebrafish").count() == 0


def test_pages(spark, path):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, "a", "b", "c", "d", "é"])) for k in range(500)]
    table = spark.createDataFrame(rows, "id long, name string").repartition(5)
    paging.write_ordered(table, ["name", "id"], path, 12)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    for skip, limit in ((0, 1), (0, 600), (100, 37), (499, 5), (500, 5), (10_000, 5)):
        assert [tuple(r) for r in paging.page_at(spark, path, skip, limit).collect()] == want[skip : skip + limit]
    for k in (0, 3, 250, 498, 499):
        after = {"name": want[k][1], "id": want[k][0]}
        assert [tuple(r) for r in paging.page_after(spark, path, after, 20).collect()] == want[k + 1 : k + 21]
    with pytest.raises(ValueError):
        paging.page_at(spark, path, -1)


def test_a_far_page_reads_one_folder(spark, path):
    paging.write_ordered(spark.range(2_000_000), ["id"], path, 40)
    page = paging.page_at(spark, path, 1_000_000, 10)
    assert [r["id"] for r in page.collect()] == list(range(1_000_000, 1_000_010))
    ranges = [r["range"] for r, before in paging._ranges(spark, path) if before < 1_000_010 and before + r["n"] > 1_000_000]
    assert len(ranges) == 1 and "range#" in page._jdf.queryExecution().executedPlan().toString()
    scan = page._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in scan and f"= {ranges[0]})" in scan


def test_edit_leaves_other_folders(spark, path):
    table = spark.range(1000).withColumns({"genre": F.concat(F.lit("g"), F.col("id") % 5), "matched_genre": F.lit(None).cast("string")})
    rows, facets = f"{path}/rows", f"{path}/facets"
    store.write_buckets(table, rows, buckets=16)
    store.write_facets(spark, rows, facets, "genre")
    before, derived = files_of(rows), files_of(facets)
    keys = spark.createDataFrame([(3,), (500,)], "id long")
    edit = lambda r: r.withColumn("genre", F.when(F.col("id").isin(3, 500), "new").otherwise(F.col("genre")))
    touched = store.edit_buckets(spark, rows, keys, edit, buckets=16)
    store.write_facets(spark, rows, facets, "genre", touched=touched)
    spark.catalog.clearCache()
    assert 1 <= len(touched) <= 2
    for old, new in ((before, files_of(rows)), (derived, files_of(facets))):
        same = {f for f in old if all(f"bucket={k}/" not in f for k in touched)}
        assert same and all(new[f] == old[f] for f in same)
        assert not any(f in new for f in old.keys() - same)
    got = {r["id"]: r["genre"] for r in spark.read.parquet(rows).collect()}
    assert got == {k: "new" if k in (3, 500) else f"g{k % 5}" for k in range(1000)}
    assert {r["value"]: r["n"] for r in store.stored_facets(spark, facets).collect()} == {"new": 2, "g3": 199, "g0": 199, "g1": 200, "g2": 200, "g4": 200}
    assert store.edit_buckets(spark, rows, keys.limit(0), edit, buckets=16) == []
    gone = store.edit_buckets(spark, rows, spark.range(1000), lambda r: r.where("id = 9"), buckets=16)
    store.write_facets(spark, rows, facets, "genre", touched=gone)
    assert [r["id"] for r in spark.read.parquet(rows).collect()] == [9]
    assert [tuple(r) for r in store.stored_facets(spark, facets).collect()] == [("genre", "g4", 1)]


def test_facets_in_one_scan(spark, path):
    table = spark.range(100).select("id", *(F.lit("x").alias(f"{p}{f}") for f in ("genre", "artist", "album") for p in ("", "matched_")))
    store.write_buckets(table, path)
    counts = store.facet_counts(spark.read.parquet(path), "genre", "artist", "album")
    assert counts._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_versions(spark, path):
    spark.createDataFrame([(1, 7)], "id int, year int").write.parquet(f"{path}/version=1")
    spark.createDataFrame([(2, "1999", "g")], "id long, year string, genre string").write.parquet(f"{path}/version=2")
    spark.createDataFrame([(3, "2000")], "id long, year string").write.mode("append").parquet(f"{path}/version=2")
    spark.createDataFrame([(True, 4, "x")], "tagged boolean, id long, extra string").write.parquet(f"{path}/version=10")
    got = store.read_versions(spark, path, "id long, year string, genre string, tagged boolean", {2: {"genre": F.lit("none")}, 10: {"tagged": F.lit(False)}})
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, "7", "none", False), (2, 2, "1999", "g", False), (2, 3, "2000", None, False), (10, 4, None, None, True)]


def test_counters(spark, path):
    rows = spark.createDataFrame([(k, None if k % 3 else f"bad {k}") for k in range(10)], "id long, error string")
    rows, seen = counters.counted(rows, "error", "id", bad="^bad", other="^x")
    rows.write.parquet(f"{path}/a")
    got = counters.job_row(rows, seen).first().asDict()
    assert got == {"processed": 10, "written": 6, "failed": 4, "bad": 4, "other": 0, "first_error_key": "0", "first_error_text": "bad 0", "last_error_key": "9", "last_error_text": "bad 9"}
    empty, seen = counters.counted(rows.limit(0), "error", "id", "none")
    empty.write.parquet(f"{path}/b")
    assert counters.job_row(empty, seen).first()["processed"] == 0


def test_ingest_restarts_in_mid_batch(spark, path):
    """A batch that dies between its rows and its counts adds no row twice, nor do files that are scanned again later."""
    schema = "filepath string, duration double, name string"
    source, out = f"{path}/in", f"{path}/out"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    known = spark.createDataFrame([("old",)], "filepath string")
    put([("a", 900.0, "A"), ("a", 900.0, "A"), ("old", 900.0, "O"), ("short", 5.0, "S"), (None, 900.0, "N"), ("b", None, "B")])

    def die(batch):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        ingest.ingest(stream(), out, known, 600, die)
    assert ingest.ledger(spark, out).count() == 0
    ingest.ingest(stream(), out, known, 600)
    rows = lambda: sorted(r["filepath"] for r in ingest.catalog_rows(spark, out, spark.createDataFrame([], schema).schema).collect())
    assert rows() == ["a", "b"]
    assert [tuple(r)[:3] for r in ingest.ledger(spark, out).collect()] == [(2, 1, 1)]
    put([("a", 900.0, "A"), ("c", 700.0, "C")])
    ingest.ingest(stream(), out, known, 600)
    assert rows() == ["a", "b", "c"]
    assert sorted(tuple(r) for r in ingest.ledger(spark, out).collect()) == [(1, 1, 0, 1), (2, 1, 1, 0)]
