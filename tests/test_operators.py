import glob
import os
import random
import struct

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonearm.functions import similarity
from tonearm.functions.ratios import Names
from tonearm.operators import html_pages, jsonmeta, matching, series, simjoin
from tonearm.plans import match_queries, page_queries, queries, store_queries  # noqa: F401
from tonearm.sources import files
from tonearm.streaming import incremental

SF = "/root/testdata/sf0.001"
TRACK = "id long, filename string, directory string, artist string, album string, matched_album string, genre string, matched_genre string, album_artist string, matched_album_artist string, matched_artist string, matched_cover_url string, duration double, series_tagged boolean"


def track(i, filename, directory="/m/x", artist="A", album=None, tagged=False, **more):
    row = dict.fromkeys(c.split()[0] for c in TRACK.split(", ")) | {"id": i, "filename": filename, "directory": directory, "artist": artist, "album": album, "duration": 100.0, "series_tagged": tagged}
    return tuple((row | more).values())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (d[columns].astype(object).where(d[columns].notna(), None).astype(str).sort_values(columns).reset_index(drop=True) for d in (got, want))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys()))
def test_runs(spark, name):
    queries.QUERIES[name](spark, SF).collect()


def greedy(n, pairs):
    near, leader = {frozenset(p) for p in pairs}, {}
    for i in range(n):
        if i not in leader:
            leader[i] = i
            leader |= {j: i for j in range(i + 1, n) if j not in leader and frozenset((i, j)) in near}
    return leader


def test_leader_clusters(spark):
    rng = random.Random(5)
    for n in (1, 6, 14):
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.3]
        nodes = spark.range(n).withColumnRenamed("id", "pos")
        got = simjoin.leader_clusters(nodes, spark.createDataFrame(pairs, "a long, b long"))
        assert {r["pos"]: r["leader"] for r in got.collect()} == greedy(n, pairs)


def test_detect_series(spark):
    rows = [
        track(1, "Night Show 101.mp3"), track(2, "Night Show 102.mp3", artist="B"), track(3, "Night Show 9999 x.mp3", artist="B"),
        track(4, "alpha.mp3", "/m/Sunset Tapes"), track(5, "beta.mp3", "/m/Sunset Tapes"),
        track(6, "Golden Hour live.mp3"), track(7, "Golden Hour 01.mp3", album="Golden Hour", tagged=True, genre="House"),
        track(8, "qq1.mp3", "/m/y", album="Lonely Disc"), track(9, "qq2.mp3", "/m/z", album="Lonely Disc"),
    ]
    got = {r["series_name"]: r for r in series.detect_series(spark.createDataFrame(rows, TRACK)).collect()}
    assert [t["track_id"] for t in got["Night Show"]["tracks"]] == [3, 1, 2] and got["Night Show"]["suggested_artist"] == "B"
    orphan = got["Golden Hour"]
    assert orphan["is_orphan"] and orphan["track_count"] == 1 and orphan["matched_series"] == "Golden Hour" and orphan["suggested_genre"] == "House"
    assert got["Sunset Tapes"]["track_count"] == 2
    albums = [r for r in got.values() if r["is_album_group"]]
    assert [sorted(t["track_id"] for t in r["tracks"]) for r in albums] == [[8, 9]]


def test_fuzzy_join_blocking(spark):
    """Blocking by words keeps at least nine of ten pairs that comparing all with all finds."""
    rng = random.Random(3)
    words = ["golden", "hour", "sunset", "tapes", "radio", "night", "deep", "waves", "echo", "club", "house", "live"]
    names = spark.createDataFrame([(k, " ".join(rng.choices(words, k=rng.randint(1, 4)))) for k in range(60)], "k long, name string")
    pairs = lambda blocking: {(r["left_key"], r["right_key"]): r["score"] for r in simjoin.fuzzy_join(names, names, "k", "name", "k", "name", 60.0, blocking).collect()}
    every, blocked = pairs(None), pairs("token")
    assert blocked.items() <= every.items() and len(blocked) >= 0.9 * len(every)
    with pytest.raises(ValueError):
        simjoin.fuzzy_join(names, spark.range(simjoin.SMALL_SIDE + 1).select("id", F.lit("x").alias("n")), "k", "name", "id", "n", 60.0, None)


def test_token_join_against_all_pairs(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(9)] + ["the", "of", "it"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 5)))) for k in range(80)]
    names = spark.createDataFrame(rows, "k long, name string")
    split = {k: {w for w in n.split() if len(w) > 2 and w != "the"} for k, n in rows}

    def score(x, y):
        if not x or not y:
            return 0.0
        jaccard, (small, large) = len(x & y) / len(x | y), sorted((x, y), key=len)
        return max(jaccard, 0.5 + len(small) / len(large) * 0.5) if small <= large else jaccard

    for threshold in (0.5, 0.7):
        want = {(a, b): round(score(split[a], split[b]), 9) for a in split for b in split if score(split[a], split[b]) > threshold}
        got = {(r["left_key"], r["right_key"]): round(r["score"], 9) for r in simjoin.token_similarity_join(names, names, "k", "name", "k", "name", threshold).collect()}
        assert got == want
        once = {(r["left_key"], r["right_key"]) for r in simjoin.similar_names(names, "k", "name", threshold).collect()}
        assert once == {p for p in want if p[0] < p[1]}


def test_scores(spark):
    ratio = similarity.token_set_ratio
    rows = [("Ann Bee", "Deep Waves", "x Deep Waves.mp3", "Deep Waves Club", "Ann", "Ann Bee", 3), (None, "", "Golden Hour.mp3", "Golden Hours", "", "Cid", None), ("A", None, "b.mp3", None, None, None, 40)]
    df = spark.createDataFrame(rows, "a string, t string, f string, ct string, ca string, dj string, n int")
    t = df.select(F.struct(F.col("a").alias("artist"), F.col("t").alias("title"), F.col("f").alias("filename")).alias("t"), F.struct(F.col("ct").alias("title"), F.col("ca").alias("artist"), "dj", F.col("ct").alias("full_title"), F.col("n").alias("num_tracks")).alias("c"))
    got = t.select(matching.web_score().alias("web"), matching.direct_score().alias("direct")).collect()
    clean = lambda x: (x or "").lower().removesuffix(".mp3")

    def mean(parts):
        there = [(s, w) for s, w in parts if s is not None]
        return sum(s * w for s, w in there) / sum(w for _, w in there) if there else 0.0

    both = lambda x, y: ratio(x, y) if x and y else None
    for (a, title, f, ct, ca, dj, n), r in zip(rows, got):
        own, full = clean(title or f), clean(f)
        web = mean([(both(own, clean(ct)), 0.4), (both(clean(a), clean(ca)), 0.3), (both(full, clean(ct)), 0.2), (50 + min(n * 2, 20) if n else None, 0.1)])
        direct = mean([(both(own, clean(ct)), 0.5), (both(clean(a), clean(ca or dj)), 0.3), (both(full, clean(ct)), 0.2)])
        assert (round(r["web"], 6), round(r["direct"], 6)) == (round(web, 6), round(direct, 6))


def test_pages(spark):
    rows = [
        (1, "http://any.org/x", "<h1>Set</h1><ol><li>1. A - B</li><li>C - D<li>E - F</ol>"),
        (2, "http://any.org/y", "<main><p>01. Artist - Title [Label]<br>\n02. Other - Song</p><img src='/logo.jpg'><img src='/cover.jpg' width=500></main>"),
        (3, "http://any.org/z", "<table><tr><td>A</td><td>B</td></tr><tr><td>C<td>D<tr><td>E<td>F</table>"),
        (4, None, None),
        (5, "http://www.1001tracklists.com/t", '<div class="tlpItem"><span class="trackValue">A - B</span><span class="cueValueField">00:10</span></div>'),
    ]
    got = {r["page_id"]: r for r in html_pages.page_tracklists(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    pairs = lambda k: [(t["artist"], t["title"]) for t in got[k]["tracks"]]
    assert pairs(1) == pairs(3) == [("A", "B"), ("C", "D"), ("E", "F")]
    assert pairs(2) == [("Artist", "Title"), ("Other", "Song")] and got[2]["cover_url"] == "http://any.org/cover.jpg"
    assert 4 not in got and got[5]["tracks"][0]["time"] == "00:10"


def test_tracklist_lines(spark):
    text = "intro\n01. Artist - Title [Label]\n[00:10] Artist - Title\n2) X - Y\nNo Dash Here\n3) Other – Song"
    got = html_pages.tracklist_lines(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").orderBy("position").collect()
    assert [(r["position"], r["artist"], r["title"]) for r in got][:1] == [(1, "Artist", "Title")]
    assert [(r["position"], r["artist"], r["title"]) for r in got][1:] == [(2, "Other", "Song")]


def test_json(spark):
    body = '{"media":[{"position":1,"tracks":[{"position":1,"title":"a"},{"position":2,"title":"b"}]},{"position":2,"tracks":[{"position":1,"title":"c"}]}]}'
    got = jsonmeta.release_tracks(spark.createDataFrame([(1, body), (2, None), (3, "{}")], "id long, body string"), "id").collect()
    assert [(r["disc"], r["position"], r["title"]) for r in got] == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    images = spark.range(1).select(F.from_json(F.lit('[{"image":"x"},{"front":true,"thumbnails":{"large":"y"}}]'), jsonmeta.IMAGES).alias("i"))
    assert images.select(jsonmeta.front_cover(F.col("i"))).first()[0] == "y"


def test_release_votes_of_all_candidates(spark, tmp_path):
    rows = [(key, line, (key * 3 + line) % 50, key % 5, 1.0) for key in (1, 6, 1999, 2000, 2001, 5003, 70004, 600000) for line in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    votes, first = {}, {}
    for key, _, part, supplier, _ in rows:
        if key % 7 < jsonmeta.NAMES:
            release = f"genre {part % 9}"
            votes[release] = votes.get(release, 0) + 1
            first.setdefault(release, []).append((key % 7, f"Set {part % 50}", f"DJ {supplier}"))
    got = queries.QUERIES["release_votes"](spark, str(tmp_path)).collect()
    assert {r["id"]: r["match_count"] for r in got} == votes
    assert [r["match_count"] for r in got] == sorted(votes.values(), reverse=True)
    assert all((min(first[r["id"]])[0], r["title"], r["artist"]) in first[r["id"]] for r in got)


def test_ingest_scans_all_tracks(spark, monkeypatch):
    sides, new_files = [], queries.catalog.new_files
    monkeypatch.setattr(queries.catalog, "new_files", lambda scanned, known, least: sides.append((scanned, known)) or new_files(scanned, known, least))
    queries.QUERIES["ingest_anti_join"](spark, SF)
    ids = lambda d: {r["id"] for r in d.select("id").collect()}
    every, (scanned, known) = ids(queries.tracks(spark, SF)), sides[0]
    assert ids(scanned) == every and ids(known) == {i for i in every if i % 3 == 0}


def _same_paths(folder):
    """A copy of the small tables in which two tracks share each path: the part and the episode repeat every 19,400 orders."""
    os.makedirs(folder)
    for table in ("customer", "nation", "part", "lineitem"):
        os.symlink(f"{SF}/{table}.parquet", f"{folder}/{table}.parquet")
    orders = f"read_parquet('{SF}/orders.parquet')"
    duckdb.sql(f"COPY (SELECT * FROM {orders} UNION ALL SELECT * REPLACE (o_orderkey + 19400 AS o_orderkey) FROM {orders}) TO '{folder}/orders.parquet' (FORMAT parquet)")
    return str(folder)


def _held_by_sql(spark, name, folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    want = c.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    rows = lambda rs: sorted((tuple(r) for r in rs), key=repr)
    got = rows(queries.QUERIES[name](spark, str(folder)).select(columns).collect())
    assert got == rows(want.fetchall())
    return got


@pytest.mark.parametrize("name", ["ingest_anti_join", "resync_diff", "stream_ingest", "scan_counts"])
def test_tracks_that_share_a_path(spark, tmp_path, name):
    assert _held_by_sql(spark, name, _same_paths(tmp_path / "shared"))


def test_first_row_of_equal_identifiers(spark, tmp_path):
    """Candidates 100,000 parts apart have one identifier; the table's first is the recording, whatever its name."""
    rows = [(k, 1, 7 + 100_000 * n, s, 40.0) for k in range(40) for n, s in ((0, 9), (1, 10), (2, 8))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lines")
    os.rename(glob.glob(f"{tmp_path}/lines/*.parquet")[0], tmp_path / "lineitem.parquet")
    for table in ("customer", "nation", "part", "orders"):
        os.symlink(f"{SF}/{table}.parquet", tmp_path / f"{table}.parquet")
    (tmp_path / "lines").rename(tmp_path.parent / f"{tmp_path.name}-lines")
    assert {r[3] for r in _held_by_sql(spark, "acoustid_alternatives", tmp_path)} == {"DJ 9, Guest"}


def test_audio_source(spark, tmp_path):
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 16000, 2, 16)
    info = b"INFO" + b"INAM" + struct.pack("<I", 4) + b"Song"
    body = b"WAVE" + fmt + b"LIST" + struct.pack("<I", len(info)) + info + b"data" + struct.pack("<I", 32000) + bytes(32000)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.WAV").write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    (tmp_path / "bad.mp3").write_bytes(b"ID3\x04")
    (tmp_path / "no.txt").write_bytes(b"x")
    assert {r["filename"] for r in files.audio_files(spark, [str(tmp_path)]).collect()} == {"a.WAV", "bad.mp3"}
    tags = {os.path.basename(r["filepath"]): r for r in files.audio_tags(spark, [str(tmp_path)]).collect()}
    assert (tags["a.WAV"]["title"], tags["a.WAV"]["duration"], tags["a.WAV"]["sample_rate"]) == ("Song", 2.0, 8000)
    assert tags["bad.mp3"]["title"] is None and tags["bad.mp3"]["series_tagged"] is False


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = "filepath string, modified timestamp"
    spark.createDataFrame([("/a", None), ("/a", None), ("/b", None)], rows).withColumn("modified", F.current_timestamp()).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        incremental.run_available(incremental.new_paths(incremental.stream_table(spark, source)), out, str(tmp_path / "c"))
    assert sorted(r["filepath"] for r in spark.read.parquet(out).collect()) == ["/a", "/b"]


def _atom(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _comment(**fields):
    out = struct.pack("<I", 0) + struct.pack("<I", len(fields))
    for k, v in fields.items():
        line = f"{k}={v}".encode()
        out += struct.pack("<I", len(line)) + line
    return out


def _page(packet, granule=0):
    return b"OggS\0\0" + struct.pack("<q", granule) + bytes(12) + bytes([len(packet) // 255 + 1]) + b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255]) + packet


def test_tag_formats():
    frame = struct.pack(">I", 0xFFFB9000)  # layer 3, 128 kbit/s, 44.1 kHz
    text = b"TIT1" + struct.pack(">I", 15) + b"\0\0\3" + files.MARKER.encode()
    mp3 = b"ID3\4\0\0" + bytes([0, 0, 0, len(text)]) + text + frame + bytes(15996)
    got = files.decode_tags(mp3)
    assert (got["grouping"], got["bitrate"], got["sample_rate"], got["duration"]) == (files.MARKER, 128000, 44100, 1.0)
    variable = frame + bytes(32) + b"Xing" + struct.pack(">II", 1, 100) + bytes(4000)
    assert round(files.decode_tags(variable)["duration"], 4) == round(100 * 1152 / 44100, 4)
    item = lambda k, v: _atom(k, _atom(b"data", bytes(8) + v.encode()))
    moov = _atom(b"moov", _atom(b"mvhd", bytes(12) + struct.pack(">II", 1000, 2500)) + _atom(b"trak", _atom(b"mdia", _atom(b"mdhd", bytes(12) + struct.pack(">II", 48000, 1)))) + _atom(b"udta", _atom(b"meta", bytes(4) + _atom(b"ilst", item(b"\xa9nam", "Song") + item(b"\xa9grp", files.MARKER)))))
    got = files.decode_tags(_atom(b"ftyp", b"M4A ") + moov + _atom(b"mdat", bytes(2500)))
    assert got == {"file_format": "m4a", "duration": 2.5, "sample_rate": 48000, "title": "Song", "grouping": files.MARKER, "bitrate": 8000}
    head = b"\x01vorbis" + bytes(5) + struct.pack("<Iiii", 44100, 0, 96000, 0)
    got = files.decode_tags(_page(head) + _page(b"\x03vorbis" + _comment(TITLE="Song", GROUPING="x" * 300, date="2001")) + _page(b"", 88200))
    assert (got["title"], got["grouping"], got["year"], got["sample_rate"], got["bitrate"], got["duration"]) == ("Song", "x" * 300, "2001", 44100, 96000, 2.0)
    info = bytes(10) + (44100 << 44 | 88200).to_bytes(8, "big")
    comment = _comment(ARTIST="A")
    flac = b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x84]) + len(comment).to_bytes(3, "big") + comment
    assert files.decode_tags(flac) == {"file_format": "flac", "artist": "A", "sample_rate": 44100, "duration": 2.0}
    assert files.decode_tags(b"") == files.decode_tags(b"OggS") == files.decode_tags(b"junk") == {} or files.decode_tags(b"OggS") == {"file_format": "ogg"}


def test_file_helpers(spark, tmp_path):
    log = tmp_path / "app.log"
    log.write_text("a\n")
    files.clear_log(str(log))
    assert log.read_text() == ""
    settings = str(tmp_path / "s.json")
    files.save_settings(settings, {"a": 1})
    assert files.load_settings(settings, {"a": 0, "b": 2}) == {"a": 1, "b": 2} and files.load_settings("/none", {"c": 3}) == {"c": 3}
    assert files.roots([str(tmp_path), "/none"], None, "/d") == [str(tmp_path)] and files.roots([], str(tmp_path), "/d") == [str(tmp_path)] and files.roots(["/none"], "/no", "/d") == ["/d"]
    assert files.suffixes(" MP3, .ogg,") == ("mp3", "ogg") and "flac" in files.suffixes()
    names = spark.createDataFrame([("/m/.git",), ("/m/b",), ("/m/A",)], "p string")
    assert [r["name"] for r in files.visible_directories(names, F.col("p")).collect()] == ["A", "b"]
    assert files.fingerprint_tool("no-such-tool") is None and files.fingerprint_tool("ls")


def test_job_states(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate([[("a", "running", 1, 0)], [("a", "done", 2, 100), ("b", "running", 5, 100)], [("c", "running", 1, 1000)], [("c", "done", 1, 1001)]]):
        df = spark.createDataFrame(rows, "job_id string, status string, done long, at long").select("job_id", "status", "done", F.timestamp_seconds(F.col("at") + 86400).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(source)
        incremental.run_available(incremental.job_states(incremental.stream_table(spark, source)), out, str(tmp_path / "c"))
    got = [(r["job_id"], r["status"], r["done"]) for r in spark.read.parquet(out).collect()]
    for row in (("a", "running", 1), ("a", "done", 3), ("b", "running", 5), ("c", "running", 1), ("c", "done", 2), ("a", "expired", 3), ("b", "expired", 5)):
        assert got.count(row) == 1, got
    assert len(got) == 7


def chain_jobs(spark, run):
    """What run gives, and how many jobs it took."""
    spark.sparkContext.setJobGroup(f"jobs-{id(run)}", "counted")
    out = run()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"jobs-{id(run)}"))
    spark.sparkContext.setJobGroup("other", "other")
    return out, jobs


def test_leader_clusters_of_a_chain(spark):
    """10,000 nodes of which each is tied to the next: one task decides the component."""
    n = 10_000
    pairs = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    nodes = spark.range(n + 1).withColumnRenamed("id", "pos")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a job for each action, not for each exchange
    got, jobs = chain_jobs(spark, lambda: simjoin.leader_clusters(nodes, pairs).collect())
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {r["pos"]: r["leader"] for r in got} == {k: k - k % 2 for k in range(n + 1)}
    assert jobs < 10


@pytest.mark.parametrize("small", [0, 3, 12])
def test_leader_clusters_of_large_components(spark, small):
    rng = random.Random(small)
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.06] + [(50, 51), (51, 52)]
    nodes = spark.range(54).withColumnRenamed("id", "pos")
    got = {r["pos"]: r["leader"] for r in simjoin.leader_clusters(nodes, spark.createDataFrame(pairs, "a long, b long"), small).collect()}
    assert got == greedy(54, pairs)


def test_top_similar_against_all_pairs(spark):
    """2,000 names with 2,000: the same ten as from all pairs, ties too."""
    parts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.1/part.parquet").select("p_name").limit(4000).collect()]
    left, right = list(enumerate([*parts[:1990], None, "", "x", *parts[:7]])), list(enumerate([*parts[2000:], *parts[2000:2040], None]))
    a, b = (spark.createDataFrame(rows, "k long, name string").repartition(3) for rows in (left, right))
    monkey, simjoin.NAMES_BLOCK = simjoin.NAMES_BLOCK, 700
    got = {(r["left_key"], r["rank"]): (r["right_key"], r["score"]) for r in simjoin.top_similar(a, b, "k", "name", "k", "name", 50.0).collect()}
    simjoin.NAMES_BLOCK = monkey
    names = Names(pa.array([n or "" for _, n in [*left, *right]]))
    at = np.arange(len(left), len(left) + len(right))
    want = {}
    for k in range(len(left)):
        score = names.ratios(np.full(len(right), k), at)
        order = np.lexsort((np.arange(len(right)), -score))[:10]
        want |= {(k, place + 1): (int(c), score[c]) for place, c in enumerate(order) if score[c] >= 50}
    assert got == want


def test_costly_rows_are_dealt_out(spark):
    """One small file still becomes more pieces than there are cores, for tracks and for pages of candidates."""
    cores = spark.sparkContext.defaultParallelism
    for rows in (queries.dealt_tracks(spark, SF), page_queries._numbered(spark, SF)):
        assert rows.rdd.getNumPartitions() >= 4 * cores


def test_tracks_are_dealt_out_behind_joins(spark):
    """Joins by few keys, whose few bytes Spark merges, leave costly work to many tasks all the same."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in queries.dealt_tracks(spark, SF).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) >= 3 * spark.sparkContext.defaultParallelism and max(sizes) < sum(sizes) / 4


def test_releases_are_dealt_out(spark):
    """Documents are written and read by many tasks, though their few bytes would be merged."""
    found = match_queries.releases(spark, SF).select(F.spark_partition_id().alias("p")).groupBy("p").count()
    assert found.count() >= 3 * spark.sparkContext.defaultParallelism


def test_scored_names_are_cleaned_once(spark):
    """The names of either side are cleaned before the join, and a ratio that both scores ask for is worked out once."""
    t = spark.createDataFrame([(1, "Ann Bee", "Deep Waves", "x Deep Waves.mp3"), (2, None, "", "Golden  Hour .mp3"), (3, "A", None, "b.mp3")], "id long, artist string, title string, filename string")
    rows = [(10, 1, "Deep Waves Club", "Ann", "Ann Bee", "Ann - Deep Waves", 3), (11, 2, "Golden Hours", "", "Cid", None, None), (12, 3, None, None, None, None, 40), (13, 1, "Live Set", None, "Ann Bee", "", 0), (14, 1, "Été live", "Ann Bee", None, None, 7)]
    c = spark.createDataFrame(rows, "id long, track_id long, title string, artist string, dj string, full_title string, num_tracks int")
    got = matching.scored(t, c, 3)
    joined = t.alias("t").join(c.alias("c"), F.col("t.id") == F.col("c.track_id"))
    want = joined.select(F.col("c.id").alias("id"), "track_id", matching.direct_score().alias("direct"), matching.web_score().alias("web"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join")]
    assert "regexp_replace" not in top and top.count("pythonUDF") and "pythonUDF5" not in top
