"""Page parsers and site search over small pages, one of each kind."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tonearm.operators import html_pages, site_search
from tonearm.plans import adapters
from tonearm.sources import markup
from tonearm.sources.markup import read_nodes

SITE = "https://www.1001tracklists.com"
DETAIL = """<html><head><title> Sunset Tapes 12 </title><meta property="og:image" content="http://i.org/c.jpg"></head><body><div id="left">
<table class="sideTop"><tr><td><a href="/dj/ann/index.html">Ann</a></td></tr></table>
<table class="sideTop"><tr><td>Radio <span><a href="/source/waves/index.html"> Waves </a></span></td></tr></table>
<table><tr><td><span title="tracklist recording date">date</span></td><td> 2020-01-02 </td></tr><tr><td id="tl_music_styles">House, Deep House</td></tr></table>
IDed 3 / 14 tracks short</div>
<div class="tlpItem"><div class="cueValueField"> 00:00 </div><span class="trackValue">A B - C&nbsp;D</span><meta itemprop="genre" content="House"><meta itemprop="url" content="/t/1"><span title="label">L1</span><span title="label"> L2 </span></div>
<div class="tlpItem"><span class="trackValue">Only title</span></div><div class="tlpItem"><i>none</i></div></body></html>"""
PAGES = [
    (1, f"{SITE}/tracklist/ab12/x.html", '<h1 id="pageTitle">Set</h1><meta name="description" content="Ann B - live set"><table><tr class="tlpItem other"><td><a class="trackValue">X1 - Y - Z</a><span class="timeValue">1:02</span></td></tr><tr class="tlpItem"><td>no value</td></tr><tr class="tlpItem"><td><span class="trackValue">Solo</span></td></tr></table><a href="/genre/house">House</a><a href="/genre/h2">House</a><div class="dateDiv">2020</div>'),
    (2, "https://www.mixesdb.com/w/x", "<h1 class='firstHeading'>Mix</h1><ul><li>menu entry - no track</li></ul><div><h2>Tracklist</h2><ol><li>[000] Artist - Title</li><li>x</li><li>01. Foo / Bar baz</li></ol></div>"),
    (3, "https://www.discogs.com/r/1", '<h1 class="title_1q3xW">Rel</h1><a href="/artist/1">Art</a><table><tr class="tracklist_track"><td class="trackTitle">T1</td></tr><tr class="tracklist_track"><td>?</td></tr><tr class="tracklist_track"><td><span class="trackTitle_CTKp4">T3</span></td></tr></table><a href="/style/deep">Deep</a><a href="/genre/e">Electronic</a>'),
    (4, "https://old.reddit.com/r/x", "<h1>Post</h1><div class='md'>hello\n01. Aa - Bb\n[00:10] Cc - Dd\n01. aa - BB</div>"),
    (5, "https://www.setlist.fm/s/1", '<h1><a href="/setlists/a">Band</a></h1><a href="/venue/v">Hall</a><span class="dateString">May 1</span><ol><li class="song"><a class="songLabel">S1</a></li><li class="song"><a class="songLabel">S2</a></li></ol>'),
    (6, "https://musicbrainz.org/release/1", '<h1><bdi>Rel</bdi></h1><p class="subheader"><a href="/artist/1">Art</a></p><table class="tbl medium"><tbody><tr><td>1</td></tr><tr><td class="title"><a><bdi>One</bdi></a></td></tr></tbody></table>'),
    (7, "https://soundcloud.com/x", "<title>Page</title><body>no tracks<ol><li>a<li>b</ol><ol><li>1. A1 / T1</li><li></li><li>T2</li></ol><table><tr><td>x<td>y</table>"),
    (8, "https://www.mixesdb.com/w/y", "<p>01. Fall - Back</p>"),
    (9, None, None),
    (10, "https://a.org", ""),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_parsers(pages):
    got = {r["page_id"]: r for r in html_pages.page_tracklists(pages).collect()}
    of = lambda k: [(t["position"], t["artist"], t["title"], t["time"]) for t in got[k]["tracks"]]
    assert of(1) == [(1, "X1", "Y - Z", "1:02"), (3, "", "Solo", "")]
    assert (got[1]["title"], got[1]["artist"], got[1]["genres"], got[1]["date"], got[1]["source"]) == ("Set", "Ann B", ["House"], "2020", "1001tracklists")
    assert of(2) == [(1, "[000] Artist", "Title", None), (3, "Foo", "Bar baz", None)] and got[2]["title"] == "Mix"
    assert of(3) == [(1, "Art", "T1", None), (3, "Art", "T3", None)] and got[3]["title"] == "Rel" and got[3]["genres"] == ["Deep", "Electronic"]
    assert of(4) == [(1, "Aa", "Bb", None), (2, "Cc", "Dd", None)] and got[4]["source"] == "reddit"
    assert of(5) == [(1, "Band", "S1", None), (2, "Band", "S2", None)] and got[5]["title"] == "Hall @ May 1" and got[5]["date"] == "May 1"
    assert of(6) == [(2, "Art", "One", None)] and got[6]["title"] == "Rel"
    assert of(7) == [(1, "A1", "T1", None), (3, "", "T2", None)] and got[7]["title"] == "Page" and got[7]["source"] == "web"
    assert of(8) == [(1, "Fall", "Back", None)] and got[8]["source"] == "web"  # the generic parser stands in
    assert got.keys() == set(range(1, 9))


def test_covers(spark):
    rows = [
        (1, "http://h.org/a/b", '<meta property="og:image" content="http://x.org/a.jpg"><img class="cover" src="/c.jpg">'),
        (2, "http://h.org/a/b", '<meta property="og:image" content="nothing"><div class="x-cover"><img src="d.png"></div>'),
        (3, "http://h.org/a/b", "<img src='/e.jpg'><main><img src='/icon.png'><img src='/s.jpg' width='50'><img src='/f.jpg' width='500px'></main>"),
        (4, "http://h.org/a/b", "<img src='/e.jpg'>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r[0]: r[1] for r in read_nodes(pages).select("page_id", html_pages.cover(F.col("url"))).collect()}
    assert got == {1: "http://x.org/a.jpg", 2: "http://h.org/a/d.png", 3: "http://h.org/f.jpg", 4: ""}
    options = '<title>T</title><meta property="og:image" content="http://x.org/a.jpg"><meta name="twitter:image" content="http://x.org/a.jpg"><img class="cover" src="//y.org/1.jpg" alt="One"><img class="cover" data-src="/2.jpg"><img class="cover" src="/logo.jpg"><img class="cover" src="/4.jpg"><img alt="My Cover" src="/5.jpg">'
    got = html_pages.page_covers(spark.createDataFrame([(1, "http://www.h.org/q", options), (2, "u", None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(c["url"], c["source"], c["title"]) for c in got[0]["covers"]] == [("http://x.org/a.jpg", "h.org", "T"), ("https://y.org/1.jpg", "h.org", "One"), ("http://h.org/2.jpg".replace("h.org", "www.h.org"), "h.org", "h.org"), ("http://www.h.org/5.jpg", "h.org", "My Cover")]
    assert got[1]["covers"] == []


def test_hits(spark):
    lite = '<a class="result-link" href="http://a.org/1">First</a><a class="result-link" href="/x">In</a><a class="result-link" href="http://duckduckgo.com/y">Own</a><a class="result-link" href="http://b.org">ab</a><a class="result-link" href="http://www.c.org/2">Third</a>'
    plain = '<table><tr><td><a href="http://d.org">Delta</a></td></tr></table><a href="http://e.org">Echo</a>'
    rich = '<div class="g"><a href="/url?q=http%3A%2F%2Fz.org%2F1&x=1"><h3>Zed</h3></a><span class="st">snip</span></div><div class="g"><a href="http://www.google.com/q">g</a></div><div class="g">none</div>'
    frame = lambda *rows: spark.createDataFrame(rows, "query string, html string")
    got = site_search.web_hits(frame(("p", lite), ("q", plain), ("r", "")), frame(("p", rich), ("r", rich)), limit=3).orderBy("query", "pos").collect()
    assert [(r["query"], r["url"], r["title"], r["snippet"], r["domain"]) for r in got] == [
        ("p", "http://a.org/1", "First", "", "a.org"), ("p", "http://www.c.org/2", "Third", "", "c.org"), ("q", "http://d.org", "Delta", "", "d.org"), ("r", "http://z.org/1", "Zed", "snip", "z.org"),
    ]


def test_hits_read_rich_pages_only_where_needed(spark):
    """The plain source is read once, and of the other only the pages of queries without hits, a query without a name and repeated ones too."""
    lite, rich = '<a class="result-link" href="http://a.org/1">First</a>', '<div class="g"><a href="http://z.org/1"><h3>Zed</h3></a></div>'
    frame = lambda *rows: spark.createDataFrame(rows, "query string, html string")
    got = site_search.web_hits(frame(("p", lite), ("p", ""), ("r", None), (None, "")), frame(("p", rich), ("r", rich), ("r", rich), (None, rich), ("s", rich)))
    assert sorted((str(r["query"]), r["url"]) for r in got.collect()) == [("None", "http://z.org/1"), ("p", "http://a.org/1"), ("r", "http://z.org/1"), ("r", "http://z.org/1"), ("s", "http://z.org/1")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.index("MapInArrow") < plan.index("LeftAnti")


def test_site_search(spark):
    rows = '<div class="tlLink"><a href="/tracklist/1/a.html"> Ann @ X </a><span class="artistName">Ann</span></div><div class="tlLink">no link</div><div class="tlpItem"><span class="trackValue">A - B</span></div>'
    links = '<a href="/tracklist/5/x.html"></a><a href="/tracklist/5/x.html">Later title</a><a href="http://q.org/tracklist/6">Other 12</a><a href="/tracklist/7">ab</a>'
    pages = spark.createDataFrame([("q", rows), ("Show 12", links), ("none", None)], "query string, html string")
    got = [(r["query"], r["pos"], r["type"], r["title"], r["url"], r["dj"], r["artist"]) for r in site_search.site_search(pages).orderBy("query", "pos").collect()]
    assert got == [("Show 12", 1, "tracklist", "Other 12", "http://q.org/tracklist/6", None, None), ("q", 1, "tracklist", "Ann @ X", SITE + "/tracklist/1/a.html", "Ann", None), ("q", 2, "track", "B", None, None, "A")]
    assert [r["title"] for r in site_search.dj_tracklists(spark.createDataFrame([("d", links)], "dj string, html string")).orderBy("pos").collect()] == ["Later title", "Other 12", "ab"]
    found = site_search.combined_search(spark.createDataFrame([("Show 12", ""), ("q", rows)], "query string, html string"), spark.createDataFrame([("Show 12", links), ("q", links)], "query string, html string"))
    assert sorted((r["query"], r["title"]) for r in found.collect()) == [("Show 12", "Other 12"), ("q", "Ann @ X")]
    url = spark.range(1).select(site_search.search_url(F.lit("a b&c"), "djs"), site_search.dj_url(F.lit("x y")), site_search.source_url(F.lit("A State! of X")))
    assert list(url.first()) == [SITE + "/search/dj.php?q=a+b%26c", SITE + "/dj/x+y/index.html", SITE + "/source/a-state-of-x/index.html"]


def test_tracklist_pages(spark):
    got = {r["page_id"]: r for r in site_search.tracklist_pages(spark.createDataFrame([(1, SITE + "/tracklist/ab12/x.html", DETAIL), (2, None, None)], "page_id long, url string, html string")).collect()}
    r = got[1]
    assert (r["tracklist_id"], r["title"], r["cues"], r["cover_url"]) == ("ab12", " Sunset Tapes 12 ", ["00:00"], "http://i.org/c.jpg")
    assert [(t["full_title"], t["artist"], t["title"], t["genre"], t["url"], t["labels"]) for t in r["tracks"]] == [("A B - C D", "A B", "C D", "House", "/t/1", ["L1", "L2"]), ("Only title", None, "Only title", None, None, [])]
    assert (r["djs"], r["genres"], r["date_recorded"], r["sources"], r["num_tracks"]) == (["Ann"], ["House", "Deep House"], "2020-01-02", {"Radio": "Waves"}, 14)
    assert (got[2]["tracklist_id"], got[2]["tracks"], got[2]["djs"], got[2]["sources"]) == (None, [], [], {})


def test_search_pipeline(spark):
    hits = [(1, 1, 1, "http://a.org", "A", "s"), (1, 1, 2, "http://b.org", "B", ""), (1, 2, 1, "http://a.org", "A again", ""), (1, 2, 2, "http://youtube.com/x", "Y", ""), (1, 6, 1, "http://late.org", "L", ""), (1, 3, 6, "http://deep.org", "D", ""), (2, 1, 1, "http://none.org", "N", "")]
    hits = spark.createDataFrame(hits, "track_id long, query_no int, pos int, url string, title string, snippet string").withColumn("domain", F.regexp_extract("url", "//([^/]*)", 1))
    pages = spark.createDataFrame([(u, f"<ol><li>1. A{k} / T</li><li>B / T</li><li>C / T</li></ol>") for k, u in enumerate(["http://a.org", "http://b.org", "http://youtube.com/x", "http://late.org", "http://deep.org"])] + [("http://none.org", "")], "url string, html string")
    tracklists = html_pages.page_tracklists(pages.withColumn("page_id", F.col("url"))).drop("page_id")
    found = site_search.search_results(hits, tracklists)
    assert sorted((r["track_id"], r["result_no"], r["source_url"], r["search_title"]) for r in found.collect()) == [(1, 1, "http://a.org", "A"), (1, 2, "http://b.org", "B")]
    shaped = site_search.result_candidates(found.withColumn("confidence", F.lit(70.0)))
    stored = site_search.stored_candidates(shaped).orderBy("tracklist_url").collect()
    assert [(r["track_id"], r["tracklist_url"], r["num_tracks"], r["genre"], r["match_type"], r["artist"]) for r in stored] == [(1, "http://a.org", 3, "", "google_search", ""), (1, "http://b.org", 3, "", "google_search", "")]
    bare = site_search.stored_candidates(spark.createDataFrame([(1, None, "Ann")], "track_id long, title string, dj string")).first()
    assert (bare["title"], bare["artist"], bare["source"], bare["num_tracks"], bare["confidence"], bare["match_type"], bare["id"]) == ("", "Ann", "", 0, 0.0, "fuzzy", None)


def test_cover_options(spark):
    covers = spark.createDataFrame([("http://a.org", [("u1", "a", "t"), ("u2", "a", "t")]), ("http://b.org", [("u2", "b", "t"), ("u3", "b", "t")])], "url string, covers array<struct<url:string,source:string,title:string>>")
    hits = spark.createDataFrame([("q", 1, 1, "http://a.org"), ("q", 2, 1, "http://b.org"), ("q", 2, 11, "http://c.org")], "query string, query_no int, pos int, url string")
    got = site_search.cover_options(hits, covers, limit=2).orderBy("option_no").collect()
    assert [(r["option_no"], r["url"], r["source"]) for r in got] == [(1, "u1", "a"), (2, "u2", "a")]
    dealt = site_search.cover_options(hits, covers, limit=2, pieces=7)
    assert dealt.orderBy("option_no").collect() == got and dealt.rdd.getNumPartitions() == 7
    assert adapters.pieces(spark, 3 * adapters.PIECE_ROWS * adapters.pieces(spark)) == 3 * adapters.pieces(spark)
    assert spark.range(1).select(site_search.cover_queries(F.lit("x"))).first()[0] == ["x album cover", "x discogs", "x artwork soundcloud"]


@pytest.mark.parametrize("unit, count", [("<a ", 350_000), ("<div>x", 170_000), ("<b><p>x", 150_000), ('<i t="', 170_000), ("</p>", 250_000), ("<p></b>", 150_000), ("<script>", 130_000), ("<!--", 250_000), ("<li><b>", 150_000), ("&lt;<", 200_000)])
def test_reader_is_linear(unit, count):
    """A megabyte of markup of one kind takes a few seconds at most."""
    began = time.monotonic()
    markup._read(unit * count)
    assert time.monotonic() - began < 5


def test_reader():
    read = lambda h: [(n["tag"], n["pos"], n["last"], dict(n["attrs"])) for n in markup._read(h)[2]]
    assert read('<P A=1 b="x>y" a=2>t<br/>u') == [("p", 0, 3, {"a": "1", "b": "x>y"}), ("#text", 1, 1, {}), ("br", 2, 2, {}), ("#text", 3, 3, {})]
    assert markup._read("a < b &amp; c<!-- <p>no --><script>if (a<b) '</p>'</script>d</x>e<q")[1] == "a < b & cde"
    assert [n[0] for n in read('<p title="x>leak</p>y')] == ["p", "#text", "#text"]
    assert read("<ul><li>a<ul><li>b</ul><li>c</ul>")[1][:3] == ("li", 1, 5)
    assert read("<div/>x")[0] == ("div", 0, 0, {}) and read("<?php a?>z<!DOCTYPE html></ >")[0][0] == "#text"


def test_nodes_of_some_tags():
    """Nodes that are left out leave the places and offsets of the others as they are."""
    html = "<div class='a  b'>x &amp; y<p>z<span title=t>w</span></div><a href=/1>v</a>"
    every, some = markup._Reader(), markup._Reader(frozenset(["span", "a"]))
    assert every.page(html) == some.page(html)
    nodes, kept = every.arrow()[0].as_py(), some.arrow()[0].as_py()
    assert kept == [n for n in nodes if n["tag"] in ("span", "a")] and len(kept) == 2


def test_pages_are_read_in_pieces(spark, monkeypatch):
    """Large pages of one batch are not held together, and none is lost between the pieces."""
    monkeypatch.setattr(markup, "PIECE", 100)
    sizes = [0, 250, 10, 60, 60, 0, 100]
    html = markup.pa.array(["x" * n if n else None for n in sizes])
    assert list(markup._pieces(html)) == [(0, 2), (2, 3), (5, 2)]
    rows = read_nodes(spark.createDataFrame([(k, "<p>" + "x" * n) for k, n in enumerate(sizes)], "k int, html string")).select("k", F.length("text").alias("n"), F.size("nodes").alias("m")).collect()
    assert sorted((r["k"], r["n"], r["m"]) for r in rows) == [(k, n, 1 + (n > 0)) for k, n in enumerate(sizes)]


def test_tags_that_repeat(monkeypatch):
    """A tag that ends with its first > whatever follows is looked up; no other is, and a page reads the same without it."""
    assert markup._closed_tag('<A Class="x y" b=c/>') == (False, "a", (("class", "b"), ("x y", "c/")), True)
    assert markup._closed_tag("</td>") == (True, "td", ((), ()), False)
    assert not any(map(markup._closed_tag, ('<a b="c>', '<a "b="c>', "<a b='\">", "<!-->", "< a>", "<1>")))
    rng = random.Random(3)
    parts = ['<div class="a">', "</div>", "<td>", "<tr>", "<table>", "</table>", '<a b="c', "'", '"', ">", '<a "b="c>', "<br/>", "<script>", "</script>", "<!--", "-->", "x", "&amp;", "<", "<li>", "</ul>", "<p>"]
    pages = ["".join(rng.choices(parts, k=rng.randint(1, 20))) for _ in range(2000)]
    got = [markup._read(p) for p in pages]
    monkeypatch.setattr(markup, "_closed_tag", lambda said: None)
    assert got == [markup._read(p) for p in pages]
