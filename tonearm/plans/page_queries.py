"""Queries over pages that are made of the sample tables, so that SQL knows what the parsers must find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media, text
from ..operators import catalog, dml, duplicates, html_pages, jsonmeta, matching, site_search
from ..schema import DUPLICATE_COLUMNS
from ..sources.markup import read_nodes
from .adapters import candidate_pieces, candidates, dealt_tracks, tracks
from .queries import _CLEANED, C, T, query, read

#: Candidates numbered within their track.
R = f"{C}, r AS (SELECT track_id AS page_id, id, artist, title, CAST(row_number() OVER (PARTITION BY track_id ORDER BY id, artist, title) AS INTEGER) AS k FROM candidates)"


def _numbered(spark, sf_dir) -> DataFrame:
    """(page_id, cs): each track's few candidates in order, dealt out for work that costs much for each page."""
    c = candidates(spark, sf_dir).withColumnRenamed("track_id", "page_id").repartition(candidate_pieces(spark, sf_dir), "page_id").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("id", "artist", "title"))).alias("cs"))
    return c


def _page(head: str, row, tail: str = "") -> Column:
    """A page of one piece of markup for each candidate; row(artist, title, number, id)."""
    rows = F.array_join(F.transform("cs", lambda c, k: row(c["artist"], c["title"], (k + 1).cast("string"), c["id"].cast("string"))), "")
    return F.concat(F.lit(head), rows, F.lit(tail))


def _say(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _found(pages: DataFrame) -> DataFrame:
    return html_pages.page_tracklists(pages).select("page_id", "source", F.explode("tracks").alias("t")).select("page_id", "source", "t.position", "t.artist", "t.title", "t.time")


@query(f"{R} SELECT page_id, '1001tracklists' AS source, k AS position, artist, title, CAST(k AS VARCHAR) || ':00' AS time FROM r WHERE k % 3 <> 0")
def tracklist_site_pages(spark, sf_dir):
    row = lambda a, t, k, i: F.when(k.cast("int") % 3 == 0, F.lit('<div class="tlpItem">ID</div>')).otherwise(_say('<div class="tlpItem"><span class="trackValue">', a, " - ", t, '</span><span class="cueValueField">', k, ":00</span></div>"))
    return _found(_numbered(spark, sf_dir).select("page_id", F.lit("https://www.1001tracklists.com/tracklist/1/x.html").alias("url"), _page("<h1 id=pageTitle>Set</h1>", row).alias("html")))


@query(f"{R} SELECT page_id, 'mixesdb' AS source, k AS position, artist, title, CAST(NULL AS VARCHAR) AS time FROM r")
def wiki_pages(spark, sf_dir):
    row = lambda a, t, k, i: _say("<li>", k, ". ", a, " - ", t, "</li>")
    return _found(_numbered(spark, sf_dir).select("page_id", F.lit("http://www.mixesdb.com/w/x").alias("url"), _page("<ul><li>Menu - Entry point</li></ul><div><h2>Tracklist</h2><ol>", row, "</ol></div>").alias("html")))


@query(f"{R} SELECT page_id, 'web' AS source, k AS position, artist, title, CAST(NULL AS VARCHAR) AS time FROM r QUALIFY count(*) OVER (PARTITION BY page_id) >= 3")
def list_pages(spark, sf_dir):
    row = lambda a, t, k, i: _say("<li>", k, ". ", a, " / ", t)
    return _found(_numbered(spark, sf_dir).select("page_id", F.lit("http://any.example.com/x").alias("url"), _page("<h1>T</h1><ol>", row, "</ol>").alias("html")))


@query(f"{R} SELECT page_id, 'web' AS source, k AS position, artist, title, CAST(NULL AS VARCHAR) AS time FROM r QUALIFY count(*) OVER (PARTITION BY page_id) >= 3")
def table_pages(spark, sf_dir):
    row = lambda a, t, k, i: _say("<tr><td>", a, "<td>", t)
    return _found(_numbered(spark, sf_dir).select("page_id", F.lit("http://any.example.com/x").alias("url"), _page("<table>", row, "</table>").alias("html")))


@query(f"{R}, s AS (SELECT page_id, artist, title, min(k) AS k FROM r GROUP BY ALL) SELECT page_id, 'reddit' AS source, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INTEGER) AS position, artist, title, CAST(NULL AS VARCHAR) AS time FROM s")
def forum_pages(spark, sf_dir):
    """Lines of the three patterns in turn."""
    kind = lambda k: k.cast("int") % 3
    row = lambda a, t, k, i: _say(F.when(kind(k) == 0, _say(k, ". ")).when(kind(k) == 1, _say("[", F.lpad(k, 2, "0"), ":00] ")).otherwise(""), a, " - ", t, F.when(kind(k) == 0, " [Label]").otherwise(""), "\nhi\n")
    return _found(_numbered(spark, sf_dir).select("page_id", F.lit("https://old.reddit.com/r/x").alias("url"), _page("<h1>P</h1><div class='md'>intro\n", row, "</div>").alias("html")))


@query(f"{R} SELECT page_id, ['discogs', 'setlistfm', 'musicbrainz'][1 + page_id % 3] AS source, k AS position, ['Page Artist', 'Band', 'Maker'][1 + page_id % 3] AS artist, title, CAST(NULL AS VARCHAR) AS time FROM r")
def titled_pages(spark, sf_dir):
    """Pages whose tracks have the page's artist: discographies, setlists, open metadata."""
    discs = _page('<a href="/artist/9">Page Artist</a><table>', lambda a, t, k, i: _say('<tr class="tracklist_track"><td class="trackTitle">', t, "</td></tr>"), "</table>")
    songs = _page('<h1><a href="/setlists/x">Band</a></h1><a class="songLabel">no</a><ul>', lambda a, t, k, i: _say('<li class="song"><a class="songLabel">', t, "</a></li>"), "</ul>")
    media_ = _page('<p class="subheader"><a href="/artist/x">Maker</a></p><table class="medium"><tbody>', lambda a, t, k, i: _say('<tr><td class="title"><a><bdi>', t, "</bdi></a></td></tr>"), "</tbody></table>")
    pick = lambda *values: F.when(F.col("page_id") % 3 == 0, values[0]).when(F.col("page_id") % 3 == 1, values[1]).otherwise(values[2])
    return _found(_numbered(spark, sf_dir).select("page_id", pick(*(F.lit(f"https://www.{d}/x") for d in ("discogs.com", "setlist.fm", "musicbrainz.org"))).alias("url"), pick(discs, songs, media_).alias("html")))


@query(f"{T} SELECT id, CASE id % 4 WHEN 0 THEN 'http://x.example.com/a' || CAST(id AS VARCHAR) || '.jpg' WHEN 1 THEN 'http://h.example.com/c' || CAST(id AS VARCHAR) || '.png' WHEN 2 THEN 'http://h.example.com/m' || CAST(id AS VARCHAR) || '.webp' ELSE '' END AS cover_url FROM tracks")
def page_cover_choice(spark, sf_dir):
    i = F.col("id").cast("string")
    kinds = [_say('<meta property="og:image" content="http://x.example.com/a', i, '.jpg"><img class="cover" src="/no.jpg">'), _say('<img src="/first.jpg"><img class="cover" src="/c', i, '.png">'), _say('<main><img src="/logo.png"><img width="20" src="/small.png"><img src="/m', i, '.webp"></main>'), F.lit('<img src="/x.jpg">')]
    html = F.when(F.col("id") % 4 == 0, kinds[0]).when(F.col("id") % 4 == 1, kinds[1]).when(F.col("id") % 4 == 2, kinds[2]).otherwise(kinds[3])
    pages = dealt_tracks(spark, sf_dir).select("id", F.lit("http://h.example.com/p/q").alias("url"), html.alias("html"))
    return read_nodes(pages).select("id", html_pages.cover(F.col("url")).alias("cover_url"))


@query(f"{T} SELECT id, 1 AS n, 'http://x.example.com/a' || CAST(id AS VARCHAR) || '.jpg' AS url, 'h.example.com' AS source, 'T' AS title FROM tracks UNION ALL SELECT id, 2, 'https://y.example.com/' || CAST(id AS VARCHAR) || '.jpg', 'h.example.com', 'Alt' FROM tracks")
def page_cover_options(spark, sf_dir):
    i = F.col("id").cast("string")
    html = _say('<title>T</title><meta property="og:image" content="http://x.example.com/a', i, '.jpg"><img class="cover" src="//y.example.com/', i, '.jpg" alt="Alt"><img class="cover" src="/icon.png"><img src="/other.jpg">')
    pages = dealt_tracks(spark, sf_dir).select("id", F.lit("http://www.h.example.com/p").alias("url"), html.alias("html"))
    return html_pages.page_covers(pages, "id").select("id", F.posexplode("covers").alias("n", "c")).select("id", (F.col("n") + 1).alias("n"), "c.url", "c.source", "c.title")


@query(f"""{R}, f AS (SELECT page_id, k, 1 AS m, 'http://x.example.com/' || CAST(id % 100000 AS VARCHAR) || '.jpg' AS url FROM r WHERE k <= 10 UNION ALL SELECT page_id, k, 2, 'http://x.example.com/all.jpg' FROM r WHERE k <= 10),
o AS (SELECT page_id, url, min(k * 10 + m) AS first_at FROM f GROUP BY 1, 2) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first_at) AS option_no, url FROM o QUALIFY option_no <= 20""")
def cover_search(spark, sf_dir):
    part = F.col("c.id") % 100000
    hits = _numbered(spark, sf_dir).select("page_id", F.posexplode("cs").alias("k", "c")).select("page_id", F.lit(1).alias("query_no"), (F.col("k") + 1).alias("pos"), _say("http://h.example.com/", part.cast("string")).alias("url"))
    own = F.regexp_extract("url", r"(\d+)$", 1)
    cover = lambda u: F.struct(u.alias("url"), F.lit("s").alias("source"), F.lit("t").alias("title"))
    covers = hits.select("url").distinct().select("url", F.array(cover(_say("http://x.example.com/", own, ".jpg")), cover(F.lit("http://x.example.com/all.jpg"))).alias("covers"))
    return site_search.cover_options(hits, covers, "page_id", pieces=candidate_pieces(spark, sf_dir)).select("page_id", F.col("option_no").cast("long").alias("option_no"), "url")


@query(f"""{R} SELECT page_id AS query, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k % 2 = 0, k) AS INTEGER) AS pos, CASE WHEN k % 2 = 1 THEN 'tracklist' ELSE 'track' END AS type, title,
 CASE WHEN k % 2 = 1 THEN 'https://www.1001tracklists.com/tracklist/' || CAST(id AS VARCHAR) ELSE '/t/' || CAST(id AS VARCHAR) END AS url, CASE WHEN k % 2 = 1 THEN artist END AS dj, CASE WHEN k % 2 = 0 THEN artist || ' - ' || title END AS full_title, CASE WHEN k % 2 = 0 THEN artist END AS artist, CASE WHEN k % 2 = 0 THEN 'House' END AS genre, CASE WHEN k % 2 = 0 THEN 'L1|L2' END AS labels FROM r""")
def site_search_rows(spark, sf_dir):
    row = lambda a, t, k, i: F.when(k.cast("int") % 2 == 1, _say('<div class="tlLink"><a href="/tracklist/', i, '"> ', t, ' </a><span class="artistName">', a, "</span></div>")).otherwise(_say('<div class="tlpItem"><span class="trackValue">', a, "&nbsp;- ", t, '</span><meta itemprop="genre" content="House"><meta itemprop="url" content="/t/', i, '"><span title="label">L1</span><span title="label"> L2</span></div>'))
    pages = _numbered(spark, sf_dir).select(F.col("page_id").alias("query"), _page("", row).alias("html"))
    return site_search.site_search(pages).withColumn("labels", F.array_join("labels", "|"))


@query(f"{R}, f AS (SELECT page_id, title, min(k) AS k FROM r GROUP BY 1, 2) SELECT page_id AS query, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INTEGER) AS pos, title, 'https://www.1001tracklists.com/tracklist/' || replace(title, ' ', '') AS url FROM f")
def site_link_fallback(spark, sf_dir):
    row = lambda a, t, k, i: _say('<p><a href="/tracklist/', F.replace(t, F.lit(" "), F.lit("")), '">', t, '</a><a href="/dj/x">', a, "</a></p>")
    pages = _numbered(spark, sf_dir).select(F.col("page_id").alias("query"), _page("", row).alias("html"))
    return site_search.site_search(pages).select("query", "pos", "title", "url")


@query(f"""{R} SELECT page_id, CAST(page_id AS VARCHAR) AS tracklist_id, 'Set ' || CAST(page_id AS VARCHAR) AS title, CAST(count(*) AS INTEGER) AS n_tracks, string_agg(artist || '/' || title, ',' ORDER BY k) AS tracks, string_agg(CAST(k AS VARCHAR) || ':00', ',' ORDER BY k) AS cues,
 'http://i.example.com/' || CAST(page_id AS VARCHAR) || '.jpg' AS cover_url, 'Ann' AS dj, 'House,Deep House' AS genres, '2020-01-02' AS date_recorded, 'Waves' AS radio, CAST(count(*) + 3 AS INTEGER) AS num_tracks FROM r GROUP BY 1""")
def tracklist_details(spark, sf_dir):
    p = F.col("page_id").cast("string")
    row = lambda a, t, k, i: _say('<div class="tlpItem"><div class="cueValueField"> ', k, ':00 </div><span class="trackValue">', a, " - ", t, "</span></div>")
    left = _say("<title>Set ", p, '</title><meta property="og:image" content="http://i.example.com/', p, '.jpg"><div id="left"><table class="sideTop"><tr><td><a href="/dj/ann">Ann</a></td></tr></table><table class="sideTop"><tr><td>Radio <span><a href="/source/w"> Waves </a></span></td></tr></table><table><tr><td><span title="tracklist recording date">d</span></td><td> 2020-01-02</td></tr><tr><td id="tl_music_styles">House, Deep House</td></tr></table>IDed 1 / ', (F.size("cs") + 3).cast("string"), " tracks short</div>")
    pages = _numbered(spark, sf_dir).select("page_id", _say("https://www.1001tracklists.com/tracklist/", p, "/x.html").alias("url"), F.concat(left, _page("", row)).alias("html"))
    d = site_search.tracklist_pages(pages)
    named = F.transform("tracks", lambda t: F.concat(t["artist"], F.lit("/"), t["title"]))
    return d.select("page_id", "tracklist_id", "title", F.size("tracks").alias("n_tracks"), F.array_join(named, ",").alias("tracks"), F.array_join("cues", ",").alias("cues"), "cover_url", F.array_join("djs", ",").alias("dj"), F.array_join("genres", ",").alias("genres"), "date_recorded", F.try_element_at("sources", F.lit("Radio")).alias("radio"), "num_tracks")


_SHOW = r"'Waves ' || CAST(id AS VARCHAR)"


@query(rf"{T} SELECT {_SHOW} AS query, CASE WHEN id % 2 = 1 THEN 'Own' ELSE {_SHOW} || ' live' END AS title, 'https://www.1001tracklists.com/tracklist/' || CASE WHEN id % 2 = 1 THEN 'o' ELSE 's' END || CAST(id AS VARCHAR) AS url FROM tracks WHERE id % 2 = 1 OR id >= 10")
def combined_search(spark, sf_dir):
    i = F.col("id").cast("string")
    t = dealt_tracks(spark, sf_dir).select("id", _say("Waves ", i).alias("query"))
    searched = t.select("query", F.when(F.col("id") % 2 == 1, _say('<div class="tlLink"><a href="/tracklist/o', i, '">Own</a></div>')).otherwise("").alias("html"))
    shows = t.select("query", _say('<a href="/tracklist/x">other</a><a href="/tracklist/s', i, '">', F.col("query"), " live</a>").alias("html"))
    return site_search.combined_search(searched, shows).select("query", "title", "url")


@query(f"""{R}, h AS (SELECT page_id, 1 + k // 4 AS query_no, k AS pos, CASE WHEN k = 2 THEN 'http://youtube.com/' ELSE 'http://s.example.com/' END || CAST(id % 10 AS VARCHAR) AS url FROM r),
w AS (SELECT page_id, url, min(query_no * 100 + pos) AS first_at FROM h WHERE query_no <= 5 AND pos <= 5 GROUP BY 1, 2)
SELECT page_id AS track_id, row_number() OVER (PARTITION BY page_id ORDER BY first_at) AS result_no, url AS tracklist_url, 'A' AS artist, 3 AS num_tracks, 'google_search' AS match_type, '' AS genre FROM w WHERE url NOT LIKE '%youtube%' QUALIFY result_no <= 5""")
def search_pipeline(spark, sf_dir):
    k = F.col("k") + 1
    url = _say(F.when(k == 2, "http://youtube.com/").otherwise("http://s.example.com/"), (F.col("c.id") % 10).cast("string"))
    hits = _numbered(spark, sf_dir).select("page_id", F.posexplode("cs").alias("k", "c")).select(F.col("page_id").alias("track_id"), (F.floor(k / 4) + 1).cast("int").alias("query_no"), k.alias("pos"), url.alias("url"), F.lit("t").alias("title"), F.lit("").alias("snippet"), text.domain(url).alias("domain"))
    pages = hits.select("url").distinct().select("url", F.lit("<ol><li>A / x<li>B / y<li>C / z</ol>").alias("html"), F.col("url").alias("page_id"))
    found = site_search.search_results(hits, html_pages.page_tracklists(pages).drop("page_id").withColumn("artist", F.lit("A")))
    shaped = site_search.result_candidates(found.withColumn("confidence", F.lit(60.0)), "track_id")
    stored = site_search.stored_candidates(shaped).select("track_id", "tracklist_url", "artist", "num_tracks", "match_type", "genre")
    return stored.join(found.select("track_id", F.col("source_url").alias("tracklist_url"), F.col("result_no").cast("long").alias("result_no")), ["track_id", "tracklist_url"]).select("track_id", "result_no", "tracklist_url", "artist", "num_tracks", "match_type", "genre")


@query(f"""{R}, l AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INTEGER) AS pos, 'http://www.a.example.com/' || CAST(id AS VARCHAR) AS url, title, 'a.example.com' AS domain FROM r WHERE k % 3 <> 0 AND k <= 6 AND page_id % 2 = 0),
g AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INTEGER) AS pos, 'http://b.example.com/?i=' || CAST(id AS VARCHAR) AS url, title, 'b.example.com' AS domain FROM r WHERE k % 3 <> 0 AND k <= 3 AND page_id % 2 = 1)
SELECT page_id AS query, pos, url, title, domain FROM (SELECT * FROM l UNION ALL SELECT * FROM g) WHERE pos <= 3""")
def web_hits(spark, sf_dir):
    """Even queries have hits in the plain source, odd ones in the other alone."""
    third = lambda k: k.cast("int") % 3 == 0
    plain = _page("", lambda a, t, k, i: _say('<a class="result-link" href="', F.when(third(k), "/in/").otherwise("http://www.a.example.com/"), i, '">', t, "</a>"))
    rich = _page("", lambda a, t, k, i: _say('<div class="g"><a href="', F.when(third(k), "http://www.google.com/").otherwise("/url?sa=1&q=http%3A%2F%2Fb.example.com%2F%3Fi%3D"), i, '"><h3>', t, "</h3></a></div>"))
    n = _numbered(spark, sf_dir).withColumnRenamed("page_id", "query")
    return site_search.web_hits(n.select("query", F.when(F.col("query") % 2 == 0, plain).alias("html")), n.select("query", rich.alias("html")), "query", 3).select("query", "pos", "url", "title", "domain")


# names and addresses
@query(r"""SELECT p_partkey, p_name AS show, lpad(CAST(p_size AS VARCHAR), 3, '0') AS episode, p_size AS number, replace(p_name, ' ', '+') AS encoded, 'http://t.example.com/a?b=' || CAST(p_partkey AS VARCHAR) AS target,
 'http://h.example.com/x/' || CAST(p_partkey AS VARCHAR) AS rooted, 'http://h.example.com/d/' || CAST(p_partkey AS VARCHAR) AS relative, p_partkey AS listed FROM part""")
def name_parts(spark, sf_dir):
    k, page = F.col("p_partkey").cast("string"), F.lit("http://h.example.com/d/e.html")
    episode = F.lpad(F.col("p_size").cast("string"), 3, "0")
    s = text.show_episode(_say(F.col("p_name"), " - ", episode))
    return read(spark, sf_dir, "part").select(
        "p_partkey", s["show"].alias("show"), s["episode"].alias("episode"), text.episode_number(episode).alias("number"), F.url_encode("p_name").alias("encoded"), text.unwrapped(_say("/url?sa=t&q=http%3A%2F%2Ft.example.com%2Fa%3Fb%3D", k, "&x=1")).alias("target"),
        text.absolute_url(_say("/x/", k), page).alias("rooted"), text.absolute_url(k, page).alias("relative"), jsonmeta.listed_count(_say("IDed 3 / ", k)).cast("long").alias("listed"),
    )


_PART = "CASE WHEN contains(filename, ' - ') THEN split_part(filename, ' - ', {0}) ELSE '' END"


@query(f"""{T}, e AS (SELECT id, {_CLEANED.format('artist')} AS a, {_CLEANED.format("coalesce(title, '')")} AS t, {_CLEANED.format('filename')} AS f, {_CLEANED.format(_PART.format(1))} AS p, {_CLEANED.format(_PART.format(2))} AS q FROM tracks),
l AS (SELECT id, list_filter([a, t, f], lambda x: length(x) >= 3) AS b, p, q FROM e),
m AS (SELECT id, CASE WHEN length(p) >= 3 AND NOT list_contains(b, p) THEN list_append(b, p) ELSE b END AS b, q FROM l)
SELECT id, array_to_string(CASE WHEN length(q) >= 3 AND NOT list_contains(b, q) THEN list_append(b, q) ELSE b END, '|') AS terms FROM m""")
def search_term_lists(spark, sf_dir):
    c = [F.col(x) for x in ("artist", "title", "filename")]
    return tracks(spark, sf_dir).select("id", F.array_join(text.search_terms(*c), "|").alias("terms"))


@query(f"""{C}, d AS (SELECT 'http://site.example.com/tracklist/' || CAST(p_partkey AS VARCHAR) || '/x.html' AS url, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS d_dj FROM part WHERE p_partkey % 3 <> 0),
m AS (SELECT track_id, id, tracklist_url AS url, dj, row_number() OVER (PARTITION BY track_id ORDER BY confidence DESC, id) AS rank FROM candidates)
SELECT track_id, id, CASE WHEN rank <= 3 AND d.url IS NOT NULL THEN d_dj ELSE dj END AS dj FROM m LEFT JOIN d USING (url)""")
def enriched_matches(spark, sf_dir):
    c = candidates(spark, sf_dir).select("track_id", F.col("id").alias("pos"), F.col("confidence").alias("score"), F.col("tracklist_url").alias("url"), "dj", F.lit(None).cast("string").alias("event"), F.lit(None).cast("string").alias("date_recorded"))
    p = read(spark, sf_dir, "part").where("p_partkey % 3 <> 0")
    details = p.select(_say("http://site.example.com/tracklist/", F.col("p_partkey").cast("string"), "/x.html").alias("url"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("dj"), F.lit(None).cast("string").alias("event"), F.lit(None).cast("string").alias("date_recorded"))
    return matching.enriched(matching.top_matches(c, 0, 1000), details).select("track_id", F.col("pos").alias("id"), "dj")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS event, p_type AS last_value, CASE p_partkey % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'first' ELSE 'large' END AS picture FROM part")
def json_choices(spark, sf_dir):
    """A map's first festival or event, the last of equal keys, and the front picture of a list."""
    k = F.col("p_partkey")
    sources = F.map_from_arrays(F.array(F.lit("Radio"), F.when(k % 2 == 0, F.lit("Open Air Festival")).otherwise("Club")), F.array(F.lit("x"), F.col("p_brand")))
    pair = lambda a, b: F.struct(F.lit(a).alias("key"), b.alias("value"))
    pairs = F.array(pair("genre", F.lit("old")), pair("url", F.lit("u")), pair("genre", F.col("p_type")))
    body = F.when(k % 3 == 0, '[{"front":false,"image":"first"},{"front":true,"image":"front"}]').when(k % 3 == 1, '[{"image":"first"},{"front":false,"image":"second"}]').otherwise('[{"front":true,"thumbnails":{"large":"large"}}]')
    return read(spark, sf_dir, "part").select("p_partkey", matching.event_source(sources).alias("event"), F.try_element_at(jsonmeta.meta_map(pairs), F.lit("genre")).alias("last_value"), jsonmeta.front_cover(F.from_json(body, jsonmeta.IMAGES)).alias("picture"))


@query("SELECT c.c_custkey, CAST(n AS INTEGER) AS n_tracks, 'T' || CAST(n AS VARCHAR) AS last_title, true AS same FROM (SELECT c_custkey, 1 + c_custkey % 4 AS n FROM customer) c")
def candidate_json_column(spark, sf_dir):
    """Extracted tracks are JSON at the boundary: written as text and read back."""
    tracks_ = F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 4 + 1).cast("int")), lambda k: F.struct(k.alias("position"), F.lit("A").alias("artist"), _say("T", k.cast("string")).alias("title"), F.lit(None).cast("string").alias("time")))
    c = read(spark, sf_dir, "customer").select("c_custkey", tracks_.alias("extracted_tracks"))
    back = site_search.candidates_from_json(site_search.candidates_to_json(c)).withColumnRenamed("extracted_tracks", "back")
    return c.join(back, "c_custkey").select("c_custkey", F.size("back").alias("n_tracks"), F.element_at("back", -1)["title"].alias("last_title"), (F.col("back") == F.col("extracted_tracks")).alias("same"))


# edits and reports
@query(f"{T} SELECT id, filepath, filename, directory, title, artist, duration, file_size, bitrate, fingerprint_hash FROM tracks WHERE fingerprint_hash IN (SELECT fingerprint_hash FROM tracks GROUP BY 1 HAVING count(*) > 1)")
def duplicate_rows(spark, sf_dir):
    t = tracks(spark, sf_dir)
    groups = duplicates.duplicate_groups(t).select("fingerprint_hash")
    return t.join(groups, "fingerprint_hash", "left_semi").select(*DUPLICATE_COLUMNS, "fingerprint_hash")


@query("WITH f AS (SELECT doc_id AS id, left(sha256(text), 32) AS fingerprint_hash FROM documents) SELECT fingerprint_hash, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM f GROUP BY 1 HAVING count(*) > 1")
def duplicate_members(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("file_size"), media.fingerprint_hash(F.col("text")).alias("fingerprint_hash"))
    return duplicates.group_members(files).select("fingerprint_hash", F.array_join(F.transform("members", lambda m: m["id"].cast("string")), ",").alias("members"))


@query(f"{T} SELECT id, filepath, starts_with(filepath, '/music/FRANCE/') AS allowed FROM tracks WHERE id % 5 = 0")
def delete_plan(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return dml.files_to_delete(t, t.where("id % 5 = 0").select("id"), "/music/FRANCE")


@query(f"{T}, p AS (SELECT id, regexp_replace(filepath, '/[^/]*$', '') || '/' || CAST(id AS VARCHAR) || '.mp3' AS n FROM tracks WHERE id % 2 = 0) SELECT id, coalesce(n, filepath) AS filepath, CASE WHEN n IS NULL THEN filename ELSE CAST(id AS VARCHAR) || '.mp3' END AS filename FROM tracks LEFT JOIN p USING (id)")
def apply_renames(spark, sf_dir):
    t = tracks(spark, sf_dir)
    name = _say(F.col("id").cast("string"), ".mp3")
    plan = t.select("id", "filepath", _say(text.dirname(F.col("filepath")), "/", name).alias("new_path"), (F.col("id") % 2 == 1).alias("collides"))
    return dml.apply_renames(t, plan).select("id", "filepath", "filename")


@query(f"{T} SELECT id, CASE WHEN id % 2 = 0 THEN 'new' ELSE fingerprint_hash END AS fingerprint_hash FROM tracks")
def refresh_fingerprints(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return dml.store_fingerprints(t, t.where("id % 2 = 0").select("id", F.lit("new").alias("fingerprint_hash")), overwrite=True).select("id", "fingerprint_hash")


@query(f"{T} SELECT id, status = 'matched' AS accepted, CASE WHEN status <> 'matched' THEN 'status is ' || status END AS reason FROM tracks")
def tagging_precondition(spark, sf_dir):
    return dml.taggable(tracks(spark, sf_dir)).select("id", "accepted", "reason")


_Q = "coalesce(nullif(matched_{0}, ''), nullif({0}, ''))"


@query(f"""{T}, w AS (SELECT id, {_Q.format('title')} AS title, {_Q.format('artist')} AS artist, {_Q.format('album')} AS album, {_Q.format('genre')} AS genre, nullif(matched_cover_url, '') AS cover FROM tracks)
SELECT id, 'full' AS kind, concat_ws('|', 'title=' || title, 'artist=' || artist, 'album=' || album, 'genre=' || genre, 'cover=' || cover) AS tags FROM w UNION ALL
SELECT id, 'series', concat_ws('|', 'artist=' || artist, 'album=' || album, 'genre=' || genre, 'marker=m') FROM w UNION ALL SELECT id, 'cover', concat_ws('|', 'artist=' || artist, 'album=' || album, 'genre=' || genre, 'cover=' || cover) FROM w""")
def desired_tags(spark, sf_dir):
    """What the three tag writers want in each file: all fields with the cover, series fields with the marker, series fields with the cover alone."""
    t = tracks(spark, sf_dir)
    plans = [("full", dml.desired_tags(t, ("title", "artist", "album", "genre"), cover=True)), ("series", dml.desired_tags(t, ("artist", "album", "genre"), marker="m")), ("cover", dml.desired_tags(t, ("artist", "album", "genre"), cover=True))]
    out = None
    for kind, df in plans:
        df = df.select("id", F.lit(kind).alias("kind"), F.array_join(F.transform("tags", lambda x: _say(x["field"], "=", x["value"])), "|").alias("tags"))
        out = df if out is None else out.unionByName(df)
    return out


@query(f"{T}, v AS (SELECT DISTINCT field, value FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, coalesce(matched_{f}, {f}) AS value FROM tracks" for f in ("genre", "artist")) + ") WHERE value <> '') SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY value) AS place FROM v")
def sorted_facets(spark, sf_dir):
    return catalog.sorted_facets(tracks(spark, sf_dir), "genre", "artist").withColumn("place", F.col("place").cast("long"))


@query("SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS total_tracks FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def group_totals(spark, sf_dir):
    return catalog.group_totals(read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("track_count")))


@query("""SELECT vec_id, round(list_sum(list_transform(range(100), lambda i: least(0.95, greatest(0.15, 0.3 + 0.15 * sin(i * 0.15) + 0.4 * (((vec_id * 12345 + i * 7919) % 1000) / 1000.0))))), 6) AS fallback,
 round(list_max(list_transform(range(16), lambda b: list_sum(list_transform(embedding[b * (len(embedding) // 16) + 1 : (b + 1) * (len(embedding) // 16)], lambda x: abs(CAST(x AS DOUBLE)))) / (len(embedding) // 16))), 6) AS top FROM embeddings""")
def waveform_sums(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    total = F.aggregate(media.fallback_waveform(F.col("vec_id")), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.round(total, 6).alias("fallback"), F.round(F.array_max(media.block_means(F.col("embedding"), 16)), 6).alias("top"))


@query(f"{T} SELECT id, CAST(NULL AS INTEGER) AS sample_rate, CAST(NULL AS VARCHAR) AS error_message, status FROM tracks")
def additive_migration(spark, sf_dir):
    return catalog.migrated(tracks(spark, sf_dir).drop("sample_rate", "error_message"), "sample_rate int, error_message string, status string").select("id", "sample_rate", "error_message", "status")


@query(f"{T} SELECT id, f.* FROM tracks, LATERAL (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS old_value, nullif(matched_{f}, '') AS new_value WHERE nullif(matched_{f}, '') IS DISTINCT FROM {f} AND nullif(matched_{f}, '') IS NOT NULL" for f in ("title", "artist", "album", "genre", "year")) + " UNION ALL SELECT 'cover_art', 'None', 'Will be added' WHERE matched_cover_url <> '' AND id % 2 <> 0) f")
def tag_changes(spark, sf_dir):
    t = tracks(spark, sf_dir)
    preview = dml.tag_preview(t, t.select("id", (F.col("id") % 2 == 0).alias("has_cover"), "title", "artist", "album", "genre", "year"))
    return preview.select("id", F.explode("changes").alias("c")).select("id", "c.field", "c.old_value", "c.new_value")
