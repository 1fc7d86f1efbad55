"""Queries of matching, metadata documents and search texts that SQL holds branch by branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import media, text
from ..functions.similarity import token_similarity
from ..operators import dml, html_pages, jsonmeta, matching
from ..sources.markup import read_nodes
from .adapters import candidate_pieces, candidates, dealt_tracks, pieces, placed_candidates, tracks
from .queries import _CLEANED, C, T, _tokens, query

#: Candidates' identifiers may repeat; with their confidence they tell different ones apart.
_AT = "id * 128 + CAST(confidence AS BIGINT)"
_ROWS = f"{C}, p AS (SELECT track_id, {_AT} AS id, tracklist_url AS url, confidence AS score FROM candidates WHERE id % 3 = 0 AND confidence >= 50), d AS (SELECT track_id, {_AT} AS id, CAST(id % 4 AS INT) AS term_no, tracklist_url AS url, confidence AS score FROM candidates WHERE id % 3 <> 0)"


@query(f"""{_ROWS}, s AS (SELECT t.id AS track_id, CASE WHEN t.id % 5 = 0 THEN 3 WHEN (SELECT count(*) FROM p WHERE p.track_id = t.id) < 2 THEN 2 ELSE 0 END AS terms FROM tracks t),
m AS (SELECT d.*, s.terms FROM d JOIN s USING (track_id) WHERE term_no < terms QUALIFY row_number() OVER (PARTITION BY track_id, url ORDER BY term_no, id) = 1),
e AS (SELECT track_id, url, score, 'search' AS path, -1 AS term_no, id FROM p UNION ALL
 SELECT track_id, url, score, CASE terms WHEN 3 THEN 'fallback' ELSE 'direct' END, term_no, id FROM m WHERE score >= 50 AND NOT EXISTS (SELECT 1 FROM p WHERE p.track_id = m.track_id AND p.url = m.url))
SELECT track_id, url, score, path, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, term_no, id) AS rank FROM e QUALIFY rank <= 10""")
def match_paths(spark, sf_dir):
    c = candidates(spark, sf_dir).select("track_id", "id", F.expr(_AT).alias("pos"), F.col("tracklist_url").alias("url"), F.col("confidence").alias("score"))
    t, is_primary = tracks(spark, sf_dir), F.col("id") % 3 == 0
    direct = c.where(~is_primary).withColumn("term_no", (F.col("id") % 4).cast("int"))
    found = matching.matched_paths(t, c.where(is_primary), direct, t.where("id % 5 = 0").select(F.col("id").alias("track_id")))
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(f"{C} SELECT c.id, track_id, filename, row_number() OVER (PARTITION BY track_id ORDER BY confidence DESC, c.id) AS place FROM candidates c JOIN (SELECT id AS track_id, filename FROM tracks) USING (track_id)")
def candidate_places(spark, sf_dir):
    return matching.candidate_places(tracks(spark, sf_dir), candidates(spark, sf_dir)).select("id", "track_id", "filename", F.col("place").cast("long").alias("place"))


def _acoustic(spark, sf_dir) -> DataFrame:
    """Two results for each track, of its candidates that are sure and of the others; of equal identifiers the first row of the table comes first."""
    recording = F.struct(F.col("id").cast("string").alias("id"), "title", F.array(F.struct(F.col("artist").alias("name")), F.struct(F.lit("Guest").alias("name"))).alias("artists"), F.array(F.struct(F.col("genre").alias("title"))).alias("releases"))
    c = placed_candidates(spark, sf_dir).groupBy("track_id", (F.col("confidence") >= 60).alias("sure")).agg(F.array_sort(F.collect_list(F.struct("id", "place", recording.alias("r")))).alias("rs"))
    score = F.when(F.col("sure"), 0.9).otherwise(0.5)
    return c.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct(F.lit(1) - score.alias("score"), F.struct(score.alias("score"), F.transform("rs", lambda x: x["r"]).alias("recordings")).alias("r")))).alias("x")).select("track_id", F.transform("x", lambda x: x["r"]).alias("results"))


@query(f"""{C}, g AS (SELECT track_id, confidence >= 60 AS sure, list(CAST(id AS VARCHAR) ORDER BY id) AS ids, arg_min(title, id) AS title, arg_min(artist, id) AS artist, arg_min(genre, id) AS album FROM candidates GROUP BY 1, 2)
SELECT track_id, CASE WHEN sure THEN 0.9 ELSE 0.5 END::DOUBLE AS score, title, artist || ', Guest' AS artist, album, array_to_string(ids[2:10], ',') AS alternatives FROM g QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY sure DESC) = 1""")
def acoustid_alternatives(spark, sf_dir):
    best = jsonmeta.best_acoustic(_acoustic(spark, sf_dir), "track_id")
    return best.select("track_id", F.col("score").cast("double").alias("score"), "title", "artist", "album", F.array_join(F.transform("alternatives", lambda r: r["id"]), ",").alias("alternatives"))


@query(f"""{C} SELECT CAST(id AS VARCHAR) AS id, title, artist || ', B' AS artist, CASE WHEN id % 2 = 0 THEN '' ELSE '2020-01-01' END AS date, '' AS country, CAST(CASE WHEN id % 3 = 0 THEN 0 ELSE id % 20 END AS INT) AS track_count,
 CASE WHEN id % 5 = 0 THEN '' ELSE genre || ', Other' END AS label, CAST(confidence AS INT) AS score FROM candidates""")
def releases(spark, sf_dir):
    c, i = candidates(spark, sf_dir), F.col("id")
    named = lambda kind, *values: F.array(*(F.struct(F.struct(v.alias("name")).alias(kind)) for v in values))
    release = F.struct(i.cast("string").alias("id"), "title", named("artist", F.col("artist"), F.lit("B")).alias("artist-credit"), F.when(i % 2 != 0, "2020-01-01").alias("date"), F.when(i % 3 != 0, i % 20).alias("track-count"), F.when(i % 5 != 0, named("label", F.col("genre"), F.lit("Other"))).alias("label-info"), F.col("confidence").cast("int").alias("score"))
    docs = c.repartition(candidate_pieces(spark, sf_dir), "track_id").groupBy("track_id").agg(F.to_json(F.struct(F.collect_list(release).alias("releases"))).alias("body"))
    return jsonmeta.releases(docs)


@query(f"""{C} SELECT track_id, CAST(id % 2 + 1 AS INT) AS disc, CAST(row_number() OVER (PARTITION BY track_id, id % 2 ORDER BY id) AS INT) AS position, title, CASE WHEN id % 3 <> 0 THEN id % 1000 ELSE -1 END AS length, CAST(id AS VARCHAR) AS recording_id FROM candidates""")
def release_tracks(spark, sf_dir):
    c, i = candidates(spark, sf_dir), F.col("id")
    one = F.struct("id", "title", F.when(i % 3 != 0, i % 1000).alias("length"))
    media = c.groupBy("track_id", (i % 2 + 1).alias("disc")).agg(F.array_sort(F.collect_list(one)).alias("ts"))
    listed = F.transform("ts", lambda t, k: F.struct((k + 1).alias("position"), t["title"].alias("title"), t["length"].alias("length"), F.struct(t["id"].cast("string").alias("id")).alias("recording")))
    docs = media.groupBy("track_id").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("disc").alias("position"), listed.alias("tracks"))).alias("media"))).alias("body"))
    return jsonmeta.release_tracks(docs, "track_id").withColumn("length", F.coalesce("length", F.lit(-1)))


_PARTS = "string_split(filename, ' - ')"
_TERMS = f"""{T}, c AS (SELECT id, artist, title, filename, list_filter([{_CLEANED.format('artist')}, {_CLEANED.format("coalesce(title, '')")}, {_CLEANED.format('filename')}], lambda x: length(x) >= 3) AS base,
 {_CLEANED.format(f'{_PARTS}[1]')} AS p1, {_CLEANED.format(f'{_PARTS}[2]')} AS p2 FROM tracks),
o AS (SELECT *, CASE WHEN length(p1) >= 3 AND NOT list_contains(base, p1) THEN list_append(base, p1) ELSE base END AS one FROM c)"""


@query(f"{_TERMS} SELECT id, array_to_string(CASE WHEN length(p2) >= 3 AND NOT list_contains(one, p2) THEN list_append(one, p2) ELSE one END, '|') AS terms FROM o")
def search_term_lists(spark, sf_dir):
    terms = text.search_terms(F.col("artist"), F.col("title"), F.col("filename"))
    return tracks(spark, sf_dir).select("id", F.array_join(terms, "|").alias("terms"))


_BARE = r"regexp_replace({0}, '(?i)\.(mp3|flac|wav|m4a)$', '')"
_SPACED = r"replace(replace(regexp_replace({0}, '^\d+[-_\s]*', ''), '_', ' '), '-', ' - ')"
_NAME = r"trim(replace(replace(regexp_replace(regexp_replace(regexp_replace({0}, '^\d+[-_\s]*', ''), '\s*\(\d{{4}}[-/]\d{{2}}[-/]\d{{2}}\)', '', 'g'), '(?i)\s*Part\s*\d+\s*$', ''), '_', ' '), ' - ', ' '))"


@query(f"""{T}, v AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE artist END AS artist, title, CASE WHEN id % 11 = 0 THEN '07_' || replace(filename, '.mp3', '_Part 2.FLAC') ELSE filename END AS filename FROM tracks),
n AS (SELECT *, {_NAME.format(_BARE.format('filename'))} AS name FROM v)
SELECT id, concat_ws('|', concat_ws(' ', '"' || artist || '"', {_SPACED.format(_BARE.format('coalesce(title, filename)'))}, 'tracklist'), name || ' tracklist', 'site:1001tracklists.com "' || artist || '"', 'site:mixesdb.com ' || name,
 CASE WHEN artist IS NOT NULL AND length(title) > 10 THEN title || ' dj mix tracklist' END) AS queries FROM n WHERE artist IS NOT NULL OR title IS NOT NULL""")
def search_query_variants(spark, sf_dir):
    i = F.col("id")
    t = tracks(spark, sf_dir).select("id", "title", F.when(i % 7 != 0, F.col("artist")).alias("artist"), F.when(i % 11 == 0, F.concat(F.lit("07_"), F.replace("filename", F.lit(".mp3"), F.lit("_Part 2.FLAC")))).otherwise(F.col("filename")).alias("filename"))
    queries = text.search_queries(F.col("artist"), F.col("title"), F.col("filename"))
    return t.where("artist is not null or title is not null").select("id", F.array_join(queries, "|").alias("queries"))


@query(f"""{T} SELECT id, n, CASE n WHEN 1 THEN 'http://h.example.com/' WHEN 2 THEN 'https://y.example.com/' ELSE 'http://h.example.com/art/' END || CAST(id AS VARCHAR) || '.jpg' AS url, CASE n WHEN 1 THEN 'The Cover' WHEN 2 THEN 'h.example.com' ELSE 'artwork ' || CAST(id AS VARCHAR) END AS title FROM tracks, (VALUES (1), (2), (3)) v(n) WHERE n < 3 OR id % 2 = 0""")
def page_covers_by_text(spark, sf_dir):
    """Pictures that only their alternative text tells apart, and one of a light box."""
    i = F.col("id").cast("string")
    html = F.concat(F.lit('<img alt="Logo" src="/no.jpg"><img alt="The Cover" src="/'), i, F.lit('.jpg"><img data-lightbox="x" src="//y.example.com/'), i, F.lit('.jpg">'), F.when(F.col("id") % 2 == 0, F.concat(F.lit('<p><img alt="artwork '), i, F.lit('" data-src="/art/'), i, F.lit('.jpg"></p>'))).otherwise(F.lit("")))
    pages = dealt_tracks(spark, sf_dir).select(F.col("id").alias("page_id"), F.lit("http://h.example.com/p/q").alias("url"), html.alias("html"))
    covers = html_pages.page_covers(pages).select(F.col("page_id").alias("id"), F.explode("covers").alias("c"))
    kind = F.when(F.startswith(F.col("c.url"), F.lit("https")), 2).when(F.contains(F.col("c.url"), F.lit("/art/")), 3).otherwise(1)
    return covers.select("id", kind.alias("n"), "c.url", "c.title")


@query(f"{T} SELECT id, CASE id % 4 WHEN 0 THEN 'A B' WHEN 1 THEN 'A' WHEN 2 THEN '' ELSE 'DJ X' END AS artist, CASE id % 4 WHEN 0 THEN 'C - D ' || CAST(id AS VARCHAR) WHEN 1 THEN 'Live' WHEN 2 THEN 'alone ' || CAST(id AS VARCHAR) ELSE 'club @ 2' END AS title FROM tracks")
def filename_metadata_branches(spark, sf_dir):
    i = F.col("id").cast("string")
    names = F.when(F.col("id") % 4 == 0, F.concat(F.lit("A B - C - D "), i, F.lit(".mp3"))).when(F.col("id") % 4 == 1, F.lit("A @ Live.flac")).when(F.col("id") % 4 == 2, F.concat(F.lit("alone "), i, F.lit(".mp3"))).otherwise(F.lit("DJ X @ club @ 2.wav"))
    found = tracks(spark, sf_dir).select("id", text.filename_metadata(names).alias("m"))
    return found.select("id", F.coalesce("m.artist", F.lit("")).alias("artist"), "m.title")


@query(f"{T} SELECT id, n, CASE WHEN id % 2 = 0 THEN '#text' ELSE 'b' END AS tag FROM tracks, (VALUES (1), (2)) v(n) WHERE n = 1 OR id % 2 = 0")
def nodes_of_pages(spark, sf_dir):
    """The reader's nodes below a paragraph."""
    html = F.when(F.col("id") % 2 == 0, F.lit("<p>a < b<p>c &amp; d")).otherwise(F.lit('<div/><p title="x>y"><b title=\'</b>\'></b>'))
    pages = tracks(spark, sf_dir).select("id", html.alias("html"))
    nodes = read_nodes(pages).select("id", F.inline(F.filter("nodes", lambda n: ~n["tag"].isin("p", "div"))))
    return nodes.groupBy("id", "tag").agg(F.count("*").alias("n")).select("id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("n"), "tag")


_CHANGES = [(f, f"coalesce(nullif(matched_{f}, ''), {f})") for f in ("title", "artist", "album", "genre", "year")]


@query(f"{T}, o AS (SELECT *, CASE WHEN id % 3 = 0 THEN title ELSE 'Old' END AS o_title, artist AS o_artist, NULL::VARCHAR AS o_album, genre AS o_genre, year AS o_year FROM tracks) " + " UNION ALL ".join(f"SELECT id, '{f}' AS field, o_{f} AS old_value, {new} AS new_value FROM o WHERE {new} <> '' AND o_{f} IS DISTINCT FROM {new}" for f, new in _CHANGES) + " UNION ALL SELECT id, 'cover_art', 'None', 'Will be added' FROM o WHERE matched_cover_url <> '' AND id % 2 <> 0")
def tag_changes(spark, sf_dir):
    t = tracks(spark, sf_dir)
    current = t.select("id", (F.col("id") % 2 == 0).alias("has_cover"), F.when(F.col("id") % 3 == 0, F.col("title")).otherwise("Old").alias("title"), "artist", F.lit(None).cast("string").alias("album"), "genre", "year")
    return dml.tag_preview(t, current).select("id", F.explode("changes").alias("c")).select("id", "c.field", "c.old_value", "c.new_value")


@query("""WITH m AS (SELECT vec_id, [list_sum([abs(CAST(x AS DOUBLE)) for x in embedding[i * 4 + 1 : i * 4 + 4]]) / 4 for i in range(16)] AS means FROM embeddings WHERE len(embedding) = 64),
u AS (SELECT vec_id, unnest(range(16)) AS place, unnest(means) AS mean, list_max(means) AS most FROM m) SELECT vec_id, place, round(CASE WHEN most > 0 THEN mean / most ELSE 0.5 END, 9) AS peak FROM u""")
def waveform_shapes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.size("embedding") == 64)
    return e.select("vec_id", F.posexplode(media.waveform(F.col("embedding"), 16)).alias("place", "peak")).select("vec_id", F.col("place").cast("long").alias("place"), F.round("peak", 9).alias("peak"))


@query(f"{T} SELECT id, CASE WHEN id % 5 = 0 THEN 'blocked' ELSE 'read' END AS state FROM tracks")
def blocked_made_pages(spark, sf_dir):
    """Of pages that are made of the tracks, some stand behind a check."""
    told = F.when(F.col("id") % 10 == 0, F.lit("<p>Access DENIED</p>")).when(F.col("id") % 5 == 0, F.lit('<div id="turnstile-container">')).otherwise(F.lit("<p>tracks</p>"))
    pages = tracks(spark, sf_dir).select(F.col("id").alias("page_id"), "id", F.concat(F.lit("<h1>"), "filename", F.lit("</h1>"), told).alias("html"))
    blocked = html_pages.blocked_pages(pages).select("id", F.lit("blocked").alias("state"))
    return pages.select("id").join(blocked, "id", "left").select("id", F.coalesce("state", F.lit("read")).alias("state"))


_PAIR = "CASE WHEN least(a, b) = 0 THEN 0.0 WHEN i = least(a, b) THEN greatest(i / (a + b - i), 0.5 + least(a, b) / greatest(a, b) * 0.5) ELSE i / (a + b - i) END"


@query(f"{T}, w AS (SELECT id, {_tokens('filename')} AS x, {_tokens(chr(39) + 'the large widget 1997-01-15 ' + chr(39) + ' || coalesce(title, ' + chr(39) * 2 + ')')} AS y FROM tracks), s AS (SELECT id, CAST(len(list_intersect(x, y)) AS DOUBLE) AS i, CAST(len(x) AS DOUBLE) AS a, CAST(len(y) AS DOUBLE) AS b FROM w) SELECT id, {_PAIR} AS score FROM s")
def name_similarity(spark, sf_dir):
    """File names against another name and their own title."""
    other = F.concat(F.lit("the large widget 1997-01-15 "), F.coalesce("title", F.lit("")))
    return tracks(spark, sf_dir).select("id", token_similarity(text.name_tokens(F.col("filename")), text.name_tokens(other)).alias("score"))


_RATIOS = "CASE WHEN id % 3 = 0 THEN 100.0 ELSE 0.0 END AS title_, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 100.0 WHEN 2 THEN 100.0 ELSE 0.0 END AS artist_, CASE WHEN id % 2 = 0 OR id % 3 = 0 THEN 100.0 ELSE 0.0 END AS full_, CASE WHEN id % 7 > 0 THEN 50.0 + least((id % 7) * 4, 20) END AS bonus"


@query(f"""{T}, r AS (SELECT id, {_RATIOS} FROM tracks) SELECT id, round((0.5 * title_ + coalesce(0.3 * artist_, 0) + 0.2 * full_) / (0.7 + CASE WHEN artist_ IS NULL THEN 0 ELSE 0.3 END), 6) AS direct,
 round((0.4 * title_ + coalesce(0.3 * artist_, 0) + 0.2 * title_ + coalesce(0.1 * bonus, 0)) / (0.6 + CASE WHEN artist_ IS NULL THEN 0 ELSE 0.3 END + CASE WHEN bonus IS NULL THEN 0 ELSE 0.1 END), 6) AS web FROM r""")
def score_weights(spark, sf_dir):
    """Candidates whose names are those of the track, or have no character in common with them."""
    i, t = F.col("id"), tracks(spark, sf_dir)
    c = t.select(
        "id", F.col("id").alias("track_id"), F.when(i % 3 == 0, F.coalesce("title", "filename")).otherwise(F.lit("жжщ")).alias("title"), F.when(i % 5 == 0, F.lit("")).when((i % 5).isin(1, 2), F.col("artist")).otherwise(F.lit("жжщ")).alias("artist"),
        F.lit("").alias("dj"), F.when(i % 2 == 0, F.col("filename")).alias("full_title"), F.when(i % 7 > 0, (i % 7) * 2).alias("num_tracks"),
    )
    return matching.scored(t, c, pieces(spark)).select("id", F.round("direct", 6).alias("direct"), F.round("web", 6).alias("web"))


@query(f"{T} SELECT id, CASE WHEN id % 5 = 1 THEN TIMESTAMP '2024-01-01 00:00:00' END AS tagged_at, CASE id % 5 WHEN 1 THEN 'tagged' WHEN 2 THEN 'error' ELSE status END AS status FROM tracks")
def tagging_times(spark, sf_dir):
    t = tracks(spark, sf_dir).withColumn("tagged_at", F.lit(None).cast("timestamp_ntz"))
    written = t.where("id % 5 in (1, 2)").select("id", (F.col("id") % 5 == 1).alias("ok"))
    return dml.mark_tagged(t, written, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).select("id", "tagged_at", "status")


@query(f"{C} SELECT genre AS id, 'Album of ' || genre AS title, 'Artist of ' || genre || ', Guest' AS artist, 12 AS track_count, count(*) AS match_count FROM candidates WHERE track_id % 7 < 5 GROUP BY genre")
def recording_votes(spark, sf_dir):
    """Votes of the recordings of five of seven names for nine releases."""
    named = lambda *values: F.array(*(F.struct(F.struct(v.alias("name")).alias("artist")) for v in values))
    release = F.struct(F.col("genre").alias("id"), F.concat(F.lit("Album of "), "genre").alias("title"), F.lit(12).alias("track-count"))
    recording = F.struct(F.col("id").cast("string").alias("id"), "title", named(F.concat(F.lit("Artist of "), "genre"), F.lit("Guest")).alias("artist-credit"), F.array(release).alias("releases"))
    docs = candidates(spark, sf_dir).select(F.pmod("track_id", F.lit(7)).cast("int").alias("name_no"), F.from_json(F.to_json(F.array(recording)), jsonmeta.RECORDINGS).alias("recordings"))
    return jsonmeta.release_votes(docs)
