"""Candidates for tracks: scores, the best of them, fallbacks, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import token_set_ratio_of_some, weighted_mean
from ..functions.text import clean_string, truthy
from ..schema import MATCH_THRESHOLD

TOP, ENRICHED, ENOUGH = 10, 3, 2


def _cleaned(track: str) -> tuple[Column, Column, Column]:
    col = lambda f: F.col(f"{track}.{f}")
    return clean_string(col("artist")), clean_string(F.coalesce(truthy(col("title")), col("filename"))), clean_string(col("filename"))


def _direct(title, artist, full, own, own_artist, own_full) -> Column:
    ratio = token_set_ratio_of_some
    return weighted_mean([(ratio(title, own), 0.5), (ratio(artist, own_artist), 0.3), (ratio(full, own_full), 0.2)])


def _web(title, artist, full, own, own_artist, n) -> Column:
    ratio = token_set_ratio_of_some
    return weighted_mean([(ratio(title, own), 0.4), (ratio(artist, own_artist), 0.3), (ratio(full, own), 0.2), (F.when(n > 0, 50.0 + F.least(n * 2, F.lit(20))), 0.1)])


def direct_score(track: str = "t", candidate: str = "c") -> Column:
    """Title 0.5, artist (or DJ) 0.3, file name against the full title 0.2."""
    artist, title, full = _cleaned(track)
    c = lambda f: F.col(f"{candidate}.{f}")
    return _direct(title, artist, full, clean_string(c("title")), clean_string(F.coalesce(truthy(c("artist")), c("dj"))), clean_string(F.coalesce(c("full_title"), c("title"))))


def web_score(track: str = "t", candidate: str = "c") -> Column:
    """Title 0.4, artist 0.3, file name against the title 0.2, and a bonus for listed tracks 0.1."""
    artist, title, full = _cleaned(track)
    c = lambda f: F.col(f"{candidate}.{f}")
    return _web(title, artist, full, clean_string(c("title")), clean_string(c("artist")), F.coalesce(c("num_tracks"), F.lit(0)))


def scored(tracks: DataFrame, candidates: DataFrame, pieces: int) -> DataFrame:
    """(id, track_id, direct, web) of candidates with their tracks; names of either side are cleaned before they meet, each once.

    Both sides are dealt into so many pieces by the track: cleaning and scoring cost more than their few bytes tell Spark, which would merge its own pieces.
    """
    tracks, candidates = tracks.repartition(pieces, "id"), candidates.repartition(pieces, "track_id")
    artist, title, full = _cleaned("t")
    t = tracks.alias("t").select(F.col("id").alias("track_id"), artist.alias("t_artist"), title.alias("t_title"), full.alias("t_full"))
    own, by = clean_string(F.col("title")), clean_string(F.col("artist"))
    by_any = F.when(F.col("artist") != "", by).otherwise(clean_string(F.col("dj")))
    own_full = F.when(F.col("full_title").isNotNull(), clean_string(F.col("full_title"))).otherwise(own)
    c = candidates.select("id", "track_id", own.alias("own"), by.alias("by"), by_any.alias("by_any"), own_full.alias("own_full"), F.coalesce("num_tracks", F.lit(0)).alias("n"))
    sides = [F.col(x) for x in ("t_title", "t_artist", "t_full", "own")]
    return t.join(c, "track_id").select("id", "track_id", _direct(*sides, F.col("by_any"), F.col("own_full")).alias("direct"), _web(*sides, F.col("by"), F.col("n")).alias("web"))


def top_matches(scored: DataFrame, threshold: float = MATCH_THRESHOLD, top: int = TOP) -> DataFrame:
    """scored(track_id, pos, score, ...): those at the threshold or above, the best top of each track, with their rank."""
    w = Window.partitionBy("track_id").orderBy(F.desc("score"), "pos")
    return scored.where(F.col("score") >= threshold).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def once_by_url(rows: DataFrame, key: str = "track_id", url: str = "url", priority: str = "source_prio", pos: str = "pos") -> DataFrame:
    """The first row of each url, by source and place."""
    w = Window.partitionBy(key, url).orderBy(priority, pos)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def with_fallback(matches: DataFrame, fallback: DataFrame, tracks: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """matches, and for tracks with fewer than enough of them the fallback's too."""
    counts = matches.groupBy("track_id").agg(F.count("*").alias("n"))
    few = tracks.select(F.col("id").alias("track_id")).join(counts, "track_id", "left").where(F.coalesce("n", F.lit(0)) < enough).select("track_id")
    return matches.unionByName(fallback.join(few, "track_id", "left_semi"), allowMissingColumns=True)


def fallback_source(primary: DataFrame, fallback: DataFrame, key: str = "query") -> DataFrame:
    """The fallback's rows for keys of which the primary source has none."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def enriched(matches: DataFrame, details: DataFrame) -> DataFrame:
    """Details by url for the first three ranks on tracklist pages; what the details have, null too, replaces the match's."""
    d = details.select("url", F.col("dj").alias("d_dj"), F.col("event").alias("d_event"), F.col("date_recorded").alias("d_date"), F.lit(True).alias("hit"))
    wanted = (F.col("rank") <= ENRICHED) & F.contains("url", F.lit("/tracklist/")) & F.coalesce("hit", F.lit(False))
    out = matches.join(d, "url", "left")
    for c, new in (("dj", "d_dj"), ("event", "d_event"), ("date_recorded", "d_date")):
        out = out.withColumn(c, F.when(wanted, F.col(new)).otherwise(F.col(c)))
    return out.select(matches.columns)


def event_source(sources: Column) -> Column:
    """The first value of a map whose key names a festival or an event."""
    entries = F.filter(F.map_entries(sources), lambda e: F.lower(e["key"]).rlike("festival|event"))
    return F.try_element_at(entries, F.lit(1))["value"]


def candidates_of(tracks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with their track's file name, the most confident first."""
    return candidates.join(tracks.select(F.col("id").alias("track_id"), "filename"), "track_id").orderBy("track_id", F.desc("confidence"), "id")


def containing_episode(results: DataFrame, queries: DataFrame) -> DataFrame:
    """results(query, title) whose title has the query's episode in it."""
    return results.join(queries.select("query", "episode"), "query").where(F.contains("title", F.col("episode")))


#: Search terms whose results count where the first search found too little, and where it failed.
DIRECT_TERMS, FAILED_TERMS = 2, 3


def matched_paths(tracks: DataFrame, primary: DataFrame, direct: DataFrame, failed: DataFrame, threshold: float = MATCH_THRESHOLD, top: int = TOP) -> DataFrame:
    """(track_id, url, score, path, rank): the matches of three ways to find them, the best top of each track.

    primary(track_id, pos, url, score): results of the first search. direct(track_id, term_no, pos, url, score): results by search
    term, from 0. Tracks with fewer than ENOUGH primary matches take the direct results of DIRECT_TERMS terms, and those of
    failed(track_id), whose first search broke off, of FAILED_TERMS. A url counts once: not if a primary match
    has it, else by its first direct result, whatever that scores. Ties keep primary matches first, in their order.
    """
    found = primary.where(F.col("score") >= threshold).select("track_id", F.lit("search").alias("path"), F.lit(-1).alias("term_no"), "pos", "url", "score")
    counts = found.groupBy("track_id").agg(F.count("*").alias("n"))
    broken = failed.select("track_id", F.lit(True).alias("broken")).distinct()
    state = tracks.select(F.col("id").alias("track_id")).join(counts, "track_id", "left").join(broken, "track_id", "left")
    terms = F.when(F.col("broken"), FAILED_TERMS).when(F.coalesce("n", F.lit(0)) < ENOUGH, DIRECT_TERMS).otherwise(0)
    more = direct.join(state.select("track_id", terms.alias("terms"), F.when(F.col("broken"), "fallback").otherwise("direct").alias("path")), "track_id").where(F.col("term_no") < F.col("terms"))
    more = once_by_url(more, priority="term_no").join(found.select("track_id", "url"), ["track_id", "url"], "left_anti").where(F.col("score") >= threshold)
    every = found.unionByName(more.select(found.columns))
    w = Window.partitionBy("track_id").orderBy(F.desc("score"), "term_no", "pos")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("track_id", "url", "score", "path", "rank")


def candidate_places(tracks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with their track's file name and their place among the track's, the most confident first."""
    w = Window.partitionBy("track_id").orderBy(F.desc("confidence"), "id")
    return candidates.join(tracks.select(F.col("id").alias("track_id"), "filename"), "track_id").withColumn("place", F.row_number().over(w))
