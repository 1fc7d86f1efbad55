"""Flattening of metadata documents: releases, media, recordings, cover pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELEASES = "array<struct<id:string,title:string,date:string,country:string,`track-count`:int,score:int,disambiguation:string,`artist-credit`:array<struct<artist:struct<name:string>>>,`label-info`:array<struct<label:struct<name:string>>>>>"
MEDIA = "array<struct<position:int,tracks:array<struct<position:int,title:string,length:bigint,recording:struct<id:string>>>>>"
RECORDINGS = "array<struct<id:string,title:string,`artist-credit`:array<struct<artist:struct<name:string>>>,releases:array<struct<id:string,title:string,`track-count`:int>>>>"
ACOUSTIC = "array<struct<score:double,recordings:array<struct<id:string,title:string,artists:array<struct<name:string>>,releases:array<struct<title:string,date:struct<year:int>>>>>>>"
IMAGES = "array<struct<front:boolean,image:string,thumbnails:struct<large:string>>>"
SCORE_FLOOR, NAMES, ALTERNATIVES = 0.5, 5, 9


def parsed(c: Column, field: str, kind: str) -> Column:
    return F.from_json(c, f"`{field}` {kind}")[field]


def names(credits: Column, kind: str = "artist") -> Column:
    return F.array_join(F.transform(credits, lambda c: c[kind]["name"]), ", ")


def releases(docs: DataFrame, json: str = "body") -> DataFrame:
    """One row per release of a search result, with defaults for what is missing."""
    r = docs.select(F.explode(parsed(F.col(json), "releases", RELEASES)).alias("r"))
    none = lambda c, d: F.coalesce(c, F.lit(d))
    return r.select(F.col("r.id").alias("id"), none(F.col("r.title"), "").alias("title"), none(names(F.col("r.`artist-credit`")), "").alias("artist"), none(F.col("r.date"), "").alias("date"), none(F.col("r.country"), "").alias("country"), none(F.col("r.`track-count`"), 0).alias("track_count"), none(names(F.col("r.`label-info`"), "label"), "").alias("label"), none(F.col("r.score"), 0).alias("score"))


def release_tracks(docs: DataFrame, key: str, json: str = "body") -> DataFrame:
    """Tracks of all media of a release, with the disc's number."""
    media = docs.select(key, F.explode(parsed(F.col(json), "media", MEDIA)).alias("m"))
    return media.select(key, F.col("m.position").alias("disc"), F.explode("m.tracks").alias("t")).select(key, "disc", F.col("t.position").alias("position"), F.col("t.title").alias("title"), F.col("t.length").alias("length"), F.col("t.recording.id").alias("recording_id"))


def release_votes(results: DataFrame, limit: int = 10) -> DataFrame:
    """results(name_no, recordings): releases by how often the recordings of the first five names are on them; title and artist as first seen."""
    r = results.where(F.col("name_no") < NAMES).select("name_no", F.posexplode("recordings").alias("rec_no", "rec"))
    r = r.select("name_no", "rec_no", names(F.col("rec.`artist-credit`")).alias("artist"), F.posexplode("rec.releases").alias("rel_no", "rel")).where("rel.id is not null")
    at = F.struct("name_no", "rec_no", "rel_no")
    votes = r.groupBy(F.col("rel.id").alias("id")).agg(F.count("*").alias("match_count"), F.min_by(F.struct(F.col("rel.title").alias("title"), "artist", F.col("rel.`track-count`").alias("track_count")), at).alias("v"), F.min(at).alias("at"))
    return votes.orderBy(F.desc("match_count"), "at").limit(limit).select("id", "v.title", "v.artist", "v.track_count", "match_count")


def best_acoustic(results: DataFrame, key: str) -> DataFrame:
    """results(key, results array): the best scored result with recordings; its first recording, and up to nine more."""
    r = results.select(key, F.posexplode("results").alias("pos", "r")).where((F.col("r.score") >= SCORE_FLOOR) & (F.size("r.recordings") > 0))
    w = Window.partitionBy(key).orderBy(F.desc("r.score"), "pos")
    best = r.withColumn("k", F.row_number().over(w)).where("k = 1")
    first = F.try_element_at("r.recordings", F.lit(1))
    return best.select(key, F.col("r.score").alias("score"), first["title"].alias("title"), F.array_join(F.transform(first["artists"], lambda a: a["name"]), ", ").alias("artist"), F.try_element_at(first["releases"], F.lit(1))["title"].alias("album"), F.slice("r.recordings", 2, ALTERNATIVES).alias("alternatives"))


def front_cover(images: Column) -> Column:
    """The first front picture, else the first; the picture itself, else its large thumbnail."""
    chosen = F.coalesce(F.try_element_at(F.filter(images, lambda i: F.coalesce(i["front"], F.lit(False))), F.lit(1)), F.try_element_at(images, F.lit(1)))
    return F.coalesce(chosen["image"], chosen["thumbnails"]["large"])


def listed_count(c: Column) -> Column:
    """b of 'IDed a/b'."""
    return F.regexp_extract(c, r"(\d+)\s*/\s*(\d+)", 2).try_cast("int")


def meta_map(pairs: Column) -> Column:
    """A map of array(struct(key, value)); of equal keys the last stays."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))
