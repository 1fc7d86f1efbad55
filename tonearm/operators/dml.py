"""Catalog edits as new versions of the tables. now is passed in, so results are reproducible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, dirname, extension, renamed, safe_filename, truthy
from ..schema import AUTO_ACCEPT, PATCH_COLUMNS
from .catalog import effective, is_tagged

SELECTED = ("title", "artist", "genre", "cover_url", "tracklist_url")
TAG_FIELDS = ("title", "artist", "album", "genre", "year")


def patch(tracks: DataFrame, patches: DataFrame) -> DataFrame:
    """patches(id, set: array of column names, values): columns that are named take the patch's value, null too."""
    p = patches.select("id", "set", *(F.col(c).alias(f"p_{c}") for c in patches.columns if c in PATCH_COLUMNS))
    out = tracks.join(p, "id", "left")
    named = lambda c: F.coalesce(F.array_contains("set", c), F.lit(False))
    return out.select(*(F.when(named(c), F.col(f"p_{c}")).otherwise(F.col(c)).alias(c) if f"p_{c}" in p.columns else F.col(c) for c in tracks.columns))


def delete(tracks: DataFrame, candidates: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the tracks of ids(id); candidates go with their track."""
    return tracks.join(ids, "id", "left_anti"), candidates.join(ids.select(F.col("id").alias("track_id")), "track_id", "left_anti")


def files_to_delete(tracks: DataFrame, ids: DataFrame, root: str) -> DataFrame:
    """A plan: the paths, and whether each is inside root."""
    return tracks.join(ids, "id", "left_semi").select("id", "filepath", F.col("filepath").startswith(root.rstrip("/") + "/").alias("allowed"))


def _updated(tracks: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    return tracks.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in values.items()})


def select_match(tracks: DataFrame, candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen(track_id, match_id): the tracks take the candidates' values."""
    c = chosen.join(candidates, (candidates["id"] == chosen["match_id"]) & (candidates["track_id"] == chosen["track_id"])).select(chosen["track_id"].alias("id"), *(F.col(f).alias(f"c_{f}") for f in SELECTED), F.col("confidence").alias("c_confidence"))
    out = tracks.join(c, "id", "left")
    hit = F.col("c_confidence").isNotNull()
    values = {f"matched_{f}": F.col(f"c_{f}") for f in SELECTED} | {"match_confidence": F.col("c_confidence"), "status": F.lit("matched")}
    return _updated(out, hit, {k: v for k, v in values.items() if k in tracks.columns}).select(tracks.columns)


def auto_select(tracks: DataFrame, candidates: DataFrame, least: float = AUTO_ACCEPT) -> DataFrame:
    """Searched tracks, those with candidates: the best is taken if sure enough, else the track is pending again."""
    fields = [f for f in (*SELECTED, "dj", "event", "source") if f in candidates.columns]
    best = candidates.groupBy(F.col("track_id").alias("id")).agg(F.max_by(F.struct(*fields, F.col("confidence")), F.struct(F.col("confidence"), -F.col("id"))).alias("b"))
    out = tracks.join(best, "id", "left")
    sure = F.coalesce(F.col("b.confidence") >= least, F.lit(False))
    names = {f: "match_source" if f == "source" else f"matched_{f}" for f in fields}
    out = _updated(out, sure, {n: F.col(f"b.{f}") for f, n in names.items() if n in tracks.columns} | {"match_confidence": F.col("b.confidence")})
    status = F.when(sure, "matched").when(F.col("b").isNotNull(), "pending").otherwise(F.col("status"))
    return out.withColumn("status", status).select(tracks.columns)


def apply_identification(tracks: DataFrame, found: DataFrame) -> DataFrame:
    """found(id, title, artist, album, score): what isn't empty, the score as per cent."""
    f = found.select("id", *(truthy(F.col(c)).alias(f"f_{c}") for c in ("title", "artist", "album")), F.col("score").alias("f_score"))
    out, hit = tracks.join(f, "id", "left"), F.col("f_score").isNotNull()
    values = {f"matched_{c}": F.coalesce(f"f_{c}", f"matched_{c}") for c in ("title", "artist", "album")} | {"match_confidence": F.col("f_score") * 100, "match_source": F.lit("acoustid"), "status": F.lit("matched")}
    return _updated(out, hit, values).select(tracks.columns)


def store_fingerprints(tracks: DataFrame, prints: DataFrame, overwrite: bool = False) -> DataFrame:
    p = prints.select("id", F.col("fingerprint_hash").alias("new"))
    order = ("new", "fingerprint_hash") if overwrite else ("fingerprint_hash", "new")
    return tracks.join(p, "id", "left").withColumn("fingerprint_hash", F.coalesce(*order)).select(tracks.columns)


def mark_tagged(tracks: DataFrame, written: DataFrame, now: Column) -> DataFrame:
    """written(id, ok): tags were written, or not. Title, artist and genre become the file's own; album and year don't."""
    out = tracks.join(written.select("id", "ok"), "id", "left")
    ok = F.coalesce("ok", F.lit(False))
    out = _updated(out, ok, {c: effective(c) for c in ("title", "artist", "genre")} | {"tagged_at": now})
    return out.withColumn("status", F.when(ok, "tagged").when(F.col("ok").isNotNull(), "error").otherwise(F.col("status"))).select(tracks.columns)


def apply_series(tracks: DataFrame, ids: DataFrame, album: str, artist: str | None = None, genre: str | None = None, album_artist: str | None = None, cover_url: str | None = None) -> DataFrame:
    """Both the file's and the matched values; the album always, the others if given."""
    out = tracks.join(ids.select("id", F.lit(True).alias("__hit")), "id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    values = {f: F.lit(v) for c, v in (("album", album), ("artist", artist), ("genre", genre), ("album_artist", album_artist)) if v for f in (c, f"matched_{c}") if f in tracks.columns}
    if cover_url:
        values["matched_cover_url"] = F.lit(cover_url)
    values |= {"status": F.when(F.col("status") == "pending", "matched").otherwise(F.col("status")), "series_tagged": F.lit(True)}
    return _updated(out, hit, values).select(tracks.columns)


def resync(tracks: DataFrame, file_tags: DataFrame, key: str = "filepath") -> DataFrame:
    """file_tags(key, album, artist, title), one row for each key: what files say replaces both values; adds changed. Files that are missing change nothing."""
    t = file_tags.select(key, *(truthy(F.col(c)).alias(f"f_{c}") for c in ("album", "artist", "title")), F.lit(True).alias("__there"))
    out = tracks.join(t, key, "left")
    there, differs = F.coalesce("__there", F.lit(False)), {}
    for c in ("album", "artist", "title"):
        differs[c] = there & F.col(f"f_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"f_{c}"))
    has_album = F.col("f_album").isNotNull()
    cleared = there & ~has_album & is_tagged()
    marked = there & has_album & ~is_tagged()
    values = {"changed": differs["album"] | differs["artist"] | differs["title"] | cleared | marked}
    for c in ("artist", "title"):
        values |= {n: F.when(differs[c], F.col(f"f_{c}")).otherwise(F.col(n)) for n in (c, f"matched_{c}")}
    values["album"] = F.when(differs["album"], F.col("f_album")).otherwise(F.col("album"))
    values["matched_album"] = F.when(differs["album"], F.col("f_album")).when(~cleared, F.col("matched_album"))
    values["series_tagged"] = F.when(marked, True).when(cleared, False).otherwise(F.col("series_tagged"))
    return out.withColumns(values).select(*tracks.columns, "changed")


def markers_to_write(tracks: DataFrame) -> DataFrame:
    """A plan: tagged tracks with an album, whose files get the series mark."""
    album = F.coalesce(truthy(F.col("album")), truthy(F.col("matched_album")))
    return tracks.where(is_tagged()).select("id", "filepath", album.alias("album")).where("album is not null")


def remove_from_series(tracks: DataFrame, ids: DataFrame) -> DataFrame:
    out = tracks.join(ids.select("id", F.lit(True).alias("__hit")), "id", "left")
    none = F.lit(None).cast("string")
    return _updated(out, F.coalesce("__hit", F.lit(False)), {"album": none, "matched_album": none, "series_tagged": F.lit(False)}).select(tracks.columns)


def rename_plan(tracks: DataFrame, template: str = "{artist} - {title}") -> DataFrame:
    """(id, filepath, new_path, collides): new names from the template; a path that two tracks want, or another has, collides."""
    get = lambda c, default: F.coalesce(truthy(F.col(f"matched_{c}")), truthy(F.col(c)), F.lit(default)) if c in tracks.columns else F.lit(default)
    year = get("year", "") if "matched_year" in tracks.columns else F.lit("")
    only = lambda c: F.coalesce(F.col(c), F.lit("")) if c in tracks.columns else F.lit("")
    name = renamed(template, get("artist", "Unknown Artist"), get("title", "Unknown Title"), get("genre", "Unknown Genre"), year, only("matched_dj"), only("matched_event"))
    path = F.concat(dirname(F.col("filepath")), F.lit("/"), safe_filename(name, extension(F.col("filepath"))))
    plan = tracks.select("id", "filepath", path.alias("new_path"), name.alias("name")).where("name <> ''").drop("name")
    taken = tracks.select(F.col("filepath").alias("new_path"), F.lit(True).alias("taken")).distinct()
    collides = (F.count("*").over(Window.partitionBy("new_path")) > 1) | (F.coalesce("taken", F.lit(False)) & (F.col("filepath") != F.col("new_path")))
    return plan.join(taken, "new_path", "left").select("id", "filepath", "new_path", collides.alias("collides"))


def apply_renames(tracks: DataFrame, plan: DataFrame) -> DataFrame:
    p = plan.where("not collides").select("id", F.col("new_path").alias("p"))
    return tracks.join(p, "id", "left").withColumns({"filepath": F.coalesce("p", "filepath"), "filename": F.coalesce(basename(F.col("p")), F.col("filename"))}).select(tracks.columns)


def tag_preview(tracks: DataFrame, current: DataFrame) -> DataFrame:
    """current(id, has_cover and tag fields): the changes that tagging makes, as an array of (field, old_value, new_value)."""
    fields = [f for f in TAG_FIELDS if f in current.columns]
    c = current.select("id", "has_cover", *(F.col(f).alias(f"o_{f}") for f in fields))
    new = lambda f: F.coalesce(truthy(F.col(f"matched_{f}")), F.col(f)) if f"matched_{f}" in tracks.columns else F.col(f)
    cover = truthy(F.col("matched_cover_url")).isNotNull() if "matched_cover_url" in tracks.columns else F.lit(False)
    entry = lambda field, old, value: F.struct(F.lit(field).alias("field"), old.alias("old_value"), value.alias("new_value"))
    changes = [F.when(truthy(new(f)).isNotNull() & ~new(f).eqNullSafe(F.col(f"o_{f}")), entry(f, F.col(f"o_{f}"), new(f))) for f in fields]
    changes.append(F.when(cover & ~F.coalesce("has_cover", F.lit(False)), entry("cover_art", F.lit("None"), F.lit("Will be added"))))
    return tracks.join(c, "id").select("id", "filename", F.array_compact(F.array(*changes)).alias("changes"))


def replace_candidates(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New candidates replace their tracks' old ones; tracks without new ones keep theirs."""
    return existing.join(new.select("track_id").distinct(), "track_id", "left_anti").unionByName(new, allowMissingColumns=True)


def taggable(tracks: DataFrame) -> DataFrame:
    """id, accepted, reason: only matched tracks are tagged; the others with the reason why not."""
    ok = F.coalesce(F.col("status") == "matched", F.lit(False))
    return tracks.select("id", ok.alias("accepted"), F.when(~ok, F.concat(F.lit("status is "), F.coalesce("status", F.lit("unknown")))).alias("reason"))


def desired_tags(tracks: DataFrame, fields: tuple[str, ...] = TAG_FIELDS, marker: str | None = None, cover: bool = False) -> DataFrame:
    """A plan for the writers of tags: id, filepath, tags array(struct(field, value)), of what isn't empty.

    marker: the mark of series, written as a field of its own. cover: the picture's address as a field.
    """
    either = lambda f: F.coalesce(truthy(F.col(f"matched_{f}")), truthy(F.col(f))) if f"matched_{f}" in tracks.columns else truthy(F.col(f))
    wanted = [(f, either(f)) for f in fields]
    if cover:
        wanted.append(("cover", truthy(F.col("matched_cover_url"))))
    if marker:
        wanted.append(("marker", F.lit(marker)))
    entries = [F.when(v.isNotNull(), F.struct(F.lit(f).alias("field"), v.alias("value"))) for f, v in wanted]
    return tracks.select("id", "filepath", F.array_compact(F.array(*entries)).alias("tags"))
