"""Text rules for names of media files, as column expressions. Regular expressions are Unicode-aware unless a rule is ASCII by nature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words that the results depend on.
EXTENSIONS = ("mp3", "flac", "wav", "m4a", "aac", "ogg")
EXTENSION = r"(?i)\.(mp3|flac|wav|m4a|aac|ogg)$"
CLEAN_RULES = [
    (r"\[.*?\]", ""),
    (r"\(.*?\)", ""),
    (r"_", " "),
    (r"-{2,}", " "),
    (EXTENSION, ""),
    (r"(?U)\d{4}[-./]\d{2}[-./]\d{2}", ""),
    (r"(?U)\d{2}[-./]\d{2}[-./]\d{4}", ""),
    # what a word may begin with is looked at first, as a word's edge is dear
    (r"(?=[lLsSſmMdDpPeEvV@])(?iuU)\b(live|set|mix|dj|@|podcast|episode|ep\.?|vol\.?)\b", ""),
    (r"(?=[13fFwWmM])(?iuU)\b(320|128|flac|wav|mp3)\b", ""),
    (r"(?=[pP])(?iuU)\b(part|pt\.?)\s*\d+\b", ""),
]
SERIES_RULES = [
    (r"(?iuU)\s*\([^)]*(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[^)]*\d{4}[^)]*\)", ""),
    (r"(?U)\s*\(\d{4}\)", ""),
    (r"(?U)\s*\(\d{4}-\d{2}-\d{2}\s+\d{2}\.\d{2}\.\d{2}\s+\w+\)", ""),
    (r"(?U)\s*\(\d{2}\.\d{2}\.\d{2}\s+\w+\.?\s+\d{1,2}[:.]\d{2}\)", ""),
    (r"(?U)\s*[\(\[]?\d{4}[\-\.]\d{2}[\-\.]\d{2}[\)\]]?", ""),
    (r"(?U)\s*-\s*\d{4}-\d{2}-\d{2}\s*$", ""),
    (r"(?U)\s+\d{2}\.\d{2}\.\d{2}\s+\w+\)?", ""),
    (r"(?iuU)\s*(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{4}\s*(mix)?\s*", " "),
    (r"(?iuU)\s*part\s*\d+\s*$", ""),
]
TRAILING_NUMBER = r"(?U)\s+(\d{2,4})\s*$"
EPISODE_WORD = r"(?iuUs)[\s\-_]*(episode|ep\.?|#)\s*(\d{1,4})"
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "mix", "dj", "live")
TRACK_SEPARATORS = (" - ", " – ", " — ", " / ")
LINE_PATTERNS = [
    r"(?iu)^\s*(\d{1,3})[\.\)\]]\s*(.+?)\s*[-–—]\s*(.+?)(?:\s*[\[\(].+?[\]\)])?$",
    r"(?iu)^\s*\[?(\d{1,2}:\d{2}(?::\d{2})?)\]?\s*(.+?)\s*[-–—]\s*(.+?)$",
    r"(?iu)^\s*([A-Z][^-–—\n]{2,40})\s*[-–—]\s*([^-–—\n]{3,80})$",
]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def replace_all(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, new in rules:
        c = F.regexp_replace(c, pattern, new)
    return c


def truthy(c: Column) -> Column:
    """c, or null where it is empty."""
    return F.when(c != "", c)


def clean_string(c: Column) -> Column:
    """Lower case without brackets, dates, noise words and extension; null as empty."""
    return squeeze(replace_all(F.lower(F.coalesce(c, F.lit(""))), CLEAN_RULES))


def clean_filename(c: Column) -> Column:
    """Without extension; underscores and hyphens between letters are spaces."""
    c = F.regexp_replace(F.regexp_replace(c, EXTENSION, ""), "_", " ")
    return squeeze(F.regexp_replace(c, r"(?<=[a-zA-Z])-(?=[a-zA-Z])", " "))


def normalize_key(c: Column, squeezed: bool = True) -> Column:
    """Lower case word characters and white space."""
    out = F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", "")
    return squeeze(out) if squeezed else strip(out)


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def series_name(filename: Column) -> Column:
    """struct(display, normalized, episode) of a file name."""

    def cut(name):
        number, word = truthy(F.regexp_extract(name, TRAILING_NUMBER, 1)), truthy(F.regexp_extract(name, EPISODE_WORD, 2))
        by_number, by_word = (strip(F.regexp_replace(name, p, "")) for p in (TRAILING_NUMBER, EPISODE_WORD + ".*$"))
        kept = F.when(number.isNotNull(), by_number).when(word.isNotNull(), by_word).otherwise(name)
        shown = F.regexp_replace(F.regexp_replace(kept, r"(?U)^\d{1,2}[\s\-_]+", ""), r"(?U)[\s\-_]+$", "")
        return F.struct(shown.alias("display"), F.coalesce(number, word).alias("episode"))

    named = let(replace_all(clean_filename(filename), SERIES_RULES), cut)
    return let(named, lambda n: F.struct(n["display"].alias("display"), normalize_key(n["display"]).alias("normalized"), n["episode"].alias("episode")))


def name_tokens(c: Column) -> Column:
    """Distinct words of more than two characters that are no stop words."""
    words = F.split(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""), r"(?U)\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def episode_number(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


def search_terms(artist: Column, title: Column, filename: Column) -> Column:
    """Cleaned artist, title and file name of three characters or more, then the first two ' - ' parts of the file name that are new."""
    long = lambda x: F.length(x) >= 3
    first = F.filter(F.array(clean_string(artist), clean_string(title), clean_string(filename)), long)
    parts = F.when(F.contains(filename, F.lit(" - ")), F.slice(F.split(filename, " - "), 1, 2)).otherwise(F.array().cast("array<string>"))
    cleaned = F.filter(F.transform(parts, clean_string), long)
    return F.aggregate(cleaned, first, lambda acc, x: F.when(F.array_contains(acc, x), acc).otherwise(F.array_append(acc, x)))


def filename_metadata(filename: Column) -> Column:
    """struct(artist, title): split at the first ' - ', else ' @ ', else a title alone."""
    name = F.regexp_replace(filename, r"\.[^./]*$", "")
    parts = F.when(F.contains(name, F.lit(" - ")), F.split(name, " - ", 2)).when(F.contains(name, F.lit(" @ ")), F.split(name, " @ ", 2))
    return F.struct(strip(F.get(parts, F.lit(0))).alias("artist"), F.coalesce(strip(F.get(parts, F.lit(1))), strip(name)).alias("title"))


def search_query(artist: Column, title: Column, *extra: Column) -> Column:
    """The artist in quotation marks, the cleaned title, the word tracklist, and more."""
    clean = F.regexp_replace(F.regexp_replace(title, r"(?i)\.(mp3|flac|wav|m4a)$", ""), r"(?U)^\d+[-_\s]*", "")
    clean = F.replace(F.replace(clean, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" - "))
    return F.concat_ws(" ", F.when(truthy(artist).isNotNull(), F.concat(F.lit('"'), strip(artist), F.lit('"'))), F.when(truthy(title).isNotNull(), clean), F.lit("tracklist"), *extra)


def search_queries(artist: Column, title: Column, filename: Column) -> Column:
    """Up to five query texts for one track, in order."""
    has_artist, has_title = F.coalesce(artist, F.lit("")) != "", F.coalesce(title, F.lit("")) != ""
    terms = replace_all(F.coalesce(filename, F.lit("")), [(r"(?i)\.(mp3|flac|wav|m4a)$", ""), (r"(?U)^\d+[-_\s]*", ""), (r"(?U)\s*\(\d{4}[-/]\d{2}[-/]\d{2}\)", ""), (r"(?iuU)\s*Part\s*\d+\s*$", "")])
    terms = strip(F.replace(F.replace(terms, F.lit("_"), F.lit(" ")), F.lit(" - "), F.lit(" ")))
    bare = F.regexp_replace(title, r"(?i)\.(mp3|flac|wav|m4a)$", "")
    return F.array_compact(F.array(
        F.when(has_artist | has_title, search_query(artist, F.when(has_title, title).otherwise(filename))),
        F.when(terms != "", F.concat(terms, F.lit(" tracklist"))),
        F.when(has_artist, F.concat(F.lit('site:1001tracklists.com "'), artist, F.lit('"'))),
        F.when(terms != "", F.concat(F.lit("site:mixesdb.com "), terms)),
        F.when(has_artist & has_title & (F.length(title) > 10), F.concat(bare, F.lit(" dj mix tracklist"))),
    ))


def parse_track(c: Column) -> Column:
    """struct(artist, title) of one track line without its number or time."""

    def split(c):
        parts = None
        for sep in TRACK_SEPARATORS:
            when = F.when if parts is None else parts.when
            parts = when(F.contains(c, F.lit(sep)), F.split(c, sep, 2))
        return F.struct(F.coalesce(strip(F.get(parts, F.lit(0))), F.lit("")).alias("artist"), F.coalesce(strip(F.get(parts, F.lit(1))), strip(c)).alias("title"))

    c = F.regexp_replace(c, r"^\s*\d+[\.\)\]]\s*", "")
    return let(F.regexp_replace(c, r"^\s*\[?\d{1,2}:\d{2}(?::\d{2})?\]?\s*", ""), split)


def line_candidates(line: Column) -> Column:
    """array(struct(artist, title)) of the patterns a line fits, in their order, those of bad length left out."""
    found = []
    for k, pattern in enumerate(LINE_PATTERNS):
        a, t = (1, 2) if k == 2 else (2, 3)
        artist, title = strip(F.regexp_extract(line, pattern, a)), strip(F.regexp_extract(line, pattern, t))
        ok = line.rlike(pattern) & F.length(artist).between(2, 100) & F.length(title).between(2, 150)
        found.append(F.when(ok, F.struct(artist.alias("artist"), title.alias("title"))))
    return F.array_compact(F.array(*found))


def show_episode(c: Column) -> Column:
    """struct(show, episode) of 'Show 123', null fields where it isn't one."""
    pattern = r"(?U)^(.+?)[\s_-]*(\d{2,4})[\s_-]*$"
    return F.struct(truthy(F.regexp_extract(c, pattern, 1)).alias("show"), truthy(F.regexp_extract(c, pattern, 2)).alias("episode"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s-]", ""), r"(?U)\s+", "-")


def tracklist_id(url: Column) -> Column:
    return F.regexp_extract(url, "tracklist/([^/]*)", 1)


def domain(url: Column) -> Column:
    return F.replace(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("www."), F.lit(""))


def unwrapped(url: Column) -> Column:
    """The target of a '/url?q=' redirect; other urls as they are."""
    target = F.regexp_extract(url, r"^/url\?(?:.*&)?q=([^&#]*)", 1)
    return F.when(target != "", F.try_url_decode(target)).otherwise(url)


def absolute_url(url: Column, page: Column) -> Column:
    origin = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    return F.when(url.startswith("//"), F.concat(scheme, url)).when(url.startswith("/"), F.concat(origin, url)).when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), url).otherwise(F.concat(F.regexp_replace(F.concat(origin, F.regexp_extract(page, r"://[^/?#]*([^?#]*)", 1)), r"(?<=[^/:])/[^/]*$", ""), F.lit("/"), url))


def renamed(template: str, artist: Column, title: Column, genre: Column, year: Column, dj: Column, event: Column) -> Column:
    """The template with its {fields} filled in; nothing is an empty string."""
    out = F.lit(template)
    for field, value in (("artist", artist), ("title", title), ("genre", genre), ("year", year), ("dj", dj), ("event", event)):
        out = F.replace(out, F.lit("{" + field + "}"), F.coalesce(value, F.lit("")))
    return F.regexp_replace(out, "^[ -]+|[ -]+$", "")


def safe_filename(c: Column, extension: Column) -> Column:
    """Letters, digits and ' -_()' only, trimmed, with the extension again."""
    return F.concat(strip(F.regexp_replace(c, r"(?U)[^\p{Alnum} \-_()]", "")), extension)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)


def directory_name(directory: Column) -> Column:
    """The last part of a path without a leading number."""
    return F.regexp_replace(basename(directory), r"(?U)^\d+\s*[-_]\s*", "")
