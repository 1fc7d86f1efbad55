"""Formats, look-ups and waveforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types by extension, and patterns of pictures, domains and block pages.
MIME = {"mp3": "audio/mpeg", "m4a": "audio/mp4", "flac": "audio/flac", "wav": "audio/wav", "ogg": "audio/ogg", "aac": "audio/aac"}
DEFAULT_MIME = "audio/mpeg"
IMAGE_ALLOWED = r"(?i)\.jpg|\.jpeg|\.png|\.webp|\.gif|image/|/images/|artwork|cover"
IMAGE_DENIED = r"(?i)icon|logo|avatar|profile|badge|1x1|placeholder|default|blank|\.gif|\.svg|sprite"
BLOCKED_DOMAINS = r"youtube\.com|spotify\.com|soundcloud\.com|apple\.com|amazon\.com"
BLOCK_PAGE = r"(?i)turnstile-container|please verify you are human|access denied|please wait, you will be forwarded"
GIB, MIB = 1 << 30, 1 << 20
PEAKS = 100


def human_size(size: Column) -> Column:
    gib, mib = size / F.lit(GIB), size / F.lit(MIB)
    return F.when(size >= GIB, F.format_string("%.2f GB", gib)).otherwise(F.format_string("%.1f MB", mib))


def clock(seconds: Column) -> Column:
    """m:ss; --:-- for null and 0."""
    whole = F.floor(seconds)
    return F.when((seconds > 0), F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))).otherwise("--:--")


def percent(part: Column, total: Column) -> Column:
    """Rounded half up; 0 of nothing."""
    return F.when(total > 0, F.floor(part / F.nullif(total, F.lit(0)) * 100 + 0.5)).otherwise(F.lit(0)).cast("long")


def mime_type(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))), F.lit(DEFAULT_MIME))


def is_image(url: Column, lenient: bool = False) -> Column:
    return ~url.rlike(IMAGE_DENIED) if lenient else url.rlike(IMAGE_ALLOWED) | url.startswith("data:image")


def block_means(samples: Column, peaks: int = PEAKS) -> Column:
    """Mean magnitudes of equal blocks; the rest is left out. Null where there are fewer samples than blocks."""
    block = F.floor(F.size(samples) / peaks).cast("int")
    mean = lambda i: F.aggregate(F.slice(samples, (i * block + 1).cast("int"), block), F.lit(0.0), lambda acc, x: acc + F.abs(x.cast("double"))) / block
    return F.when(block > 0, F.transform(F.sequence(F.lit(0), F.lit(peaks - 1)), mean))


def waveform(samples: Column, peaks: int = PEAKS) -> Column:
    """block_means as a share of the largest; 0.5 in silence."""
    means = block_means(samples, peaks)
    return F.get(F.transform(F.array(means), lambda ms: F.transform(ms, lambda m: F.when(F.array_max(ms) > 0, m / F.nullif(F.array_max(ms), F.lit(0.0))).otherwise(0.5))), F.lit(0))


def fallback_waveform(track_id: Column, peaks: int = PEAKS) -> Column:
    """A steady stand-in shape from the identifier."""

    def at(i):
        x = F.pmod(track_id * 12345 + i * 7919, F.lit(1000)) / 1000
        return F.least(F.lit(0.95), F.greatest(F.lit(0.15), 0.3 + 0.15 * F.sin(i * 0.15) + 0.4 * x))

    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(peaks - 1).cast("long")), at)


def fingerprint_hash(c: Column) -> Column:
    return F.left(F.sha2(c.cast("binary"), 256), F.lit(32))
