"""Files as tables: audio folders, logs, settings, folder listings."""

from __future__ import annotations

import json
import os
import shutil
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EXTENSIONS, basename, dirname, extension

# The text in a file's grouping tag that marks series, and the tables of MPEG audio frames.
MARKER = "SetList Series"
LAYER3_KBITS = {1: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
MPEG_RATES = (44100, 48000, 32000)
TAG_SCHEMA = "filepath string, title string, artist string, album string, genre string, year string, grouping string, duration double, bitrate int, sample_rate int, file_format string"
LOG_PATTERN = r"^(\S+ \S+) \| (\w+)\s*\| (.*?) - (.*)$"


def roots(directories: list[str] | None, legacy: str | None, default: str) -> list[str]:
    """Configured folders that exist, else the single one of old, else the default."""
    found = [d for d in directories or [] if os.path.isdir(d)]
    return found or [legacy if legacy and os.path.isdir(legacy) else default]


def suffixes(value: str | None = None) -> tuple[str, ...]:
    """A comma-separated list, else the usual ones."""
    return tuple(x.strip().lower().lstrip(".") for x in value.split(",") if x.strip()) if value else EXTENSIONS


def audio_files(spark: SparkSession, folders: list[str], extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """filepath, filename, directory, file_size, modified of all audio files below; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders)
    path = F.regexp_replace("path", "^file:/+", "/")
    df = df.select(path.alias("filepath"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))
    return df.where(F.lower(extension(F.col("filepath"))).isin([f".{e}" for e in extensions])).withColumns({"filename": basename(F.col("filepath")), "directory": dirname(F.col("filepath"))})


def _wav(data: bytes) -> dict:
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return {}
    out, at = {"file_format": "wav"}, 12
    names = {b"INAM": "title", b"IART": "artist", b"IPRD": "album", b"IGNR": "genre", b"ICRD": "year"}
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if kind == b"fmt " and len(body) >= 12:
            out["sample_rate"], rate = struct.unpack_from("<II", body, 4)
            out["bitrate"], out["rate"] = rate * 8, rate
        elif kind == b"data" and out.get("rate"):
            out["duration"] = size / out["rate"]
        elif kind == b"LIST" and body[:4] == b"INFO":
            p = 4
            while p + 8 <= len(body):
                n = struct.unpack_from("<I", body, p + 4)[0]
                if body[p : p + 4] in names:
                    out[names[body[p : p + 4]]] = body[p + 8 : p + 8 + n].rstrip(b"\0").decode("utf-8", "replace")
                p += 8 + n + n % 2
        at += 8 + size + size % 2
    out.pop("rate", None)
    return out


def _frames(data: bytes, at: int) -> dict:
    """Sample rate, bitrate and duration from the first layer-3 frame from at on, and from its header of a variable bitrate if it has one."""
    while 0 <= (at := data.find(b"\xff", at)) < len(data) - 4:
        head = int.from_bytes(data[at : at + 4], "big")
        version, layer, kbits, rate = head >> 19 & 3, head >> 17 & 3, head >> 12 & 15, head >> 10 & 3
        if head >> 21 == 0x7FF and version != 1 and layer == 1 and 0 < kbits < 15 and rate < 3:
            first = version == 3
            sample_rate, bitrate, samples = MPEG_RATES[rate] >> (0 if first else 1 if version == 2 else 2), LAYER3_KBITS[1 if first else 2][kbits - 1] * 1000, 1152 if first else 576
            size = len(data) - at
            mark = max(data.find(b"Xing", at, at + 48), data.find(b"Info", at, at + 48))
            if mark > 0 and data[mark + 7] & 1 and (n := int.from_bytes(data[mark + 8 : mark + 12], "big")):
                duration = n * samples / sample_rate
                return {"sample_rate": sample_rate, "bitrate": int(size * 8 / duration), "duration": duration}
            return {"sample_rate": sample_rate, "bitrate": bitrate, "duration": size * 8 / bitrate}
        at += 1
    return {}


def _mp3(data: bytes) -> dict:
    tags = _id3(data)
    size = 10 + sum((b & 127) << 7 * k for k, b in enumerate(reversed(data[6:10]))) if tags else 0
    if not tags and data[:1] != b"\xff":
        return {}
    return {"file_format": "mp3"} | tags | _frames(data, size)


def _atoms(data: bytes, at: int, end: int):
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        size = end - at if size == 0 else size
        if size < 8:
            return
        yield kind, at + 8, min(at + size, end)
        at += size


def _mp4(data: bytes) -> dict:
    if data[4:8] != b"ftyp":
        return {}
    names = {b"\xa9nam": "title", b"\xa9ART": "artist", b"\xa9alb": "album", b"\xa9gen": "genre", b"\xa9day": "year", b"\xa9grp": "grouping"}
    out, sound = {"file_format": "m4a"}, 0
    todo = list(_atoms(data, 0, len(data)))
    while todo:
        kind, a, b = todo.pop(0)
        if kind in (b"moov", b"udta", b"ilst", b"trak", b"mdia"):
            todo += _atoms(data, a, b)
        elif kind == b"meta":
            todo += _atoms(data, a + 4, b)
        elif kind == b"mdat":
            sound += b - a
        elif kind in (b"mvhd", b"mdhd"):
            wide = data[a] == 1
            scale, length = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
            if kind == b"mvhd" and scale:
                out["duration"] = length / scale
            elif kind == b"mdhd":
                out.setdefault("sample_rate", scale)
        elif kind in names:
            for inner, x, y in _atoms(data, a, b):
                if inner == b"data":
                    out.setdefault(names[kind], data[x + 8 : y].decode("utf-8", "replace"))
    if sound and out.get("duration"):
        out["bitrate"] = int(sound * 8 / out["duration"])
    return out


def _ogg(data: bytes) -> dict:
    """Vorbis in Ogg: the first two packets, and the last page's position."""
    if data[:4] != b"OggS":
        return {}
    out, packets, part, at = {"file_format": "ogg"}, [], b"", 0
    while at + 27 <= len(data) and data[at : at + 4] == b"OggS" and len(packets) < 2:
        table = data[at + 27 : at + 27 + data[at + 26]]
        at += 27 + len(table)
        for n in table:
            part, at = part + data[at : at + n], at + n
            if n < 255:
                packets.append(part)
                part = b""
    if packets and packets[0][:7] == b"\x01vorbis":
        out["sample_rate"], rate = struct.unpack_from("<I", packets[0], 12)[0], struct.unpack_from("<i", packets[0], 20)[0]
        out |= {"bitrate": rate} if rate > 0 else {}
        last = data.rfind(b"OggS")
        out["duration"] = struct.unpack_from("<q", data, last + 6)[0] / out["sample_rate"]
    if len(packets) > 1 and packets[1][:7] == b"\x03vorbis":
        out = _comments(packets[1][7:]) | out
    return out


def _comments(body: bytes) -> dict:
    """The fields of a Vorbis comment that tags have."""
    out, p = {}, 4 + struct.unpack_from("<I", body, 0)[0]
    count, p = struct.unpack_from("<I", body, p)[0], p + 4
    for _ in range(count):
        m = struct.unpack_from("<I", body, p)[0]
        key, _, value = body[p + 4 : p + 4 + m].decode("utf-8", "replace").partition("=")
        key = {"date": "year"}.get(key.lower(), key.lower())
        if key in ("title", "artist", "album", "genre", "year", "grouping"):
            out.setdefault(key, value)
        p += 4 + m
    return out


def _id3(data: bytes) -> dict:
    if data[:3] != b"ID3":
        return {}
    names = {b"TIT2": "title", b"TPE1": "artist", b"TALB": "album", b"TCON": "genre", b"TDRC": "year", b"TYER": "year", b"TIT1": "grouping"}
    size = sum((b & 127) << 7 * k for k, b in enumerate(reversed(data[6:10])))
    out, at, end = {"file_format": "mp3"}, 10, min(10 + size, len(data))
    while at + 10 <= end and data[at] != 0:
        raw = data[at + 4 : at + 8]
        n = sum((b & 127) << 7 * k for k, b in enumerate(reversed(raw))) if data[3] >= 4 else int.from_bytes(raw, "big")
        if data[at : at + 4] in names and n > 1:
            code = ("latin-1", "utf-16", "utf-16-be", "utf-8")[data[at + 10] % 4]
            out.setdefault(names[data[at : at + 4]], data[at + 11 : at + 10 + n].decode(code, "replace").strip("\0"))
        at += 10 + n
    return out


def _flac(data: bytes) -> dict:
    if data[:4] != b"fLaC":
        return {}
    out, at, last = {"file_format": "flac"}, 4, False
    while not last and at + 4 <= len(data):
        last, kind, n = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if kind == 0 and len(body) >= 18:
            bits = int.from_bytes(body[10:18], "big")
            out["sample_rate"], samples = bits >> 44, bits & ((1 << 36) - 1)
            out["duration"] = samples / out["sample_rate"] if out["sample_rate"] else None
        elif kind == 4:
            out = _comments(body) | out
        at += 4 + n
    return out


def decode_tags(data: bytes) -> dict:
    """Tags of a file's bytes; nothing, never an error, where they can't be read."""
    for reader in (_wav, _mp3, _flac, _mp4, _ogg):
        try:
            if found := reader(data):
                return {k: v for k, v in found.items() if not isinstance(v, int) or abs(v) < 1 << 31}
        except (struct.error, IndexError, ValueError, ArithmeticError, MemoryError):
            return {}
    return {}


def audio_tags(spark: SparkSession, folders: list[str], marker: str = MARKER) -> DataFrame:
    """Decoded tags of each audio file, and whether it has the series mark."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders).select(F.regexp_replace("path", "^file:/+", "/").alias("filepath"), "content")
    df = df.where(F.lower(extension(F.col("filepath"))).isin([f".{e}" for e in EXTENSIONS]))
    types = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    schema = pa.schema([(name, types[kind]) for name, kind in (c.split() for c in TAG_SCHEMA.split(", "))])

    def run(batches):
        for batch in batches:
            rows = [{"filepath": p} | decode_tags(d) for p, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return df.mapInArrow(run, TAG_SCHEMA).withColumn("series_tagged", F.coalesce(F.contains("grouping", F.lit(marker)), F.lit(False)))


def log_tail(lines: DataFrame, n: int = 200, level: str | None = None) -> DataFrame:
    """lines(line_no, value): the last n lines, of one level if given, in order; total_lines counts all that pass."""
    rows = lines.where(F.contains("value", F.lit(f"| {level}"))) if level else lines
    total = rows.agg(F.count("*").alias("total_lines"))
    return rows.orderBy(F.desc("line_no")).limit(n).withColumn("total_lines", total.scalar()).orderBy("line_no")


def parsed_log(lines: DataFrame) -> DataFrame:
    part = lambda k: F.regexp_extract("value", LOG_PATTERN, k)
    return lines.select("line_no", part(1).alias("at"), part(2).alias("level"), part(3).alias("place"), part(4).alias("message"))


def clear_log(path: str) -> None:
    """The log file without lines."""
    open(path, "w", encoding="utf-8").close()


def visible_directories(paths: DataFrame, path: Column) -> DataFrame:
    """Folder names that don't start with a dot, without regard to case in their order."""
    name = basename(path)
    return paths.where(~name.startswith(".")).select(name.alias("name"), path.alias("path")).orderBy(F.lower("name"), "name")


def load_settings(path: str, defaults: dict) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            return defaults | json.load(f)
    except (OSError, ValueError):
        return dict(defaults)


def save_settings(path: str, settings: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(settings, f, indent=2)


def fingerprint_tool(name: str = "fpcalc") -> str | None:
    return shutil.which(name)
