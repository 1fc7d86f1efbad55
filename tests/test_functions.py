import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonearm.functions import media, ratios, text
from tonearm.functions.similarity import lcs, token_set_ratio, token_similarity
from tonearm.operators.aggregates import common_prefix
from tonearm.sources import files


def values(spark, expression, rows):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x string")
    return [r["v"] for r in df.select("k", expression(F.col("x")).alias("v")).orderBy("k").collect()]


@pytest.mark.parametrize(
    "name, display, normalized, episode",
    [
        ("Show Name 123.mp3", "Show Name", "show name", "123"),
        ("Show Name Episode 45.mp3", "Show Name Episode", "show name episode", "45"),
        ("Show Name Episode 7.mp3", "Show Name", "show name", "7"),
        ("Deep 5.mp3", "De", "de", "5"),
        ("Mix (20 July 2016).mp3", "Mix", "mix", None),
        ("Mix (2016).flac", "Mix", "mix", None),
        ("Mix (2024-01-15 10.58.00 Monday).mp3", "Mix", "mix", None),
        ("Some-Show_2024.01.15.ogg", "Some Show", "some show", None),
        ("Night July 2005 Mix part 2.mp3", "Night", "night", None),
        ("01 - Name.mp3", "Name", "name", None),
        ("Café-Élan 12.mp3", "Café-Élan", "caféélan", "12"),
    ],
)
def test_series_name(spark, name, display, normalized, episode):
    got = values(spark, text.series_name, [name])[0]
    assert (got["display"], got["normalized"], got["episode"]) == (display, normalized, episode)


def test_clean_string(spark):
    assert values(spark, text.clean_string, [None, "", "DJ X_Live [HQ] (Set) 2024-01-15.mp3", "A--B part 2 320"]) == ["", "", "x", "a b"]


def test_filename_metadata(spark):
    got = values(spark, text.filename_metadata, ["Artist - Title.mp3", "Artist @ Event.mp3", "Only.mp3", "A - B - C.mp3"])
    assert [(g["artist"], g["title"]) for g in got] == [("Artist", "Title"), ("Artist", "Event"), (None, "Only"), ("A", "B - C")]


def test_parse_track(spark):
    got = values(spark, text.parse_track, ["01. A - B", "[00:10] A – B", "Only", "A / B - C"])
    assert [(g["artist"], g["title"]) for g in got] == [("A", "B"), ("A", "B"), ("", "Only"), ("A / B", "C")]


def test_urls(spark):
    assert values(spark, text.domain, ["http://www.a.org:80/x", "nothing", None]) == ["a.org:80", "", None]
    assert values(spark, text.unwrapped, ["/url?q=http%3A%2F%2Fa.org&x=1", "http://b"]) == ["http://a.org", "http://b"]
    page = F.lit("http://a.org/d/e.html?x")
    assert values(spark, lambda c: text.absolute_url(c, page), ["//b/c", "/c", "c", "https://q"]) == ["http://b/c", "http://a.org/c", "http://a.org/d/c", "https://q"]


def test_formats(spark):
    df = spark.createDataFrame([(61.9, 1 << 30), (0.0, 1536 * 1024), (None, 0)], "s double, n long")
    assert [r[0] for r in df.select(media.clock(F.col("s"))).collect()] == ["1:01", "--:--", "--:--"]
    assert [r[0] for r in df.select(media.human_size(F.col("n"))).collect()] == ["1.00 GB", "1.5 MB", "0.0 MB"]
    assert spark.range(1).select(media.percent(F.lit(1), F.lit(0)), media.percent(F.lit(1), F.lit(8))).first()[:] == (0, 13)


def test_waveform(spark):
    df = spark.createDataFrame([([1.0, -1.0, 2.0, -2.0, 9.0],), ([0.0] * 4,)], "x array<double>")
    assert [r[0] for r in df.select(media.waveform(F.col("x"), 2)).collect()] == [[0.5, 1.0], [0.5, 0.5]]


def test_token_similarity(spark):
    def sim(a, b):
        return spark.range(1).select(token_similarity(text.name_tokens(F.lit(a)), text.name_tokens(F.lit(b)))).first()[0]

    assert math.isclose(sim("Patterns", "Gai Barone Patterns"), 0.5 + 0.5 / 3)
    assert sim("the a", "words here") == 0.0
    assert math.isclose(sim("alpha beta gamma", "alpha beta delta"), 0.5)


def test_token_set_ratio():
    assert math.isclose(token_set_ratio("fuzzy was a bear but not a dog", "fuzzy was a bear but not a cat"), 92.3077, abs_tol=1e-3)
    assert token_set_ratio("a b", "b a c") == 100.0
    assert token_set_ratio("", "x") == 0.0


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for k, y in enumerate(b, 1):
            prev, row[k] = row[k], prev + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=20), st.text("abc ", max_size=20))
def test_ratio_properties(a, b):
    assert lcs(a, b) == plain_lcs(a, b)
    assert 0 <= token_set_ratio(a, b) <= 100
    assert math.isclose(token_set_ratio(a, b), token_set_ratio(b, a))


def test_common_prefix(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", "x"), ("same", "same"), ("a", "b")], "x string, y string")
    assert [r[0] for r in df.select(common_prefix(F.col("x"), F.col("y"))).collect()] == ["ab", "", "same", ""]


def test_odd_headers_have_no_tags():
    """Headers that promise nothing sensible end no job: rates of 0 and beyond 32 bits, lengths beyond the file."""
    wav = b"RIFF" + struct.pack("<I", 100) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 0xFFFFFFFF, 4, 16) + b"data" + struct.pack("<I", 0xFFFFFFFF)
    found = files.decode_tags(wav)
    assert all(abs(v) < 1 << 31 for v in found.values() if isinstance(v, int))
    page = b"OggS" + bytes(22) + bytes([1, 30]) + b"\x01vorbis" + struct.pack("<IBIiiiBB", 0, 2, 0, 0, 0, 0, 0xB8, 1)
    assert files.decode_tags(page) == files.decode_tags(page) and isinstance(files.decode_tags(page), dict)
    for k in range(0, 200, 7):
        assert isinstance(files.decode_tags(page[:k] + bytes([255 - k]) * 40), dict)
        assert isinstance(files.decode_tags(wav[:k] + bytes([255 - k]) * 40), dict)


def test_pair_ratios():
    """Batches give what pairs give: repeated words, words of several lanes, characters beyond the first plane, empty sides."""
    rng = random.Random(7)
    words = ["golden", "hour", "the", "x" * 70, "日本", "😀a", "é", "a", "b", "waves" * 30]
    names = [rng.choice([" ", "  ", "\t", "\x1c"]).join(rng.choices(words, k=rng.randint(0, 8))) for _ in range(400)]
    a, b = names[:200], names[200:]
    got = ratios.pair_ratios(pa.array([*a, None, ""]), pa.array([*b, "x", None]))
    assert got.tolist() == [*(token_set_ratio(x, y) for x, y in zip(a, b)), 0.0, 0.0]
    table = ratios.Names(pa.array(names))
    bounds = table.bounds(np.arange(60), np.arange(60, 160), table.histograms())
    assert all(bounds[i, j] + 1e-9 >= token_set_ratio(names[i], names[60 + j]) for i in range(60) for j in range(100))
    assert ratios.pair_ratios(pa.array([], pa.string()), pa.array([], pa.string())).tolist() == []
    assert list(ratios.best_pairs(pa.array(["a"]), pa.array([], pa.string()), np.arange(0), 50, 3)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab c", max_size=90), st.text("abd ", max_size=90)), min_size=1, max_size=12))
def test_pair_ratios_of_any_text(pairs):
    got = ratios.pair_ratios(*(pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)))
    assert got.tolist() == [token_set_ratio(*p) for p in pairs]
