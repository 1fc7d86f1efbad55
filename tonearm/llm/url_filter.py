"""URL rules through cascades of Bloom filters.

The key universe is every (host suffix, path prefix) of the corpus that has as many labels and characters as
some rule. For each verdict a cascade is built: the first filter holds that verdict's listed keys, the second the
universe's other keys that pass the first, the third the listed keys that pass the second, and so on until no
key passes wrongly. The level at which a key first fails tells whether it is listed, exactly, for every key of
the universe; urls are then judged without a join.

Filters are broadcast up to MAX_FILTER_BITS; beyond it the keys are tested by a join.

Defined results: a null url or one without `://` has an empty host and path and no rule; an empty path starts with
no rule's path; urls that no rule fits are blocked if their host is on the method's list (hosts with one of
HOST_WORDS in a label) or on a table of domains, else they get the default verdict; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path): fixed values of the query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Words of a host's labels that put the host on the method's own block list.
HOST_WORDS = ("ads", "adult", "bets", "casino", "pills", "poker", "porn", "spam", "xxx")
FIRST_RATE, OTHER_RATE = 0.01, 0.5
MAX_FILTER_BITS = 1 << 27
#: The name of the cascade over whole hosts.
HOST = "host"


def split_url(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url_col}, instr({url_col}, '://') + 3)")).otherwise("")
    return urls.withColumn("host", F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def with_keys(urls: DataFrame, labels: list[int], lengths: list[int], parents: bool = False) -> DataFrame:
    """Adds keys: the host's suffixes of so many labels, each with the path's prefixes of so many characters; and //host, with parents //suffix for every suffix.

    One expression, however many labels and lengths there are.
    """
    parts, numbers = F.split("host", r"\."), lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
    suffix = lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")
    suffixes = F.transform(F.filter(numbers(labels), lambda n: n <= F.size(parts)), suffix)
    prefixes = F.transform(F.filter(numbers(lengths), lambda k: k <= F.length("path")), lambda k: F.substring("path", F.lit(1), k))
    own = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("//"), suffix(n))) if parents else F.array(F.concat(F.lit("//"), F.col("host")))
    return urls.withColumn("keys", F.concat(own, hosts))


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64("key").alias("a"), F.xxhash64("key", F.lit(1)).alias("b"))


class Bloom:
    """seed: the level, so that keys that collide at one level part at another."""

    def __init__(self, bits: int, hashes: int, words: np.ndarray, seed: int):
        self.bits, self.hashes, self.words, self.seed = bits, hashes, words, seed

    def places(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        a = (a.view(np.uint64) ^ np.uint64(self.seed * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
        a, b = a ^ (a >> np.uint64(32)), b.view(np.uint64) | np.uint64(1)
        return [(a + np.uint64(i) * b) % np.uint64(self.bits) for i in range(self.hashes)]

    def passes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        for p in self.places(a, b):
            ok &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return ok

    @staticmethod
    def of(hashed: DataFrame, n: int, rate: float, seed: int, pair: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> Bloom:
        """Filter words are or-ed together in Spark; the driver gets one row for each word that is set.

        hashed: a and b; or one column, of whose values pair makes both: a step of its own would give each task a second Python worker.
        """
        bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
        hashes = max(1, round(bits / max(n, 1) * math.log(2))) if bits > 64 else 2
        empty = Bloom(bits, hashes, np.zeros(bits // 64 + 1, np.uint64), seed)

        def places(batches):
            for batch in batches:
                a, b = pair(batch.column(0).to_numpy()) if pair else (common.column(batch, c).to_numpy() for c in "ab")
                p = np.concatenate(empty.places(a, b)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(p >> 6), pa.array(np.left_shift(np.int64(1), p & 63))], names=["word", "bit"])

        for word, mask in (hashed if pair else hashed.select("a", "b")).mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("mask")).collect():
            empty.words[word] = np.int64(mask).astype(np.uint64)
        return empty


class Cascade:
    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Level k fails first: not listed for even k, listed for odd k (levels count from 0)."""
        out, open_ = np.zeros(len(a), bool), np.ones(len(a), bool)
        for k, level in enumerate(self.levels):
            now = level.passes(a, b)
            out[open_ & ~now] = k % 2 == 1
            open_ &= now
        out[open_] = len(self.levels) % 2 == 1
        return out


def _passing(hashed: DataFrame, level: Bloom, name: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            ok = level.passes(common.column(batch, "a").to_numpy(), common.column(batch, "b").to_numpy())
            yield batch.filter(pa.array(ok))

    return common.stored(hashed.mapInArrow(run, hashed.schema), name)


def build_cascade(universe: DataFrame, listed: DataFrame, max_bits: int = MAX_FILTER_BITS) -> Cascade | None:
    """universe, listed: distinct keys as (key, a, b). None if the listed keys need a larger filter than may be broadcast."""
    n = listed.count()
    if n * 10 > max_bits:
        return None
    levels, inside, outside, rate = [], listed, universe.join(listed.select("key"), "key", "left_anti"), FIRST_RATE
    while n:
        levels.append(Bloom.of(inside, n, rate, len(levels)))
        wrong = _passing(outside, levels[-1], "cascade")
        n, rate = wrong.count(), OTHER_RATE
        inside, outside = wrong, inside
        if n * 10 > max_bits:
            return None
    return Cascade(levels)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", host_words=HOST_WORDS, max_bits: int = MAX_FILTER_BITS, blocked: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row: the longest rule that fits the host or a parent domain and starts the path.

    blocked(host): a table of domains, of any size, that are blocked with their subdomains where no rule fits.
    """
    spark = pages.sparkSession
    pages = split_url(common.clean_columns(pages, page_id=id_col, url=url_col))
    labels, lengths = sorted({h.count(".") + 1 for _, h, _ in rules}), sorted({len(p) for *_, p in rules})
    keyed = with_keys(pages, labels, lengths, blocked is not None)
    universe = common.stored(_hashed(keyed.select(F.explode("keys").alias("key")).distinct()), "url-keys")
    hosts = universe.where(F.col("key").rlike(host_pattern(host_words)))
    if blocked is not None:
        listed_hosts = blocked.select(F.concat(F.lit("//"), F.translate("host", string.ascii_uppercase, string.ascii_lowercase)).alias("key")).distinct()
        hosts = hosts.unionByName(universe.join(listed_hosts, "key", "left_semi")).distinct()
    ruled = spark.createDataFrame([(v, h + p) for v, h, p in rules], "verdict string, key string")
    listed = {v: _hashed(ruled.where(F.col("verdict") == v).select("key").distinct()) for v in sorted({v for v, *_ in rules})} | {HOST: hosts}
    cascades = {v: build_cascade(universe, keys, max_bits) for v, keys in listed.items()}
    if None in cascades.values():
        return _judge_by_join(keyed, {v: keys.select("key") for v, keys in listed.items()}, default)
    kind = pages.schema["page_id"].dataType.simpleString()
    hashed = keyed.select("page_id", "host", "path", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("a"), F.transform("keys", lambda k: F.xxhash64(k, F.lit(1))).alias("b"))
    names = list(cascades)

    def run(batches):
        for batch in batches:
            keys, a, b = (common.column(batch, c) for c in ("keys", "a", "b"))
            ends = keys.value_lengths().to_numpy().cumsum()
            flat, fa, fb = keys.flatten().to_pylist(), a.flatten().to_numpy(), b.flatten().to_numpy()
            found = np.full(len(flat), -1)
            for k, v in enumerate(names):
                found[cascades[v].listed(fa, fb)] = k
            rule, verdict, begin = [], [], 0
            for end in ends.tolist():
                hits = [(names[found[i]], flat[i]) for i in range(begin, end) if found[i] >= 0]
                best = max(((len(k), k, v) for v, k in hits if v != HOST), default=None)
                rule.append(best and best[1])
                verdict.append(best[2] if best else "block" if hits else default)
                begin = end
            yield pa.RecordBatch.from_arrays([*(common.column(batch, c) for c in ("page_id", "host", "path")), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return hashed.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def host_pattern(host_words) -> str:
    return "^//(.*[.-])?(" + "|".join(host_words or ["$^"]) + ")([.-].*)?$"


def _judge_by_join(keyed: DataFrame, listed: dict[str, DataFrame], default: str) -> DataFrame:
    """For lists too large to broadcast as filters."""
    rows = common.stored(keyed.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    keys = None
    for v, k in listed.items():
        k = k.select("key", F.lit(v).alias("verdict"))
        keys = k if keys is None else keys.unionByName(k)
    hits = rows.select("row", F.explode("keys").alias("key")).join(keys, "key")
    ruled = F.when(F.col("verdict") != HOST, F.struct(F.length("key").alias("n"), "key", "verdict"))
    best = hits.groupBy("row").agg(F.max(ruled).alias("best"))
    verdict = F.coalesce("best.verdict", F.when(F.col("hit"), F.lit("block")), F.lit(default))
    return rows.join(best.withColumn("hit", F.lit(True)), "row", "left").select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "pages"), RULES)


def _sql() -> str:
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    when = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in cases)
    verdict = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in cases)
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
          regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, CASE {when} END AS rule FROM split)
SELECT page_id, host, path, rule, CASE rule {verdict} ELSE CASE WHEN regexp_matches('//' || host, '{host_pattern(HOST_WORDS)}') THEN 'block' ELSE 'allow' END END AS verdict FROM ruled
"""


SQL = _sql()
