"""Similarity joins over name tokens, and leader clustering over their pairs."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ratios import best_pairs
from ..functions.similarity import overlap_score, token_set_ratio_udf
from ..functions.text import name_tokens


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder that driver and executors share; a machine's own folder serves only where all tasks run in the driver's process."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="tonearm-"))


#: Names that the whole other side may be compared with.
SMALL_SIDE = 10_000


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _ranked(sides: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(side, key, tokens) of the names of all sides, the tokens from the rarest on, by how many names have them. Names are read and taken apart once."""
    rows = None
    for side, (df, key, name) in enumerate(sides):
        own = df.select(F.lit(side).alias("side"), F.col(key).alias("key"), name_tokens(F.col(name)).alias("tokens"))
        rows = own if rows is None else rows.unionByName(own)
    tokens = checkpointed(rows.select("side", "key", F.explode("tokens").alias("token")))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"])
    return checkpointed(tokens.join(counts, "token").groupBy("side", "key").agg(ordered.alias("tokens")))


def _similar(left: DataFrame, right: DataFrame, threshold: float, once: bool) -> DataFrame:
    """left, right: (key, tokens from the rarest on).

    A Jaccard similarity above the threshold needs a common token among each side's first n - floor(n * threshold), its
    prefix; a name whose tokens are all in another's is found by its first token. So prefixes meet prefixes, and a first
    token meets what the other side has behind its prefix: a frequent token joins only names that have no rarer one there.
    """
    length = F.size("tokens") - F.floor(F.size("tokens") * F.lit(threshold)).cast("int")

    def spread(df: DataFrame, side: str, first: str, behind: str) -> DataFrame:
        rows = df.select(F.col("key").alias(f"{side}_key"), F.col("tokens").alias(f"{side}_tokens"), length.alias("length"), F.posexplode("tokens").alias("at", "token"))
        inside = F.col("at") < F.col("length")
        meets = F.array_compact(F.array(F.when(inside, F.lit("prefix")), F.when(F.col("at") == 0, F.lit(first)), F.when(~inside, F.lit(behind))))
        return rows.withColumn("meets", F.explode(meets)).drop("at", "length")

    pairs = spread(left, "left", "first left", "first right").join(spread(right, "right", "first right", "first left"), ["token", "meets"])
    pairs = pairs.where("left_key < right_key") if once else pairs
    shared = F.size(F.array_intersect("left_tokens", "right_tokens"))
    score = overlap_score(shared, F.size("left_tokens"), F.size("right_tokens"))
    return pairs.select("left_key", "right_key", score.alias("score")).where(F.col("score") > threshold).distinct()


def token_similarity_join(left: DataFrame, right: DataFrame, left_key: str, left_name: str, right_key: str, right_name: str, threshold: float = 0.5) -> DataFrame:
    """(left_key, right_key, score) of pairs above threshold, which is above 0: pairs without a common token score 0. Keys are unique on each side."""
    ranked = _ranked([(left, left_key, left_name), (right, right_key, right_name)])
    return _similar(*(ranked.where(F.col("side") == k) for k in (0, 1)), threshold, False)


def similar_names(names: DataFrame, key: str, name: str, threshold: float = 0.5) -> DataFrame:
    """Each pair of different keys once, with the smaller key on the left."""
    ranked = _ranked([(names, key, name)])
    return _similar(ranked, ranked, threshold, True)


def fuzzy_join(left: DataFrame, right: DataFrame, left_key: str, left_name: str, right_key: str, right_name: str, threshold: float, blocking: str | None = "token") -> DataFrame:
    """(left_key, right_key, score) by the token-set ratio. blocking='token' compares names with a common word; None compares all with all, for small sides only."""
    a = left.select(F.col(left_key).alias("left_key"), F.col(left_name).alias("left_name"))
    b = right.select(F.col(right_key).alias("right_key"), F.col(right_name).alias("right_name"))
    if blocking == "token":
        words = lambda df, k, n: df.select(k, F.explode(F.array_distinct(F.split(n, r"\s+"))).alias("token")).where("token <> ''")
        pairs = words(a, "left_key", "left_name").join(words(b, "right_key", "right_name"), "token").select("left_key", "right_key").distinct()
        pairs = pairs.join(a, "left_key").join(b, "right_key")
    else:
        if b.count() > SMALL_SIDE:
            raise ValueError(f"the right side has more than {SMALL_SIDE} names: compare all with all needs a small side, else use blocking")
        pairs = a.join(F.broadcast(b))
    return pairs.withColumn("score", token_set_ratio_udf(F.col("left_name"), F.col("right_name"))).where(F.col("score") >= threshold).select("left_key", "right_key", "score")


#: Distinct names of one side that a task takes.
NAMES_BLOCK = 4096


def top_similar(left: DataFrame, right: DataFrame, left_key: str, left_name: str, right_key: str, right_name: str, threshold: float, top: int = 10) -> DataFrame:
    """(left_key, right_key, score, rank): for each left row the best `top` right rows by the token-set ratio, of at least threshold; ties by right_key.

    Exact, with no pair left out that has no word in common. Each side's distinct names are dealt over blocks; a task
    takes a block of each side, bounds all its pairs by their shared words and counts of characters, and compares by falling
    bounds until none reaches the last of a name's best. A name of the right side counts with its first keys. Null names are empty and score 0.
    """
    a = checkpointed(left.select(F.col(left_key).alias("left_key"), F.coalesce(left_name, F.lit("")).alias("left_name")))
    b = checkpointed(right.select(F.col(right_key).alias("right_key"), F.coalesce(right_name, F.lit("")).alias("right_name")))
    names_a = checkpointed(a.where("left_name <> ''").select(F.col("left_name").alias("name")).distinct())
    names_b = checkpointed(b.where("right_name <> ''").groupBy(F.col("right_name").alias("name")).agg(F.min("right_key").alias("first")))
    blocks_a, blocks_b = (max(1, -(-n.count() // NAMES_BLOCK)) for n in (names_a, names_b))
    own = lambda n: F.pmod(F.xxhash64("name"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows_a = names_a.select(own(blocks_a).alias("one"), every(blocks_b).alias("two"), "name")
    rows_b = names_b.select(every(blocks_a).alias("one"), own(blocks_b).alias("two"), "name", "first")

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        x, y = x.combine_chunks(), y.combine_chunks().sort_by("first")
        texts = [t.column("name").combine_chunks().cast(pa.large_string()) for t in (x, y)]
        found = list(best_pairs(*texts, np.arange(y.num_rows), threshold, top)) if x.num_rows and y.num_rows else []
        l, r, score = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
        return pa.table({"left_name": texts[0].take(pa.array(l, pa.int64())).cast(pa.string()), "right_name": texts[1].take(pa.array(r, pa.int64())).cast(pa.string()), "score": pa.array(score, pa.float64())})

    found = rows_a.groupBy("one", "two").cogroup(rows_b.groupBy("one", "two")).applyInArrow(best, "left_name string, right_name string, score double")
    found = found.join(names_b.withColumnRenamed("name", "right_name"), "right_name")
    by_name = Window.partitionBy("left_name").orderBy(F.desc("score"), "first")
    found = found.withColumn("place", F.row_number().over(by_name)).where(F.col("place") <= top).select("left_name", "right_name", "score")
    keys = b.withColumn("place", F.row_number().over(Window.partitionBy("right_name").orderBy("right_key"))).where(F.col("place") <= top).drop("place")
    ranked = found.join(keys, "right_name").withColumn("rank", F.row_number().over(Window.partitionBy("left_name").orderBy(F.desc("score"), "right_key"))).where(F.col("rank") <= top)
    return a.join(ranked, "left_name").select("left_key", "right_key", "score", "rank")


#: Edges of a component, and of all that is joined up, that one task takes (16 bytes each); edges of a task otherwise; rounds before large components are looked at again.
TASK_EDGES, BUCKET_EDGES, ROUNDS = 1_000_000, 200_000, 3


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each node to the smallest that the task's edges connect it with."""
    parent: dict[int, int] = {}

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, find(x)) for x in list(parent)]
    yield pa.RecordBatch.from_arrays([pa.array([r for _, r in rows], pa.int64()), pa.array([x for x, _ in rows], pa.int64())], names=["a", "b"])


def _stars(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to its smallest, then every node and its smaller ones to the smallest of them."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
    low = large.groupBy("b").agg(F.min("a").alias("m"))
    small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return small.where("a < b").distinct()


def components(edges: DataFrame, small: int = TASK_EDGES) -> DataFrame:
    """edges(a, b) of long nodes -> (pos, root) of every node that has one, root being the smallest node of its component."""
    forest = checkpointed(edges.mapInArrow(_spanning, "a long, b long").where("a < b").distinct())
    while (n := forest.count()) > small:
        stars = checkpointed(_stars(forest))
        if stars.count() == n and stars.exceptAll(forest).limit(1).count() == 0:
            break
        forest = stars
    joined = forest.coalesce(1).mapInArrow(_spanning, "a long, b long") if n <= small else forest.union(forest.select("a", "a").distinct())
    return joined.select(F.col("b").alias("pos"), F.col("a").alias("root"))


_DECIDED = "pos long, leader long"


def _greedy(table: pa.Table) -> pa.Table:
    """Whole components of edges (a, b), a < b, in order of pos; rows without a say that b has the leader `held` or an earlier one, and does not lead."""
    later: dict[int, list[int]] = {}
    leader: dict[int, int] = {}
    nodes = set()
    for a, b, held in zip(*(table.column(c).to_pylist() for c in ("a", "b", "held"))):
        nodes.add(b)
        if a is None:
            leader[b] = held
        else:
            nodes.add(a)
            later.setdefault(a, []).append(b)
    for pos in sorted(nodes):
        if leader.setdefault(pos, pos) == pos:
            for b in later.get(pos, ()):
                leader[b] = min(leader.get(b, pos), pos)
    return pa.table({"pos": pa.array(leader.keys(), pa.int64()), "leader": pa.array(leader.values(), pa.int64())})


def leader_clusters(nodes: DataFrame, pairs: DataFrame, small: int = TASK_EDGES) -> DataFrame:
    """nodes(pos), pairs(a, b) with a < b -> (pos, leader).

    In order of pos a node that no earlier leader has taken becomes a leader and takes its later neighbours, which go to
    the first leader that they are neighbours of. Components are found first; tasks decide small ones whole, in
    order of pos. Of larger ones the nodes without an earlier neighbour lead, their neighbours follow,
    and edges from followers go, some rounds over, until what is left falls apart into small ones.
    """
    edges = checkpointed(pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct())
    held = edges.select(F.col("b").alias("pos"), F.col("a").alias("held")).limit(0)
    decided, first = None, True
    while True:
        roots = components(edges, small)
        rows = edges.join(roots.withColumnRenamed("pos", "b"), "b").select("root", "a", "b", F.lit(None).cast("long").alias("held"))
        if not first:
            rows = rows.unionByName(held.join(roots, "pos").select("root", F.lit(None).cast("long").alias("a"), F.col("pos").alias("b"), "held"))
        rows = checkpointed(rows)
        sizes = rows.groupBy("root").agg(F.count("*").alias("n"))
        total = rows.count()
        large = checkpointed(sizes.where(F.col("n") > small)) if total > small else None
        whole = rows if large is None else rows.join(large, "root", "left_anti")
        bucket = F.pmod(F.xxhash64("root"), F.lit(max(8, -(-total // BUCKET_EDGES)))).alias("bucket")
        found = whole.groupBy(bucket).applyInArrow(_greedy, _DECIDED)
        decided = found if decided is None else decided.unionByName(found)
        if large is None or large.limit(1).count() == 0:
            break
        decided, first = checkpointed(decided), False
        rest = rows.join(large, "root", "left_semi")
        edges, held, more = _large_rounds(rest.where("a is not null").select("a", "b"), rest.where("a is null").select(F.col("b").alias("pos"), "held"))
        decided = decided.unionByName(more)
    kind = nodes.schema["pos"].dataType
    return nodes.select("pos").join(decided.withColumnRenamed("leader", "found"), "pos", "left").select("pos", F.coalesce(F.col("found").cast(kind), F.col("pos")).alias("leader"))


def _large_rounds(edges: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, held, decided) after some rounds: nodes that nothing may take lead, their neighbours follow them."""
    everything = edges.select(F.col("a").alias("pos")).union(edges.select("b")).union(held.select("pos")).distinct()
    for _ in range(ROUNDS):
        lead = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")), "a", "left_anti").join(held.select(F.col("pos").alias("a")), "a", "left_anti")
        taken = edges.join(lead, "a", "left_semi").select(F.col("b").alias("pos"), F.col("a").alias("held"))
        held = checkpointed(held.unionByName(taken).groupBy("pos").agg(F.min("held").alias("held")))
        # followers lead nothing, and what is behind a node's leader is no matter to it
        edges = edges.join(lead, "a", "left_anti").join(held.select(F.col("pos").alias("a")), "a", "left_anti")
        edges = checkpointed(edges.join(held.withColumnRenamed("pos", "b"), "b", "left").where(F.col("held").isNull() | (F.col("a") < F.col("held"))).select("a", "b"))
    open_ = edges.select(F.col("a").alias("pos")).union(edges.select("b")).distinct()
    done = everything.join(open_, "pos", "left_anti").join(held, "pos", "left").select("pos", F.coalesce("held", "pos").alias("leader"))
    return edges, checkpointed(held.join(open_, "pos", "left_semi")), checkpointed(done)
