"""Merkle manifest of a dataset: a hash tree for each group of rows, a tree over the groups, and a proof for every row.

The leaves are sorted by ranges of (group, key); the counts of each group in each partition give every leaf its place in
its group. Leaves of one partition are packed into blocks of 2^BLOCK places. A partition builds the complete aligned
subtrees of its blocks itself; where a partition ends inside a block, the ragged nodes are shuffled by the block's
coordinate and joined there. Upper levels are finished FAN levels at a time, each aligned run of nodes in one task, and
the siblings that each step has seen are handed down again: one row for each node and at last one for each block. Rows
of a group need neither fit in a task nor does any node wait for more than 2^FAN others.

The tree: every two consecutive nodes become their hash, the last alone if their number is odd, until one remains (a
lone leaf itself). Digests are hashed as their hex text.

Defined results: a null field is `-`; a null group comes first; null keys come first in their group, rows with equal keys
go by their leaf; rows that repeat are leaves of their own; an empty table gives no rows. Tampering reaches no row with a null identifier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import common, order

#: Levels of a block's tree, and levels that are joined at a time above it.
BLOCK, FAN = 10, 10


def _hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def level_size(n: int, level: int) -> int:
    return -(-n >> level) if n else 0


def grow(nodes: dict[tuple[int, int], str], n: int, top: int) -> dict[tuple[int, int], str]:
    """All nodes (level, place) up to level top, or the root, that follow from the given ones of a tree of n leaves."""
    out, levels = dict(nodes), {}
    for level, place in nodes:
        levels.setdefault(level, set()).add(place)
    for level in range(min(levels, default=top), top):
        size = level_size(n, level)
        if size == 1:
            break
        for place in {p >> 1 for p in levels.get(level, ())}:
            left, right = out.get((level, 2 * place)), out.get((level, 2 * place + 1))
            if left is not None and (right is not None or 2 * place + 1 >= size):
                out[level + 1, place] = _hash(left, right) if right is not None else _hash(left)
                levels.setdefault(level + 1, set()).add(place)
    return out


def crowns(nodes: dict[tuple[int, int], str], top: int) -> list[tuple[int, int]]:
    """The nodes whose parents are not among them."""
    return [(k, p) for k, p in nodes if (k + 1, p >> 1) not in nodes or k >= top]


def climb(nodes: dict[tuple[int, int], str], n: int, level: int, place: int, top: int) -> list[str]:
    """Steps from a node up to the last known one below top: a sibling's digest with `<` if it stands left, `>` if right, `-` without one."""
    steps = []
    while level < top and level_size(n, level) > 1 and (level + 1, place >> 1) in nodes:
        other = place ^ 1
        steps.append("-" if other >= level_size(n, level) else ("<" if other < place else ">") + nodes[level, other])
        level, place = level + 1, place >> 1
    return steps


def fold(digest: str, steps: list[str]) -> str:
    for step in steps:
        digest = _hash(digest) if step == "-" else _hash(step[1:], digest) if step[0] == "<" else _hash(digest, step[1:])
    return digest


def siblings_digest(steps: list[str]) -> str:
    return _hash(*(s[1:] for s in steps))


def field(column: str) -> Column:
    """A value as its UTF-8 byte count, `:` and itself; null as `-`."""
    text = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[str], **other: Column) -> Column:
    """The digest of a row's fields; other: what stands for some of them."""
    return F.sha2(F.concat(*(other.get(c, field(c)) for c in columns)), 256)


def group_key(column: Column) -> Column:
    """A string that sorts like the column, null first."""
    return F.coalesce(F.concat(F.lit("1"), column.cast("string")), F.lit("0"))


_BLOCKS = "grp string, block long, first long, n long, keys array<{kind}>, leaves array<string>, changed array<string>, nodes array<struct<level:int,place:long,digest:string>>"
_STEPS = "grp string, n long, level int, place long, digest string, below array<struct<level:int,place:long,steps:array<string>>>"


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(ddl))


def ascend(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """leaves(grp string, key, digest string, changed string) -> (blocks, steps, roots).

    blocks: the leaves of one partition and block from place `first` on, in a tree of `n`, and their uppermost nodes.
    steps: for each round a row for each node that it made, with the nodes below it and the steps from them to it.
    roots: grp, n, level, place, digest.
    """
    kind = leaves.schema["key"].dataType.simpleString()
    placed = order.placed(leaves, "grp", ["key", "digest"], "leaves").select("grp", "place", "n", "key", "digest", "changed")
    ddl = _BLOCKS.format(kind=kind)
    schema, height = _arrow(ddl), BLOCK
    blocks = common.stored(placed.mapInArrow(lambda batches: _pack(batches, schema, height), ddl), "blocks")
    nodes = blocks.select("grp", "n", F.inline("nodes"))
    steps, top = [], BLOCK
    while True:
        done = (F.col("level") >= top) | (_size("level") == 1)
        if common.is_empty(nodes.where(~done)):
            if common.is_empty(nodes.where(_size("level") > 1)):
                return blocks, steps, nodes
        else:
            above = F.expr(f"shiftright(place, {top} - level)").alias("above")
            met = nodes.where(~done).groupBy("grp", "n", above).agg(F.collect_list(F.struct("level", "place", "digest")).alias("nodes"))
            steps.append(common.stored(met.mapInArrow(_join_up(top, _arrow(_STEPS)), _STEPS), "steps"))
            nodes = nodes.where(done).select("grp", "n", "level", "place", "digest").unionByName(steps[-1].select("grp", "n", "level", "place", "digest"))
        top += FAN


def _size(level: str) -> Column:
    return F.expr(f"shiftright(n - 1, {level}) + 1")


def _pack(batches: Iterator[pa.RecordBatch], schema: pa.Schema, height: int) -> Iterator[pa.RecordBatch]:
    """Leaves that follow one another in blocks, with the uppermost nodes that follow from each block's own leaves."""
    run, first, held = None, 0, []

    def block():
        grp, n = run
        keys, digests, changed = zip(*held)
        nodes = grow({(0, first + k): d for k, d in enumerate(digests)}, n, height)
        tops = [{"level": k, "place": p, "digest": nodes[k, p]} for k, p in crowns(nodes, height)]
        return common.batch_of(schema, *([v] for v in (grp, first >> height, first, n, list(keys), list(digests), list(changed), tops)))

    for batch in batches:
        for grp, place, n, key, digest, changed in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (run != (grp, n) or place != first + len(held) or place & ((1 << height) - 1) == 0):
                yield block()
                held = []
            if not held:
                run, first = (grp, n), place
            held.append((key, digest, changed))
    if held:
        yield block()


def _join_up(top: int, schema: pa.Schema):
    """Nodes of an aligned run -> the node above them all, and the steps from each to it."""

    def run(batches):
        for batch in batches:
            rows = []
            for grp, n, _, nodes in zip(*(c.to_pylist() for c in batch.columns)):
                known = {(x["level"], x["place"]): x["digest"] for x in nodes}
                grown = grow(known, n, top)
                ((level, place),) = crowns(grown, top)
                rows.append((grp, n, level, place, grown[level, place], [{"level": k, "place": p, "steps": climb(grown, n, k, p, top)} for k, p in known]))
            yield common.batch_of(schema, *zip(*rows)) if rows else pa.RecordBatch.from_pylist([], schema)

    return run


def descend(steps: list[DataFrame], paths: DataFrame) -> DataFrame:
    """paths(grp, level, place, subroot, path) of the roots -> those of all nodes that the rounds have met."""
    for step in reversed(steps):
        met = step.select("grp", "level", "place", "below").join(paths, ["grp", "level", "place"]).select("grp", "subroot", "path", F.inline("below"))
        paths = common.stored(paths.unionByName(met.select("grp", "level", "place", "subroot", F.concat("steps", "path").alias("path"))), "paths")
    return paths


def proofs(blocks: DataFrame, paths: DataFrame, root: str | None) -> DataFrame:
    """A row for each leaf: grp, key, leaf, subroot, proof (the steps to the root) and what follows from it."""
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    ddl = f"grp string, key {kind}, leaf string, subroot string, proof array<string>, proof_sha256 string, folded_root string, verified boolean"
    schema, height = _arrow(ddl), BLOCK
    tops = blocks.select("grp", "first", F.inline("nodes")).join(paths, ["grp", "level", "place"]).groupBy("grp", "first").agg(F.first("subroot").alias("subroot"), F.collect_list(F.struct("level", "place", "path")).alias("tops"))

    def run(batches):
        for batch in batches:
            for grp, first, n, keys, leaves, changed, subroot, tops in zip(*(c.to_pylist() for c in batch.columns)):
                nodes = grow({(0, first + k): d for k, d in enumerate(leaves)}, n, height)
                above = {(t["level"], t["place"]): t["path"] for t in tops}
                rows = []
                for k, (key, digest, other) in enumerate(zip(keys, leaves, changed)):
                    own = climb(nodes, n, 0, first + k, height)
                    steps = own + above[len(own), (first + k) >> len(own)]
                    folded = fold(digest if other is None else other, steps)
                    rows.append((grp, key, digest, subroot, steps, siblings_digest(steps), folded, folded == root))
                yield common.batch_of(schema, *map(list, zip(*rows)))

    joined = blocks.join(tops, ["grp", "first"])
    return joined.select("grp", "first", "n", "keys", "leaves", "changed", "subroot", "tops").mapInArrow(run, ddl)


def manifest(leaves: DataFrame) -> tuple[DataFrame, str | None]:
    """leaves(grp string, key, digest string, changed string) -> (proofs, root digest).

    Groups are ordered by grp. Where `changed` is not null, it is folded up the proof in place of the leaf.
    """
    blocks, steps, roots = ascend(leaves)
    upper, upper_steps, top = ascend(roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest", F.lit(None).cast("string").alias("changed")))
    found = top.select("digest").first()
    root = found["digest"] if found else None
    start = top.select("grp", "level", "place", F.col("digest").alias("subroot"), F.expr("cast(array() as array<string>)").alias("path"))
    of_groups = proofs(upper, descend(upper_steps, start), root).select(F.col("key").alias("grp"), F.col("proof").alias("path"))
    start = roots.select("grp", "level", "place", F.col("digest").alias("subroot")).join(of_groups, "grp")
    return proofs(blocks, descend(steps, common.stored(start, "paths")), root), root


#: The fields of a document's leaf, in their order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_manifest(docs: DataFrame, tampered: Column | None = None) -> tuple[DataFrame, str | None]:
    """The manifest of documents, grouped by lang; where tampered holds, a leaf with n_chars + 1 is folded in place of the document's."""
    docs = docs.select(*(F.col(f"`{c}`") for c in FIELDS))
    more = F.coalesce(F.concat(F.octet_length((F.col("n_chars") + 1).cast("string")).cast("string"), F.lit(":"), (F.col("n_chars") + 1).cast("string")), F.lit("-"))
    changed = F.when(tampered, leaf(FIELDS, n_chars=more)) if tampered is not None else F.lit(None).cast("string")
    return manifest(docs.select(group_key(F.col("lang")).alias("grp"), F.col("doc_id").alias("key"), leaf(FIELDS).alias("digest"), changed.alias("changed")))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    every = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    rows, root = document_manifest(common.read(spark, sf_dir, "documents"), every)
    return rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", "verified")


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
#: CRC-32 of a string of ASCII characters, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(CAST(doc_id AS VARCHAR), '')])), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)"
SQL = f"""
WITH RECURSIVE base AS MATERIALIZED (
  SELECT doc_id, lang, leaf, changed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT *, {_LEAF.format("n_chars")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN {_LEAF.format("(n_chars + 1)")} END AS changed FROM documents)),
tree AS (
  SELECT lang, 0 AS level, place, n, leaf AS digest FROM base
  UNION ALL
  SELECT lang, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM tree WHERE n > 1 GROUP BY lang, level, place // 2, n),
tops AS MATERIALIZED (SELECT lang, level AS height, digest AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS rank, count(*) OVER () AS n FROM tree WHERE n = 1),
upper AS (
  SELECT 0 AS level, rank AS place, n, subroot AS digest FROM tops
  UNION ALL
  SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM upper WHERE n > 1 GROUP BY level, place // 2, n),
rows AS MATERIALIZED (SELECT row_number() OVER () AS id, base.*, t.subroot, t.height, t.rank FROM base JOIN tops t ON base.lang IS NOT DISTINCT FROM t.lang),
heights AS (SELECT max(level) AS top, max(CASE WHEN n = 1 THEN digest END) AS root FROM upper),
ways AS MATERIALIZED (
  SELECT r.id, t.level AS step, (r.place >> t.level) & 1 AS is_right, s.digest AS other
  FROM rows r JOIN (SELECT DISTINCT lang, level FROM tree WHERE n > 1) t ON r.lang IS NOT DISTINCT FROM t.lang
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM r.lang AND s.level = t.level AND s.place = xor(r.place >> t.level, 1)
  UNION ALL
  SELECT r.id, r.height + t.level, (r.rank >> t.level) & 1, s.digest
  FROM rows r CROSS JOIN (SELECT DISTINCT level FROM upper WHERE n > 1) t LEFT JOIN upper s ON s.level = t.level AND s.place = xor(r.rank >> t.level, 1)),
proofs AS (SELECT id, sha256(string_agg(other, '' ORDER BY step)) AS proof FROM ways GROUP BY id),
folded AS (
  SELECT id, 0 AS step, coalesce(changed, leaf) AS digest FROM rows
  UNION ALL
  SELECT f.id, f.step + 1, sha256(CASE WHEN w.other IS NULL THEN f.digest WHEN w.is_right = 1 THEN w.other || f.digest ELSE f.digest || w.other END) FROM folded f JOIN ways w ON f.id = w.id AND f.step = w.step),
ends AS (SELECT id, max_by(digest, step) AS folded_root FROM folded GROUP BY id)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM rows JOIN ends USING (id) LEFT JOIN proofs USING (id) CROSS JOIN heights
"""
