"""Near-duplicate vectors: all pairs with a cosine of THRESHOLD or more, by tiled comparison in principal-axis order.

Vectors of length 1 are turned to the axes of the corpus's second moments, largest first. The product of two
of them is what their leading dimensions give plus at most the product of the norms of the rest, so pairs whose bound
is below the threshold end after the first dimensions; the others go on dimension by dimension until few are left, whose cosine
is taken from the vectors as they were given, in double precision.

Equal vectors are compared once. The rest are sorted along a curve through the leading dimensions and cut in blocks of
tiles; pairs of blocks, and in a task pairs of tiles, that lie too far apart in every vector are left out. Each pair of
blocks is one task's work: it counts links and joins what they connect, so a row for each vector leaves it, not one
for each link. Pairs of blocks grow as the square of the blocks, unless distances rule them out; that is the dealt method's work.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components links with nothing, nor do vectors
of different lengths with each other. Rows are vectors, whatever their identifiers: a repeated row is another vector, linked
with the first. A null identifier is no smallest one; where a component has no other, component_id is null and kept false.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common, graph, order

THRESHOLD = 0.95
#: Vectors of a tile; of a block at least and at most.
TILE, LEAST, MOST = 256, 1024, 1 << 15
#: Leading dimensions that the sorting curve goes through, and that blocks keep the range of.
CURVE, BOX = 8, 16
#: What rounding may take from a bound in single precision.
SLACK = 1e-4


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit_rows(data: list[bytes], dims: int) -> np.ndarray:
    x = scaled(np.frombuffer(b"".join(data), "<f8").reshape(-1, dims))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows with each other, from the vectors as they are given."""
    x, y = scaled(x), scaled(y)
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def cuts_of(variances: np.ndarray) -> list[int]:
    """After how many dimensions bounds are taken: where 30 %, 60 % and all of the second moments are reached."""
    share = np.cumsum(variances) / max(variances.sum(), 1e-300)
    d = len(variances)
    return sorted({min(d, int(np.searchsorted(share, s)) + 1) for s in (0.3, 0.6)} | {d})


def rotated(units: np.ndarray, axes: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in single precision, and for each cut the norm of what lies behind it."""
    turned = units @ axes
    tails = np.sqrt(np.maximum(np.cumsum((turned * turned)[:, ::-1], 1)[:, ::-1], 0))
    tails = np.concatenate([tails, np.zeros((len(turned), 1))], 1)
    return turned.astype(np.float32), tails[:, cuts].astype(np.float32)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles, null where they have no direction."""
    for batch in batches:
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # -0.0 is 0.0, a null is no number
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)).tolist()
        parts = [values[a:b] for a, b in zip([0, *ends], ends)]
        out = [x.tobytes() if x.any() and np.isfinite(x).all() else None for x in parts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "data"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's sums of products of components, for each number of dimensions."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        by: dict[int, list[bytes]] = {}
        for data in batch.column(0).to_pylist():
            by.setdefault(len(data) // 8, []).append(data)
        for dims, rows in by.items():
            x = unit_rows(rows, dims)
            sums[dims] = sums.get(dims, 0) + x.T @ x
    for dims, total in sums.items():
        for k, row in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array([dims] * dims), pa.array(range(k * dims, (k + 1) * dims)), pa.array(row)], names=["dims", "cell", "value"])


def principal_axes(vectors: DataFrame) -> dict[int, tuple[np.ndarray, list[int]]]:
    """vectors(data) -> by number of dimensions the axes, as columns, and where bounds are taken. Spark sums dims^2 values, which the driver gets."""
    cells = vectors.select("data").mapInArrow(_moments, "dims long, cell long, value double").groupBy("dims", "cell").agg(F.sum("value").alias("value")).collect()
    sums: dict[int, np.ndarray] = {}
    for r in cells:
        sums.setdefault(r["dims"], np.zeros(r["dims"] ** 2))[r["cell"]] = r["value"]
    out = {}
    for dims, total in sums.items():
        values, axes = np.linalg.eigh(total.reshape(dims, dims))
        out[dims] = np.ascontiguousarray(axes[:, ::-1]), cuts_of(np.maximum(values[::-1], 0))
    return out


def curve_keys(turned: np.ndarray) -> np.ndarray:
    """Places on a curve that takes in turn one bit of each leading coordinate, sixteen steps from -0.5 to 0.5."""
    steps = np.clip((turned[:, :CURVE] + 0.5) * 16, 0, 15).astype(np.int64)
    key = np.zeros(len(turned), np.int64)
    for bit in (3, 2, 1, 0):
        for k in range(steps.shape[1]):
            key = (key << 1) | ((steps[:, k] >> bit) & 1)
    return key


def _keyed(axes: dict, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            data = common.column(batch, "data").to_pylist()
            keys = np.zeros(len(data), np.int64)
            dims = np.array([len(x) // 8 for x in data])
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                keys[at] = curve_keys(unit_rows([data[k] for k in at.tolist()], d) @ axes[d][0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(keys), pa.array(np.zeros(len(data), np.int32))], schema=schema)

    return run


_TILES = "block long, dims long, first long, data binary, copies binary, low array<float>, high array<float>"


def _tiles(axes: dict, block: int, schema: pa.Schema):
    """Vectors that follow one another in tiles, with the range of their leading coordinates."""

    def run(batches):
        first, dims, held, copies = 0, 0, [], []

        def tile():
            turned, _ = rotated(unit_rows(held, dims), *axes[dims])
            lead = np.zeros((len(held), BOX), np.float32)
            lead[:, : min(BOX, dims)] = turned[:, :BOX]
            return common.batch_of(schema, *([v] for v in (first // block, dims, first, b"".join(held), np.array(copies, "<i8").tobytes(), lead.min(0).tolist(), lead.max(0).tolist())))

        for batch in batches:
            for place, data, n in zip(*(common.column(batch, c).to_pylist() for c in ("place", "data", "copies"))):
                if held and (len(held) == TILE or place != first + len(held) or place % block == 0 or len(data) != 8 * dims):
                    yield tile()
                    held, copies = [], []
                if not held:
                    first, dims = place, len(data) // 8
                held.append(data)
                copies.append(n)
        if held:
            yield tile()

    return run


class _Block:
    """The tiles of one block with vectors of some number of dimensions."""

    def __init__(self, rows: list[dict], axes: np.ndarray, cuts: list[int], dims: int):
        rows = sorted(rows, key=lambda r: r["first"])
        self.copies = np.concatenate([np.frombuffer(r["copies"], "<i8") for r in rows])
        sizes = [len(r["copies"]) // 8 for r in rows]
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.places = np.concatenate([np.arange(r["first"], r["first"] + n) for r, n in zip(rows, sizes)])
        self.given = np.frombuffer(b"".join(r["data"] for r in rows), "<f8").reshape(-1, dims)
        self.turned, self.tails = rotated(unit_rows([r["data"] for r in rows], dims), axes, cuts)
        self.low, self.high = (np.array([r[c] for r in rows], np.float32) for c in ("low", "high"))

    def near(self, tile: int, other: _Block, room: float) -> np.ndarray:
        """The tiles of other that hold vectors within a squared distance of room of those of a tile, by their ranges."""
        gaps = np.maximum(0, np.maximum(other.low - self.high[tile], self.low[tile] - other.high))
        return np.flatnonzero((gaps * gaps).sum(1) <= room)


#: Columns that a tile is compared with at once.
WIDE = 4096


def _links(x: _Block, y: _Block, cuts: list[int], threshold: float, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and rows of y whose cosine reaches the threshold; of a block with itself each pair once."""
    same = x is y
    for tile in range(len(x.at) - 1):
        begin, end = x.at[tile], x.at[tile + 1]
        near = x.near(tile, y, 2 - 2 * threshold + 4 * slack)
        near = near[near >= tile] if same else near
        columns = np.concatenate([np.arange(y.at[k], y.at[k + 1]) for k in near.tolist()]) if len(near) else near
        for k in range(0, len(columns), WIDE):
            yield from _tile_links(x, y, np.arange(begin, end), columns[k : k + WIDE], cuts, threshold, slack, same)


def _tile_links(x, y, rows, columns, cuts, threshold, slack, same):
    left, right = x.turned[rows], y.turned[columns]
    so_far = left[:, : cuts[0]] @ right[:, : cuts[0]].T
    bound = so_far + np.outer(x.tails[rows, 0], y.tails[columns, 0])
    go_on = bound >= threshold - slack
    if same:
        go_on &= rows[:, None] < columns
    r, c = np.nonzero(go_on)
    value = so_far[r, c]
    for step in range(1, len(cuts)):
        if not len(r):
            return
        a, b = cuts[step - 1], cuts[step]
        if len(r) * 8 > so_far.size:  # so many that all together are cheaper
            value = value + (left[:, a:b] @ right[:, a:b].T)[r, c]
        else:
            value = value + np.einsum("ij,ij->i", left[r, a:b], right[c, a:b])
        keep = value + x.tails[rows[r], step] * y.tails[columns[c], step] >= threshold - slack
        r, c, value = r[keep], c[keep], value[keep]
    r, c = rows[r], columns[c]
    sure = value >= threshold + slack
    for k in np.array_split(np.flatnonzero(~sure), len(r) // 16384 + 1):
        sure[k] = cosines(x.given[r[k]], y.given[c[k]]) >= threshold if len(k) else False
    if sure.any():
        yield r[sure], c[sure]


def hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a and b; each label is the smallest of its class's."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


_FOUND = "place long, n_links long, joined long"


def _compare(axes: dict, threshold: float):
    """A pair of blocks: how many links each vector has there, and the smallest place that they connect it with."""
    schema = pa.schema([("place", pa.int64()), ("n_links", pa.int64()), ("joined", pa.int64())])

    def run(key, table):
        one, two = (k.as_py() for k in key)
        tiles, out = table.to_pylist(), []
        for dims in sorted({t["dims"] for t in tiles}):
            matrix, cuts = axes[dims]
            slack = 4 * dims * 2.0**-24 + 1e-6
            mine = [[t for t in tiles if t["block"] == b and t["dims"] == dims] for b in (one, two)]
            if not all(mine):
                continue
            x = _Block(mine[0], matrix, cuts, dims)
            y = x if one == two else _Block(mine[1], matrix, cuts, dims)
            shift = 0 if x is y else len(x.places)
            places = x.places if x is y else np.concatenate([x.places, y.places])
            copies = x.copies if x is y else np.concatenate([x.copies, y.copies])
            counts, labels = np.zeros(len(places), np.int64), np.arange(len(places))
            for r, c in _links(x, y, cuts, threshold, slack):
                c = c + shift
                np.add.at(counts, r, copies[c])
                np.add.at(counts, c, copies[r])
                hook(labels, r, c)
            at = np.flatnonzero(counts)
            out.append(pa.table([places[at], counts[at], places[labels[at]]], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def block_rows(n: int, dims: int, tasks: int) -> int:
    """Vectors of a block: pairs of blocks for all tasks, between LEAST and MOST vectors and at most 16 MB."""
    return max(TILE, min(MOST, max(LEAST, -(-n // math.ceil(math.sqrt(2 * tasks)))), (16 << 20) // (8 * dims)))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each vector: vec_id, n_links, component_id, kept."""
    spark = common.tune(vectors.sparkSession)
    vectors = common.clean_columns(vectors, vec_id=id_col, vector=vector_col).withColumn("vector", F.col("vector").cast("array<double>"))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = common.stored(vectors.mapInArrow(_packed, f"vec_id {kind}, data binary"), "vectors")
    distinct = common.stored(rows.where("data is not null").groupBy("data").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")), "distinct-vectors")
    axes = principal_axes(distinct)
    keyed = distinct.mapInArrow(_keyed(axes, pa.schema([("data", pa.binary()), ("least", to_arrow_type(distinct.schema["least"].dataType)), ("copies", pa.int64()), ("dims", pa.int64()), ("key", pa.int64()), ("all", pa.int32())])), f"data binary, least {kind}, copies long, dims long, key long, all int")
    placed = common.stored(order.placed(keyed, "all", ["dims", "key", "data"], "vectors-by-place").select("place", "data", "copies", "least"), "placed-vectors")
    common.drop(distinct)
    size = block_rows(placed.count(), max(axes, default=1), int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = pa.schema([("block", pa.int64()), ("dims", pa.int64()), ("first", pa.int64()), ("data", pa.binary()), ("copies", pa.binary()), ("low", pa.list_(pa.float32())), ("high", pa.list_(pa.float32()))])
    tiles = common.stored(placed.mapInArrow(_tiles(axes, size, schema), _TILES), "tiles")
    found = common.stored(tiles.join(_pairs(tiles, threshold), "block").groupBy("one", "two").applyInArrow(_compare(axes, threshold), _FOUND), "links")
    common.drop(tiles)
    classes = graph.components(found.where("place <> joined").select(F.col("place").alias("a"), F.col("joined").alias("b")), "vector-classes")
    counts = found.groupBy("place").agg(F.sum("n_links").alias("n"))
    linked = placed.join(counts, "place").join(classes.withColumnRenamed("node", "place"), "place", "left").select("place", "data", "least", "copies", "n", F.coalesce("root", "place").alias("root"))
    linked = common.stored(linked, "linked-vectors")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    alone = placed.where("copies > 1").join(counts, "place", "left_anti").select("data", (F.col("copies") - 1).alias("n_links"), F.col("least").alias("component_id"))
    known = linked.join(least, "root").select("data", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id").unionByName(alone).withColumn("known", F.lit(True))
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = rows.join(known, "data", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """(block, one, two) for both blocks of each pair that their ranges do not keep apart."""
    ranges = [f(F.col(c)[k]).alias(f"{c}{k}") for k in range(BOX) for f, c in ((F.min, "low"), (F.max, "high"))]
    boxes = common.stored(tiles.groupBy("block").agg(F.min("dims").alias("dims_from"), F.max("dims").alias("dims_to"), *ranges), "block-ranges")
    last = boxes.agg(F.max("block")).first()[0]
    one = boxes.withColumn("two", F.explode(F.sequence("block", F.lit(last or 0)))).withColumnRenamed("block", "one")
    two = boxes.select(F.col("block").alias("two"), F.col("dims_from").alias("other_from"), *(F.col(f"{c}{k}").alias(f"other_{c}{k}") for k in range(BOX) for c in ("low", "high")))
    gaps = [F.greatest(F.col(f"other_low{k}") - F.col(f"high{k}"), F.col(f"low{k}") - F.col(f"other_high{k}"), F.lit(0.0)) for k in range(BOX)]
    close = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) <= 2 - 2 * threshold + 4 * SLACK
    pairs = common.stored(one.join(two, "two").where((F.col("dims_to") >= F.col("other_from")) & close).select("one", "two"), "block-pairs")
    return pairs.select(F.col("one").alias("block"), "one", "two").unionByName(pairs.where("one <> two").select(F.col("two").alias("block"), "one", "two"))


def op12_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(common.read(spark, sf_dir, "embeddings"))


_VALID = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN {_VALID} THEN embedding::DOUBLE[] END AS e FROM embeddings),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT r, r AS other FROM v UNION SELECT reach.r, l.b FROM reach JOIN links l ON l.a = reach.other),
n AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a),
c AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.other GROUP BY reach.r)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(v.vec_id = component_id, false) AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""
