"""Near-duplicate embeddings by cosine: int8 tile products with exact bounds.

Vectors are scaled to length one and quantised to int8 with a scale of their
own; the length of what quantising loses is kept per vector.  With
``x = s q + e`` and both lengths one, ``|<x, y> - s_x s_y <q_x, q_y>|`` is at most
``|e_x| + |e_y| + |e_x| |e_y|``.  Products of tiles of int8 vectors are whole
numbers below 2**24 for up to 1,040 components, so single-precision matrix products give
them exactly; longer vectors use double precision.  Pairs surely above the
threshold are links, pairs surely below are not, and only the others are
computed again in double precision.

A task compares two tiles.  It gives back one number of links per vector and a
spanning forest of the links, never the pairs.  Exact copies are collapsed first
and counted.  Every tile goes once to each tile it meets, as numbers of the
precision given; codes and bounds are made where they are used.  Tiles grow with
the table until there are ``TILES`` of ``TILE_BYTES``, so up to there the bytes
shuffled grow in proportion, and beyond with the square of the rows over the rows of a tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from edgetables.llm.common import Folder
from edgetables.plans.components import connected_components
from edgetables.plans.hot_groups import join_facts

THRESHOLD = 0.9
TILES = 8  # fewer only if they would be smaller than TILE_ROWS
TILE_ROWS = 4096
TILE_BYTES = 16_000_000  # of double precision
STRIPE_ROWS, STRIPE_CELLS = 512, 4_000_000
SLACK = 1e-5  # more than rounding adds to the bound
EXACT_SINGLE = 1040
TILE = "tile bigint, dims int, ids binary, copies binary, vectors binary"


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(units, codes, scales, errors)`` of rows: unit vectors, int8 codes, their scale, length of the loss."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    shrunk = vectors / largest  # keeps squares of huge and tiny components in range
    units = shrunk / np.sqrt((shrunk * shrunk).sum(axis=1, keepdims=True))
    scales = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scales[:, None]).astype(np.int8)
    errors = np.sqrt(((units - codes * scales[:, None]) ** 2).sum(axis=1))
    return units, codes, scales, errors


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """``root[i]`` for nodes 0..n-1 under links ``a - b``: the smallest node of each component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            nearer = root[root]
            if np.array_equal(nearer, root):
                break
            root = nearer
    return root


class Tile:
    def __init__(self, ids, copies, vectors, dims: int, kind: type):
        self.ids, self.copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
        given = np.frombuffer(vectors, kind).reshape(-1, dims).astype(np.float64)
        self.vectors, self.codes, self.scales, self.errors = quantise(given)


def compare(a: Tile, b: Tile, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(links of a, links of b, root)`` between two tiles; nodes of ``root`` are those of a, then those of b."""
    kind = np.float32 if a.codes.shape[1] <= EXACT_SINGLE else np.float64
    left, right = a.codes.astype(kind), b.codes.astype(kind).T
    worst = a.errors.max() + b.errors.max() + a.errors.max() * b.errors.max() + SLACK
    links_a, links_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    n_a, n = len(a.ids), len(a.ids) + (0 if same else len(b.ids))
    shift = 0 if same else n_a
    root = np.arange(n)
    rows = max(1, min(STRIPE_ROWS, STRIPE_CELLS // len(b.ids)))
    for top in range(0, n_a, rows):
        stripe = slice(top, top + rows)
        near = left[stripe] @ right
        near *= b.scales.astype(kind)
        floor = (threshold - worst) / a.scales[stripe, None]
        i, j = np.nonzero(near >= floor.astype(kind) - np.abs(floor).astype(kind) * kind(1e-6))
        value = near[i, j] * a.scales[i + top]
        i += top
        if same:
            later = j > i
            i, j, value = i[later], j[later], value[later]
        bound = a.errors[i] + b.errors[j] + a.errors[i] * b.errors[j] + SLACK
        linked = value - bound >= threshold
        open_ = np.flatnonzero(~linked & (value + bound >= threshold))
        for k in range(0, len(open_), 65_536):
            some = open_[k : k + 65_536]
            linked[some] = np.einsum("nd,nd->n", a.vectors[i[some]], b.vectors[j[some]]) >= threshold
        i, j = i[linked], j[linked]
        links_a += np.bincount(i, b.copies[j], n_a).astype(np.int64)
        links_b += np.bincount(j, a.copies[i], len(b.ids)).astype(np.int64)
        moved = np.flatnonzero(root != np.arange(n))
        root = forest(np.concatenate([i, moved]), np.concatenate([j + shift, root[moved]]), n)
    return links_a, links_b, root


def near_links(vectors: DataFrame, vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: one row per row of ``vectors``.

    ``n_links`` counts the other rows with cosine ``threshold`` (above zero) or more,
    ``component_id`` is the smallest id reachable over links, the row's own
    included, and ``kept`` marks the row that gave it.

    Vectors that are null, empty, zero or hold a null or non-finite component,
    and rows without an id, link with nothing; so do vectors of different
    lengths.  Repeated rows are rows of their own and link with each other.  An
    empty table gives no rows.  Further columns are not looked at.
    """
    spark = vectors.sparkSession
    folder = Folder(spark)
    given = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    sound = (
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )
    keyed = given.select(
        "vec_id",
        F.when(sound, F.col("v")).alias("v"),
        F.when(sound, F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v"))).alias("key"),
    )
    distinct = folder.store(
        keyed.filter("key is not null")
        .groupBy("key")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
        .withColumn("node", F.monotonically_increasing_id()),  # ids may repeat with other vectors
        "distinct",
    )

    n, dims = distinct.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    size = min(max(TILE_ROWS, math.ceil(n / TILES)), max(1, TILE_BYTES // (8 * dims)))
    single = isinstance(vectors.schema[vector].dataType.elementType, FloatType)
    kind = np.float32 if single else np.float64

    def tiles_of(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        held: dict[int, list] = {}
        part, made = TaskContext.get().partitionId(), 0

        def out(dims):
            nonlocal made
            ids, copies, rows = zip(*held.pop(dims))
            made += 1
            arrays = [pa.array([(part << 32) + made], pa.int64()), pa.array([dims], pa.int32())]
            columns = [np.array(ids), np.array(copies), np.array(rows).astype(kind)]
            arrays += [pa.array([c.tobytes()], pa.binary()) for c in columns]
            return pa.RecordBatch.from_arrays(arrays, names=["tile", "dims", "ids", "copies", "vectors"])

        for batch in batches:
            for rep, copies, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                some = held.setdefault(len(v), [])
                some.append((rep, copies, v.values.to_numpy()))
                if len(some) >= size + size // 8:  # rows are dealt not quite evenly
                    yield out(len(v))
        for dims in list(held):
            yield out(dims)

    tiles = folder.store(
        distinct.select("node", "copies", "v").repartition(max(1, math.ceil(n / size))).mapInArrow(tiles_of, TILE),
        "tiles",
    )
    names = tiles.select("tile", "dims")
    pairs = names.withColumnRenamed("tile", "tile_a").join(names.withColumnRenamed("tile", "tile_b"), "dims")
    pairs = pairs.filter("tile_a <= tile_b").select("tile_a", "tile_b")
    # A tile with itself is sent once.
    sent = pairs.withColumn("tile", F.explode(F.array_distinct(F.array("tile_a", "tile_b"))))
    n_tiles = tiles.count()
    tasks = min(n_tiles * (n_tiles + 1), max(2000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    met = tiles.join(sent, "tile").repartition(max(1, tasks), "tile_a", "tile_b")
    met = met.sortWithinPartitions("tile_a", "tile_b", "tile")

    def links_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name: batch.column(batch.schema.get_field_index(name))[r]
                tile, one, other = (get(name).as_py() for name in ("tile", "tile_a", "tile_b"))
                b = Tile(*[get(name).as_buffer() for name in ("ids", "copies", "vectors")], get("dims").as_py(), kind)
                if tile == one:
                    a = b
                if tile != other:
                    continue
                same = one == other
                links_a, links_b, root = compare(a, b, same, threshold)
                nodes = a.ids if same else np.concatenate([a.ids, b.ids])
                links = links_a + links_b if same else np.concatenate([links_a, links_b])
                has = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[has]), pa.array(nodes[root[has]]), pa.array(links[has])],
                    names=["node", "root", "links"],
                )

    found = folder.store(met.mapInArrow(links_of, "node bigint, root bigint, links bigint"), "found")
    joined = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = folder.store(
        distinct.select("node", "key", "rep", "copies").join(counts, "node", "left").join(joined, "node", "left"), "linked"
    )
    smallest = linked.filter("component is not null").groupBy("component").agg(F.min("rep").alias("smallest"))
    facts = join_facts(linked, smallest, "component", n).select(
        "key",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"),
        F.coalesce("smallest", "rep").alias("component"),
    )
    return (
        keyed.select("vec_id", "key")
        .join(facts, "key", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
