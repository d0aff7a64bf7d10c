"""Synthetic edge tables as Spark jobs.

Every builder maps a slot number to an edge with column arithmetic: the slot
picks one cell of a grid that lists each allowed edge once, through a keyed
permutation.  The edges of a family are therefore distinct and their number is
exact without a shuffle, and any partition can be rebuilt on its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from edgetables.functions.ids import big, hash_below, int_div, with_permuted_cell

SLOTS_PER_PARTITION = 8_000_000
CHASE_STEPS = (6, 48)  # a chase goes on with probability 1/2 per step; few need the second leg

Endpoints = tuple[Column, Column]


class Clique(NamedTuple):
    """Grid over the unordered pairs of ``size`` things: ``ring * half`` cells, one per pair."""

    size: int

    @property
    def ring(self) -> int:
        return self.size if self.size % 2 else max(self.size - 1, 0)

    @property
    def half(self) -> int:
        return (self.size - 1) // 2 if self.size % 2 else self.size // 2

    @property
    def cells(self) -> int:
        return self.ring * self.half

    def members(self, x: Column, y: Column) -> Endpoints:
        """The two things of cell ``(x, y)``, as positions in ``[0, size)``."""
        if self.size % 2:
            return x, F.pmod(x + y + 1, big(self.ring))
        return x, F.when(y == 0, big(self.size - 1)).otherwise(F.pmod(x + y, big(self.ring)))


class Grid(NamedTuple):
    """``rows * width`` allowed edges and the rule that turns a cell into one."""

    rows: int
    width: int
    edge: Callable[[Column, Column], Endpoints]

    @property
    def cells(self) -> int:
        return self.rows * self.width


def chain(spark: SparkSession, n: int) -> DataFrame:
    """Path ``0 - 1 - ... - n-1``."""
    return _slots(spark, n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def star(spark: SparkSession, n: int) -> DataFrame:
    """Node 0 joined to every other node."""
    return _slots(spark, n - 1).select(big(0).alias("src"), (F.col("id") + 1).alias("dst"))


def random_edges(spark: SparkSession, n: int, m: int, seed: int = 42) -> DataFrame:
    """``min(m, n(n-1)/2)`` distinct edges between ``n`` nodes."""
    pairs = Clique(n)
    grid = Grid(pairs.ring, pairs.half, pairs.members)
    return _draw(spark, [grid], min(m, grid.cells), seed)


def multi_component(spark: SparkSession, n: int, k: int, m: int, seed: int = 42) -> DataFrame:
    """``k`` blocks of consecutive ids with no edge between blocks.

    Block sizes differ by at most one.  ``m`` is split by block capacity and
    the remainder is dealt one edge per block, from the first block on.
    """
    k = max(1, min(k, n))
    size, larger = divmod(n, k)

    def node(block: Column, local: Column) -> Column:
        return block * size + F.least(block, big(larger)) + local

    return _block_edges(spark, n, k, m, seed, node)


def communities(
    spark: SparkSession, n: int, k: int, m_internal: int, m_external: int, seed: int = 42
) -> DataFrame:
    """``m_internal`` edges inside communities ``id % k`` and ``m_external`` between them."""
    size, larger = divmod(n, k)
    big_groups, small_groups = Clique(larger), Clique(k - larger)
    inside = larger * Clique(size + 1).cells + (k - larger) * Clique(size).cells
    between = Clique(n).cells - inside
    if m_internal > inside or m_external > between:
        raise ValueError(
            f"{n} nodes in {k} communities allow {inside} inside and {between} bridge edges, "
            f"not {m_internal} and {m_external}"
        )

    def node(community: Column, local: Column) -> Column:
        return community + local * k

    def bridges(groups: Clique, first: int, members: int) -> Grid:
        def edge(row: Column, col: Column) -> Endpoints:
            a, b = groups.members(int_div(row, big(members)), int_div(col, big(members)))
            return node(a + first, F.pmod(row, big(members))), node(b + first, F.pmod(col, big(members)))

        return Grid(groups.ring * members, groups.half * members, edge)

    def mixed(row: Column, col: Column) -> Endpoints:
        return (
            node(int_div(row, big(size + 1)), F.pmod(row, big(size + 1))),
            node(int_div(col, big(size)) + larger, F.pmod(col, big(size))),
        )

    grids = [
        bridges(big_groups, 0, size + 1),
        Grid(larger * (size + 1), (k - larger) * size, mixed),
        bridges(small_groups, larger, size),
    ]
    return _block_edges(spark, n, k, m_internal, seed, node).unionByName(_draw(spark, grids, m_external, seed))


def fixed_diameter(spark: SparkSession, n: int, m: int, d: int, seed: int = 42) -> DataFrame:
    """Connected graph of diameter ``d`` with at most ``m`` edges.

    Nodes ``0..d`` form a path, one per layer.  Every other node sits in one of
    the layers ``1..d-1``, tied to that layer's path node.  The remaining edges
    join nodes whose layers differ by at most one, so no shortcut appears.
    """
    if d >= n:
        raise ValueError(f"diameter {d} needs more than {n} nodes")
    if m < n - 1:
        raise ValueError(f"{m} edges cannot connect {n} nodes")
    if d == 1:
        return random_edges(spark, n, m, seed)

    layers = d - 1
    others = n - (d + 1)
    size, larger = divmod(others, layers)

    def layer(position: Column) -> Column:
        return F.pmod(position, big(layers)) + 1

    def other(layer_no: Column, local: Column) -> Column:
        return layer_no + local * layers + d

    path = _slots(spark, d).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    ties = _slots(spark, others).select(layer(F.col("id")).alias("src"), (F.col("id") + d + 1).alias("dst"))

    def within(first: int, count: int, members: int) -> Grid:
        pairs = Clique(members)

        def edge(row: Column, col: Column) -> Endpoints:
            layer_no = int_div(row, big(pairs.ring)) + first
            x, y = pairs.members(F.pmod(row, big(pairs.ring)), col)
            return other(layer_no, x), other(layer_no, y)

        return Grid(count * pairs.ring, pairs.half, edge)

    def neighbouring(first: int, count: int, members: int, next_members: int) -> Grid:
        def edge(row: Column, col: Column) -> Endpoints:
            layer_no = int_div(row, big(members)) + first
            return other(layer_no, F.pmod(row, big(members))), other(layer_no + 1, col)

        return Grid(max(count, 0) * members, next_members, edge)

    def next_path_node(row: Column, col: Column) -> Endpoints:
        return layer(row) + F.when(col == 0, big(-1)).otherwise(big(1)), row + d + 1

    grids = [
        Grid(others, 2, next_path_node),
        within(1, larger, size + 1),
        within(1 + larger, layers - larger, size),
        neighbouring(1, larger - 1, size + 1, size + 1),
        neighbouring(larger, 1 if 0 < larger < layers else 0, size + 1, size),
        neighbouring(larger + 1, layers - larger - 1, size, size),
    ]
    extra = min(m - (n - 1), sum(grid.cells for grid in grids))
    return path.unionByName(ties).unionByName(_draw(spark, grids, extra, seed))


def scale_free(spark: SparkSession, n: int, m0: int = 3, seed: int = 42) -> DataFrame:
    """A clique of ``m0`` nodes, then every later node joined to ``m0`` distinct earlier ones.

    Picking a random entry of the list of all edge endpoints so far is picking
    a node with probability proportional to its degree.  An entry that is
    itself a random pick is looked up the same way, further left, until it hits
    an entry whose node is known by position (Batagelj and Brandes 2005;
    Sanders and Schulz 2016).  Each pick depends on its position only, so all
    nodes are handled independently.
    """
    pairs = Clique(min(n, m0))
    clique = _slots(spark, pairs.cells)
    x, y = pairs.members(int_div(F.col("id"), big(max(pairs.half, 1))), F.pmod(F.col("id"), big(max(pairs.half, 1))))
    clique = clique.select(*_ordered(x, y))
    if n <= m0:
        return clique

    known = max(1, m0 * (m0 - 1))  # endpoint entries of the clique, m0 - 1 per clique node

    def pick(node: Column, attempt: Column) -> Column:
        return hash_below((node - m0) * (2 * m0) + known, F.lit(seed), node, attempt)

    def is_pick(entry: Column) -> Column:
        """Entries come in (picked node, new node) pairs after the clique's."""
        return (entry >= known) & (F.pmod(entry - known, big(2)) == 0)

    def follow(entry: Column, _: Column) -> Column:
        place = entry - known
        owner = int_div(place, big(2 * m0)) + m0
        return F.when(is_pick(entry), pick(owner, int_div(F.pmod(place, big(2 * m0)), big(2)))).otherwise(entry)

    def node_at(entry: Column) -> Column:
        in_clique = int_div(entry, big(max(1, m0 - 1)))
        return F.when(entry < known, in_clique).otherwise(int_div(entry - known, big(2 * m0)) + m0)

    def target(node: Column, attempt: Column) -> Column:
        short, long = (F.sequence(F.lit(1), F.lit(steps)) for steps in CHASE_STEPS)
        return node_at(
            F.aggregate(
                short,
                pick(node, attempt),
                follow,
                lambda entry: F.when(is_pick(entry), F.aggregate(long, entry, follow)).otherwise(entry),
            )
        )

    # Repeated targets are replaced by further picks; the clique nodes close the
    # list, so that m0 distinct targets always exist.
    node = F.col("id") + m0
    attempts = F.sequence(big(0), big(m0 - 1))
    spare = F.sequence(big(m0), big(3 * m0 - 1))
    first = F.transform(attempts, lambda a: target(F.col("node"), a))
    more = F.concat(
        F.col("targets"), F.transform(spare, lambda a: target(F.col("node"), a)), F.sequence(big(0), big(m0 - 1))
    )
    grown = (
        _slots(spark, n - m0)
        .select(node.alias("node"))
        .withColumn("targets", F.array_distinct(first))
        .withColumn(
            "targets",
            F.when(F.size("targets") == m0, F.col("targets")).otherwise(F.slice(F.array_distinct(more), 1, m0)),
        )
        .select(F.explode("targets").alias("src"), F.col("node").alias("dst"))
    )
    return clique.unionByName(grown)


def _slots(spark: SparkSession, count: int) -> DataFrame:
    count = max(count, 0)
    partitions = max(spark.sparkContext.defaultParallelism, -(-count // SLOTS_PER_PARTITION))
    return spark.range(0, count, 1, partitions)


def _ordered(u: Column, v: Column) -> Endpoints:
    return F.least(u, v).alias("src"), F.greatest(u, v).alias("dst")


def _union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "src bigint, dst bigint")


def _draw(spark: SparkSession, grids: list[Grid], m: int, seed: int) -> DataFrame:
    """``m`` distinct edges, shared out over the grids by their number of cells."""
    parts = []
    for tag, (grid, quota) in enumerate(zip(grids, _shares(m, [grid.cells for grid in grids]))):
        if quota:
            cells = with_permuted_cell(
                _slots(spark, quota), F.col("id"), grid.rows, grid.width, F.lit(seed), F.lit(tag)
            )
            parts.append(cells.select(*_ordered(*grid.edge(F.col("row"), F.col("col")))))
    return _union(spark, parts)


def _shares(m: int, capacities: list[int]) -> list[int]:
    total = sum(capacities)
    shares = [m * capacity // total if total else 0 for capacity in capacities]
    for i, capacity in enumerate(capacities):
        shares[i] += min(capacity - shares[i], m - sum(shares))
    return shares


def _block_edges(
    spark: SparkSession, n: int, k: int, m: int, seed: int, node: Callable[[Column, Column], Column]
) -> DataFrame:
    """Distinct edges inside ``k`` blocks; ``node`` numbers the members of a block.

    Equal blocks get equal quotas but for the dealt remainder, so at most three
    runs of blocks share size and quota, and a slot finds its block by division.
    """
    size, larger = divmod(n, k)
    big_cells, small_cells = Clique(size + 1).cells, Clique(size).cells
    total = larger * big_cells + (k - larger) * small_cells
    m = max(0, min(m, total))
    if m == 0:
        return _union(spark, [])
    big_quota, small_quota = m * big_cells // total, m * small_cells // total
    left_over = m - larger * big_quota - (k - larger) * small_quota

    parts = []
    bounds = sorted({0, larger, left_over, k})
    for first, last in zip(bounds, bounds[1:]):
        pairs = Clique(size + 1 if first < larger else size)
        quota = (big_quota if first < larger else small_quota) + (1 if first < left_over else 0)
        if quota == 0:
            continue
        slots = _slots(spark, (last - first) * quota).select(
            (int_div(F.col("id"), big(quota)) + first).alias("block"), F.pmod("id", big(quota)).alias("slot")
        )
        cells = with_permuted_cell(slots, F.col("slot"), pairs.ring, pairs.half, F.lit(seed), F.col("block"))
        x, y = pairs.members(F.col("row"), F.col("col"))
        parts.append(cells.select(*_ordered(node(F.col("block"), x), node(F.col("block"), y))))
    return _union(spark, parts)
