"""One propagation step, in three interchangeable forms.

A step reads pairs ``(src, dst)`` as undirected edges, finds the smallest
neighbour ``m`` of every node, and for each node with ``m < node`` emits

* the self row ``(node, m, 0)`` and
* ``(neighbour, m, 1)`` for every other neighbour.

The three forms differ in how a row learns its group's minimum: from the
group's neighbour list, from a join with the aggregated minima, or from a
window.  All take the pairs and an upper bound of their number; the bound
decides whether large groups have to be looked for.

A step to all neighbours yields up to two rows per pair.  ``to`` splits it into
two steps of one row per pair each, for loops that take them in turn, so that
the table never grows (large-star and small-star, Kiveris et al. 2014):

* ``"larger"``: every node hands the smallest of itself and its neighbours to
  its larger neighbours;
* ``"smaller"``: every node links itself and its smaller neighbours to the
  smallest of these.  Pairs are ``src > dst``, as both steps yield them.

Neither breaks a component, as a node that hands something on stays linked to
its smallest neighbour or to what it was linked to.  Where neither changes a
pair, no node has both larger and smaller neighbours and none has two smaller
ones: the pairs are stars around the smallest ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, functions as F

from edgetables.operators.edges import symmetrize
from edgetables.operators.groups import min_neighbour, neighbour_list, propagating, with_group_min
from edgetables.plans.hot_groups import salted_groups

MAX_LIST_ROWS = 1_000_000  # a neighbour list is one array value: keep it near 8 MB
MAX_BROADCAST_ROWS = 500_000  # two longs per row: 8 MB


def step_list(
    pairs: DataFrame, n_pairs: int | None = None, max_group_rows: int | None = None, to: str = "all"
) -> DataFrame:
    """Gather each group into neighbour lists, then explode the propagating ones."""
    lists = neighbour_list(*_groups(pairs, n_pairs, to), max_group_rows or MAX_LIST_ROWS, drop_roots=to != "larger")
    lists = lists if to == "larger" else propagating(lists)
    return emit(lists.select("src", F.explode("values").alias("dst"), "min_dst"), to)


def step_join(
    pairs: DataFrame,
    n_pairs: int | None = None,
    max_group_rows: int | None = None,
    join: str = "auto",
    to: str = "all",
) -> DataFrame:
    """Aggregate the minimum per node and join it back to the pairs.

    ``join="broadcast"`` ships the minima to every task when the bound on their
    number allows it and otherwise joins by shuffle, as ``"merge"`` always
    does; ``"auto"`` leaves the choice to Spark.  Rows of hot groups carry their
    minimum already and skip the join.
    """
    both, n_rows = _groups(pairs, n_pairs, to)
    minima = min_neighbour(both)
    minima = minima if to == "larger" else propagating(minima)
    if join == "broadcast" and n_rows <= MAX_BROADCAST_ROWS:
        minima = F.broadcast(minima)
    elif join != "auto":
        minima = minima.hint("merge")

    salted = salted_groups(both, n_rows, max_group_rows, drop_roots=to != "larger")
    if not salted.extra_keys:
        return emit(both.join(minima, "src"), to)
    hot = salted.rows.filter(F.col("hot_min").isNotNull()).select("src", "dst", F.col("hot_min").alias("min_dst"))
    rest = salted.rows.filter(F.col("hot_min").isNull()).select("src", "dst")
    return emit(rest.join(minima, "src").unionByName(hot), to)


def step_window(
    pairs: DataFrame, n_pairs: int | None = None, max_group_rows: int | None = None, to: str = "all"
) -> DataFrame:
    """Attach the group minimum by a window: one shuffle, then the rows of a node meet."""
    rows = with_group_min(*_groups(pairs, n_pairs, to), max_group_rows, drop_roots=to != "larger")
    return emit(rows if to == "larger" else propagating(rows), to)


def in_turn(step: Callable[..., DataFrame]) -> tuple[Callable[..., DataFrame], ...]:
    """The two steps of ``step`` that a loop over pairs ``src > dst`` takes in turn.

    The step to smaller neighbours comes first.  It reads each pair once, and what
    it links the step to larger ones turns into copies, which the loop drops.

    They settle (:func:`~edgetables.plans.fixed_point.fixed_point`): where the
    step to smaller neighbours finds nothing, every node has one smaller neighbour
    at most, so each ``src`` is in one pair.  The step to larger ones rewrites each
    pair ``(src, dst)`` to ``src`` and what ``dst`` hands it, so that stays true.
    """
    return partial(step, to="smaller"), partial(step, to="larger")


def emit(rows: DataFrame, to: str = "all") -> DataFrame:
    """Self and neighbour rows from ``(src, dst, min_dst)``, one output per input row.

    The row whose neighbour is the minimum itself stands for the self row.
    """
    if to == "larger":
        least = F.least("src", "min_dst")
        changed = F.when(least < F.col("src"), F.lit(1)).otherwise(F.lit(0))
        return rows.filter("dst > src").select(F.col("dst").alias("src"), least.alias("dst"), changed.alias("is_new"))
    is_self = F.col("dst") == F.col("min_dst")
    return rows.select(
        F.when(is_self, F.col("src")).otherwise(F.col("dst")).alias("src"),
        F.col("min_dst").alias("dst"),
        F.when(is_self, F.lit(0)).otherwise(F.lit(1)).alias("is_new"),
    )


def _groups(pairs: DataFrame, n_pairs: int | None, to: str) -> tuple[DataFrame, int]:
    """Pairs by the node that hands on, and a bound on their number."""
    n_pairs = pairs.count() if n_pairs is None else n_pairs
    return (pairs, n_pairs) if to == "smaller" else (symmetrize(pairs), 2 * n_pairs)
