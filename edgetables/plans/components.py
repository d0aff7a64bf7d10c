"""Connected components of an undirected edge table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from edgetables.operators.pairs import component_map
from edgetables.plans.contract import step_contract
from edgetables.plans.fixed_point import MAX_ITERATIONS, FixedPoint, fixed_point
from edgetables.plans.keys import KeyedEdges, number_edges
from edgetables.plans.steps import in_turn, step_join, step_list, step_window
from edgetables.plans.storage import Workspace


class Strategy(NamedTuple):
    steps: tuple[Callable[..., DataFrame], ...]  # taken in turn
    in_turn: bool  # whether the loop has to drop copies for them until they settle


STRATEGIES = {
    "contract": Strategy((step_contract,), False),
    "window": Strategy(in_turn(step_window), True),
    "join": Strategy(in_turn(step_join), True),
    "list": Strategy(in_turn(step_list), True),
}
ID_TYPES = ("tinyint", "smallint", "int", "bigint")


@dataclass
class Components(FixedPoint):
    """A finished loop plus the nodes that no pair mentions."""

    lonely: DataFrame | None = None
    keyed: KeyedEdges | None = None  # for ids that are no whole numbers: ``pairs`` holds their numbers
    n_rows: int = 0  # pairs and lonely rows, at most
    found: DataFrame | None = None

    def labels(self) -> DataFrame:
        """``(node, component)`` for every node of the input, component = smallest id."""
        if self.found is None:  # stored, as a table of this run, by tasks whose size does not depend on the caller's settings
            found = component_map(self.pairs, self.lonely)
            self.found, _ = self.workspace.write(found, "labels", n_rows=self.n_rows)
        found = self.found
        return self.keyed.decoded(found) if self.keyed else found

    def star_pairs(self) -> DataFrame:
        """``(src, dst)``: every node but the roots with its root."""
        return self.keyed.decoded(self.pairs) if self.keyed else self.pairs


def find_components(
    edges: DataFrame,
    strategy: str = "contract",
    max_iterations: int = MAX_ITERATIONS,
    on_limit: str = "raise",
    max_group_rows: int | None = None,
    **step_options,
) -> Components:
    """Run the loop on ``edges (src, dst)`` and return its pairs, counters and labels.

    The edges are read once and stored canonical, which fixes their number.
    Self-loops and edges with one null end only tell that a node
    exists; they are kept aside and join the labels at the end.

    Ids are whole numbers, or anything else that Spark can order (text, dates,
    decimals, binary, structs), both ends of one type.  Other ids than whole
    numbers are numbered in their order first and decoded in the labels.
    """
    kinds = {end: dict(edges.dtypes).get(end) for end in ("src", "dst")}
    steps, halves = STRATEGIES[strategy]
    workspace = Workspace(edges.sparkSession)
    keyed = None
    if any(kind not in ID_TYPES for kind in kinds.values()):
        if kinds["src"] != kinds["dst"]:
            raise TypeError(f"both ends must have one type, not {kinds}")
        try:
            keyed = number_edges(edges, workspace, max_group_rows)
        except BaseException:
            workspace.close()
            raise
        edges = keyed.edges
    low, high = F.least("src", "dst"), F.greatest("src", "dst")  # a null end yields the other one twice
    canonical = edges.select(high.cast("bigint").alias("src"), low.cast("bigint").alias("dst"))
    is_pair, is_lonely = F.col("src") != F.col("dst"), F.col("src") == F.col("dst")  # neither holds for two nulls
    try:
        stored, seen = workspace.write(
            canonical,
            "edges",
            F.count_if(is_pair).alias("pairs"),
            F.count_if(is_lonely).alias("lonely"),
        )
    except BaseException:
        workspace.close()
        raise
    run = fixed_point(
        stored.filter(is_pair),
        tuple(partial(_one_step, step, max_group_rows, step_options) for step in steps),
        seen["pairs"],
        max_iterations,
        on_limit,
        halves,
        workspace,
        halves,
    )
    lonely = None
    if seen["lonely"]:
        lonely = stored.filter(is_lonely).select(F.col("src").alias("node"), F.col("dst").alias("component"))
    else:
        workspace.drop("edges")
    if keyed:
        workspace.drop("keyed-edges")
    return Components(run.pairs, run.iterations, run.converged, run.metrics, workspace, lonely, keyed, seen["pairs"] + seen["lonely"])


def _one_step(step, max_group_rows: int | None, options: dict, pairs: DataFrame, n_pairs: int) -> DataFrame:
    return step(pairs, n_pairs, max_group_rows, **options)


def _finished(edges: DataFrame, strategy: str, options: dict) -> Components:
    if "on_limit" in options:
        raise TypeError("an unfinished result needs find_components, which marks it")
    return find_components(edges, strategy, **options)


def component_pairs(edges: DataFrame, strategy: str = "contract", **options) -> DataFrame:
    """Star pairs ``(src, dst)``: every node but the roots with its root."""
    return _finished(edges, strategy, options).star_pairs()


def connected_components(edges: DataFrame, strategy: str = "contract", **options) -> DataFrame:
    """``(node, component)`` for every node of ``edges``, roots and lonely nodes included."""
    return _finished(edges, strategy, options).labels()
