"""Whole-number ids for keys of any type that Spark can order.

The distinct keys are sorted into ranges; a key's number is its place in its range
plus the sizes of the ranges before.  Numbers are dense, start at 0 and have the
order of the keys, so the smallest id of a group is that of its smallest key.
Only one row per range, its size, is looked at outside the ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from edgetables.functions.ids import big
from edgetables.plans.hot_groups import join_facts
from edgetables.plans.storage import Workspace

LOCAL_BITS = 33  # of monotonically_increasing_id: the place within a partition; the partition is above


def number_keys(keys: DataFrame, key: str = "key", workspace: Workspace | None = None) -> DataFrame:
    """``(key, id)``: every key that is not null once, with its place in the order of all keys."""
    workspace = workspace or Workspace(keys.sparkSession)
    distinct = keys.select(F.col(key).alias("key")).filter("key is not null").distinct()
    in_order = distinct.repartitionByRange("key").sortWithinPartitions("key")
    placed, _ = workspace.write(in_order.withColumn("__place", F.monotonically_increasing_id()), "keys")
    part = F.shiftright("__place", LOCAL_BITS)
    local = F.col("__place").bitwiseAND(big(2**LOCAL_BITS - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), big(0)).alias("__start"))
    numbered = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return numbered.select("key", (F.col("__start") + local).alias("id"))


@dataclass
class KeyedEdges:
    """Edges by the numbers of their keys, and the numbers themselves."""

    edges: DataFrame  # (src, dst), null where the key is
    keys: DataFrame  # (key, id)
    n_edges: int
    max_group_rows: int | None

    def decoded(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the keys in place of all ids; a hot component's rows do not meet in one task."""
        out = rows
        for column in rows.columns:
            facts = self.keys.select(F.col("id").alias(column), F.col("key").alias("__key"))
            found = join_facts(out, facts, column, 2 * self.n_edges, self.max_group_rows)
            out = found.drop(column).withColumnRenamed("__key", column).select(*rows.columns)
        return out


def number_edges(edges: DataFrame, workspace: Workspace | None = None, max_group_rows: int | None = None) -> KeyedEdges:
    """Number the keys of both columns of ``edges (src, dst)``, which have one type, and put the numbers in."""
    workspace = workspace or Workspace(edges.sparkSession)
    stored, seen = workspace.write(edges.select("src", "dst"), "keyed-edges", F.count(F.lit(1)).alias("n"))
    ends = stored.select(F.explode(F.array("src", "dst")).alias("key"))
    keys, _ = workspace.write(number_keys(ends, workspace=workspace), "numbered-keys")
    workspace.drop("keys")
    out = stored
    for end in ("src", "dst"):
        facts = keys.select(F.col("key").alias(end), F.col("id").alias("__id"))
        found = join_facts(out, facts, end, seen["n"], max_group_rows)
        out = found.drop(end).withColumnRenamed("__id", end).select("src", "dst")
    return KeyedEdges(out, keys, seen["n"], max_group_rows)
