"""Order within groups of any size, by one plan for every size.

Rows are range-partitioned on the group keys, all order columns and a hash of
the rest, so a group may span many partitions and ties are split too; only rows
that are equal in every column stay together.  The partitions are stored with
their number.  A group that crosses borders, and there are fewer such groups
than borders, gets what lies before each of its parts from a small table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from edgetables.functions.ids import big
from edgetables.plans.storage import TASK_ROWS, Workspace, task_count

PART, BEFORE, TOTAL, LEAST = "__part", "__before", "__total", "__least"


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", small: bool = False) -> DataFrame:
    """Join on ``keys`` with nulls equal to each other; the keys come from the left."""
    renamed = right.withColumnsRenamed({key: f"__right_{key}" for key in keys})
    same = [F.col(key).eqNullSafe(F.col(f"__right_{key}")) for key in keys]
    joined = left.join(F.broadcast(renamed) if small else renamed, same, how)
    return joined.drop(*[f"__right_{key}" for key in keys])


@dataclass
class OrderedGroups:
    """Rows with the part they lie in; windows over ``part_keys`` see one part of one group."""

    rows: DataFrame
    part_keys: list[str]
    before: Column  # weight of the group's earlier parts
    total: Column  # weight of a group in several parts, else null
    least: Column  # smallest value of the first order column of a group in several parts, else null


def ordered_groups(
    rows: DataFrame, keys: list[str], order: list[str], weight: str | None = None, partitions: int | None = None
) -> OrderedGroups:
    """Lay out ``rows`` by ``keys`` and ``order`` (ascending, nulls first).

    ``weight`` says for how many rows each one stands; ``partitions`` is the
    least number of ranges.  There are as many as keep a range near ``TASK_ROWS`` rows.
    """
    n_rows = rows.count()
    if n_rows > TASK_ROWS:
        partitions = max(partitions or 1, task_count(n_rows))
    rest = [c for c in rows.columns if c not in keys and c not in order]
    by = [*keys, *order, *([F.xxhash64(*rest)] if rest else [])]
    ranges = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    workspace = Workspace(rows.sparkSession)
    stored, _ = workspace.write(ranges.withColumn(PART, F.spark_partition_id()), "ordered")
    parts = stored.groupBy(*keys, PART).agg(
        F.sum(F.col(weight) if weight else big(1)).alias("__weight"), F.min(order[0]).alias("__low")
    )
    crossing = (
        parts.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__parts"), F.sum("__weight").alias(TOTAL), F.min("__low").alias(LEAST))
        .filter("__parts > 1")
        .drop("__parts")
    )
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    facts = null_safe_join(parts, crossing, keys, "inner").withColumn(
        BEFORE, F.coalesce(F.sum("__weight").over(earlier), big(0))
    )
    # Fewer than two rows per partition border.
    # A range stays a task's share; by a hash of its number several would meet in one.
    apart = stored.repartitionById(partitions, PART) if n_rows > TASK_ROWS else stored
    placed = null_safe_join(apart, facts.drop("__weight", "__low"), [*keys, PART], "left", small=True)
    return OrderedGroups(placed, [*keys, PART], F.coalesce(BEFORE, big(0)), F.col(TOTAL), F.col(LEAST))
