"""Operators on the neighbour groups of an edge or pair table.

A neighbour group is all rows with one ``src``.  A single node may own a third
of all rows, so no operator here relies on a whole group fitting one task:
minima are combined map-side; where rows of a group must meet, groups above a
row limit are split into salted parts (:mod:`edgetables.plans.hot_groups`), and
where their order counts they are split into ranges (:mod:`edgetables.plans.ordered`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from edgetables.plans.hot_groups import salted_groups
from edgetables.plans.ordered import null_safe_join, ordered_groups

def min_neighbour(pairs: DataFrame) -> DataFrame:
    """``(src, min_dst)``: smallest neighbour per node."""
    return pairs.groupBy("src").agg(F.min("dst").alias("min_dst"))


def propagating(groups: DataFrame) -> DataFrame:
    """Groups whose smallest neighbour is below the node itself."""
    return groups.filter(F.col("min_dst") < F.col("src"))


def neighbour_list(
    pairs: DataFrame, n_rows: int | None = None, max_group_rows: int | None = None, drop_roots: bool = False
) -> DataFrame:
    """``(src, part, values, min_dst)``: neighbours as arrays, with the group minimum.

    A group within the row limit is one array; a larger one comes as several
    arrays of about the limit each, all carrying the minimum of the whole group.
    """
    salted = salted_groups(pairs, n_rows, max_group_rows, drop_roots)
    # A list before the shuffle is no smaller than its rows: they are shuffled as they are and listed once.
    lists = salted.rows.repartition("src", *salted.extra_keys).groupBy("src", *salted.extra_keys).agg(
        F.collect_list("dst").alias("values"), F.first(salted.hot_min).alias("hot_min")
    )
    return lists.select(
        "src", salted.part.alias("part"), "values", F.coalesce("hot_min", F.array_min("values")).alias("min_dst")
    )


def with_group_min(
    pairs: DataFrame, n_rows: int | None = None, max_group_rows: int | None = None, drop_roots: bool = False
) -> DataFrame:
    """Every pair with the minimum of its group, by a window over the salted groups."""
    salted = salted_groups(pairs, n_rows, max_group_rows, drop_roots)
    window = Window.partitionBy("src", *salted.extra_keys)
    return salted.rows.select(
        "src", "dst", F.coalesce(salted.hot_min, F.min("dst").over(window)).alias("min_dst")
    )


def secondary_sort(pairs: DataFrame) -> DataFrame:
    """Pairs laid out in ``(src, dst)`` order, each partition a run of that order.

    Range partitioning on both columns lets a large group span partitions.
    """
    return pairs.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")


def rank_in_group(rows: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Add ``row_num``, the rank by ``order`` within ``keys``; null keys are a group, null values come first.

    Rows that tie in all order columns get consecutive ranks in no particular order.
    """
    groups = ordered_groups(rows, keys, order, partitions=partitions)
    row_num = F.row_number().over(Window.partitionBy(*groups.part_keys).orderBy(*order)) + groups.before
    return groups.rows.select(*rows.columns, row_num.alias("row_num"))


def secondary_sort_rank(pairs: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(src, dst, row_num, min_dst)``: rank by ``dst`` and first neighbour per node.

    Pairs are taken as a set.
    """
    groups = ordered_groups(pairs.select("src", "dst").distinct(), ["src"], ["dst"], partitions=partitions)
    by_dst = Window.partitionBy(*groups.part_keys).orderBy("dst")
    return groups.rows.select(
        "src",
        "dst",
        (F.row_number().over(by_dst) + groups.before).alias("row_num"),
        F.coalesce(groups.least, F.first("dst").over(by_dst)).alias("min_dst"),
    )


def next_in_group(
    rows: DataFrame, keys: list[str], order: list[str], item: str, partitions: int | None = None
) -> DataFrame:
    """``(src, dst)``: each item with the one that follows it in its group.

    Neighbouring ranks are joined, so that the rows of a large group spread.
    """
    ranked = rank_in_group(rows, keys, order, partitions)
    here = ranked.select(*keys, "row_num", F.col(item).alias("src"))
    after = ranked.select(*keys, (F.col("row_num") - 1).alias("row_num"), F.col(item).alias("dst"))
    return null_safe_join(here, after, [*keys, "row_num"], "inner").select("src", "dst")
