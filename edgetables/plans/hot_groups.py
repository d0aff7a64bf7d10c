"""Splitting groups that are too large for one task.

Grouping rows by a key sends all rows of that key to one task.  The helpers
below leave ordinary groups alone and split *hot* ones, those above a row limit,
into parts near the limit.  The whole-group facts a part cannot see on its own,
its minimum and size, come from an aggregate that combines rows before they are
shuffled.

The limit is a number of rows and does not depend on the table.  A table of n
rows has fewer than n / limit hot groups, which travel in a broadcast table of up
to ``MAX_HOT_KEYS`` rows; if there may be more, only groups above
n / ``MAX_HOT_KEYS`` rows count as hot.  A table within the limit cannot
hold a hot group and is passed through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from edgetables.functions.ids import big

MAX_GROUP_ROWS = 8_000_000  # two longs per row: 128 MB, one ordinary partition
MAX_HOT_KEYS = 200_000  # three longs each: 5 MB
SPREAD = 65_536  # salts for rows that must not meet


@dataclass
class SplitGroups:
    """Rows plus the columns that tell the parts of hot groups apart."""

    rows: DataFrame
    extra_keys: list[str] = field(default_factory=list)
    part: Column = field(default_factory=lambda: F.lit(0))
    hot_min: Column = field(default_factory=lambda: F.lit(None).cast("bigint"))


def hot_limit(n_rows: int, max_group_rows: int | None = None) -> int:
    """The row limit of a group in a table of ``n_rows``: raised where more than ``MAX_HOT_KEYS`` groups could exceed it."""
    return max(max_group_rows or MAX_GROUP_ROWS, n_rows // max(MAX_HOT_KEYS, 1))


def join_hot(rows: DataFrame, hot: DataFrame, key: str, n_rows: int, limit: int) -> DataFrame:
    """Left join with a table of hot groups, broadcast if their number allows it."""
    return rows.join(F.broadcast(hot) if n_rows // limit <= MAX_HOT_KEYS else hot, key, "left")


def join_facts(
    rows: DataFrame, facts: DataFrame, key: str, n_rows: int, max_group_rows: int | None = None
) -> DataFrame:
    """Left join with a table that has one row per key, whatever share of ``rows`` one key owns.

    The facts of hot keys are looked up once per key and travel to their rows;
    those rows, and rows without a key, pass the join under salts that match
    nothing.  ``n_rows`` is an upper bound for ``rows``.
    """
    limit = max_group_rows or MAX_GROUP_ROWS
    if n_rows <= limit:
        return rows.join(facts, key, "left")
    values = [c for c in facts.columns if c != key]
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__size")).filter((F.col("__size") > limit) & F.col(key).isNotNull())
    hot = sizes.join(facts, key, "left").select(
        key, F.lit(True).alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in values]
    )
    marked = join_hot(rows, hot, key, n_rows, limit)
    apart = F.coalesce("__hot", F.col(key).isNull())
    salt = F.when(apart, 1 + F.pmod(F.xxhash64(*rows.columns), big(SPREAD))).otherwise(big(0))
    met = marked.withColumn("__salt", salt).join(facts.withColumn("__salt", big(0)), [key, "__salt"], "left")
    return met.select(*rows.columns, *[F.coalesce(f"__hot_{c}", c).alias(c) for c in values])


def salted_groups(
    pairs: DataFrame, n_rows: int | None = None, max_group_rows: int | None = None, drop_roots: bool = False
) -> SplitGroups:
    """Split hot ``src`` groups by a hash of ``dst``.

    ``n_rows`` is an upper bound for the rows of ``pairs``, counted when not
    given.  Copies of one pair share a part, so deduplicate pairs that may
    repeat without bound.  ``drop_roots`` discards, before any shuffle, the rows
    of hot groups whose minimum is not below the node: they never propagate.
    """
    if n_rows is None:
        n_rows = pairs.count()
    limit = hot_limit(n_rows, max_group_rows)
    if n_rows <= limit:
        return SplitGroups(pairs)

    rows = join_hot(pairs, hot_groups(pairs, limit), "src", n_rows, limit)
    if drop_roots:
        rows = rows.filter(F.col("hot_min").isNull() | (F.col("hot_min") < F.col("src")))
    salt = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("salts")), big(0))
    return SplitGroups(
        rows.select("src", "dst", "hot_min", salt.alias("salt")), ["salt"], F.col("salt"), F.col("hot_min")
    )


def hot_groups(pairs: DataFrame, limit: int) -> DataFrame:
    """``(src, hot_min, salts)`` of the groups with more than ``limit`` rows."""
    return (
        pairs.groupBy("src")
        .agg(F.count(F.lit(1)).alias("size"), F.min("dst").alias("hot_min"))
        .filter(F.col("size") > limit)
        .select("src", "hot_min", F.ceil(F.col("size") / limit).cast("bigint").alias("salts"))
    )
