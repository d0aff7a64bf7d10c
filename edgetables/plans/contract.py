"""A contracting step: the default way to find components.

Let the *parent* of a node be its smallest neighbour below it; a node without
one is a root.  Pairs are kept as ``(higher, lower)``.  One step rewrites every
pair once:

* a pair that is its upper end's parent link moves up to the parent's parent;
* any other pair becomes a pair of the two ends' parents (a root standing for
  itself) and disappears where both are the same.

Every node stays connected to its old parent, by induction on the id: the
parent, being smaller, is still connected to the grandparent the node now points
at.  So nothing falls apart, labels can only fall to the smallest id of a
component, and, as each pair yields at most one, the table never grows.  Once
all pairs point at roots nothing changes any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from edgetables.functions.ids import big
from edgetables.plans.hot_groups import SPREAD, hot_limit, join_hot

MAX_BROADCAST_ROWS = 500_000  # two longs per row: 8 MB


def step_contract(pairs: DataFrame, n_pairs: int | None = None, max_group_rows: int | None = None) -> DataFrame:
    """Flagged rows ``(src, dst, is_new)`` of one step over pairs with ``src > dst``.

    ``pairs`` may hold copies: within the row limit they are dropped where the
    sorted rows of a node pass by anyway, beyond it before anything else, with
    copies combined ahead of the shuffle.
    """
    n_pairs = pairs.count() if n_pairs is None else n_pairs
    limit = hot_limit(n_pairs, max_group_rows)
    if n_pairs > limit:
        return _rewrite(_linked_around_hot_nodes(pairs, n_pairs, limit))

    in_order = Window.partitionBy("src").orderBy("dst")
    linked = pairs.select(
        "src", "dst", F.first("dst").over(in_order).alias("parent"), F.lag("dst").over(in_order).alias("before")
    ).filter("before is null or before < dst")
    above = _parents(pairs).select(F.col("src").alias("dst"), F.col("parent").alias("above"))
    above = F.broadcast(above) if n_pairs <= MAX_BROADCAST_ROWS else above.hint("shuffle_hash")
    return _rewrite(linked.join(above, "dst", "left"))


def _parents(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("src").agg(F.min("dst").alias("parent"), F.count(F.lit(1)).alias("size"))


def _linked_around_hot_nodes(pairs: DataFrame, n_pairs: int, limit: int) -> DataFrame:
    """Pairs with the parents of both ends, rows of hot nodes spread over many tasks.

    Hot nodes, as upper or as lower end, get their parents from a small table.
    Their rows go through the window in salted parts, and through the join under
    salts that match nothing.
    """
    above = _parents(pairs)
    upper = above.filter(F.col("size") > limit).select(
        "src", F.col("parent").alias("hot_parent"), F.ceil(F.col("size") / limit).cast("bigint").alias("parts")
    )
    lower = (
        pairs.groupBy("dst")
        .agg(F.count(F.lit(1)).alias("size"))
        .filter(F.col("size") > limit)
        .select("dst", F.lit(True).alias("hot"))
        .join(above.select(F.col("src").alias("dst"), F.col("parent").alias("hot_above")), "dst", "left")
    )
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("dst"), F.col("parts"))).otherwise(big(0))
    salt = F.when(F.col("hot"), 1 + F.pmod(F.xxhash64("src"), big(SPREAD))).otherwise(big(0))
    known = join_hot(join_hot(pairs.dropDuplicates(), upper, "src", n_pairs, limit), lower, "dst", n_pairs, limit)
    known = known.select("src", "dst", "hot_parent", "hot_above", part.alias("part"), salt.alias("salt"))
    lowest = F.min("dst").over(Window.partitionBy("src", "part"))
    linked = known.select("src", "dst", "hot_above", "salt", F.coalesce("hot_parent", lowest).alias("parent"))
    cold = above.select(F.col("src").alias("dst"), F.col("parent").alias("cold_above"), big(0).alias("salt"))
    return linked.join(cold, ["dst", "salt"], "left").select(
        "src", "dst", "parent", F.coalesce("hot_above", "cold_above").alias("above")
    )


def _rewrite(linked: DataFrame) -> DataFrame:
    """``above`` is the parent of ``dst``, null where ``dst`` is a root."""
    is_link = F.col("dst") == F.col("parent")
    settled = is_link & F.col("above").isNull()
    moved = linked.select(
        F.when(is_link, F.col("src")).otherwise(F.col("parent")).alias("one"),
        F.coalesce("above", "dst").alias("other"),
        F.when(settled, F.lit(0)).otherwise(F.lit(1)).alias("is_new"),
    )
    return moved.filter(F.col("one") != F.col("other")).select(
        F.greatest("one", "other").alias("src"), F.least("one", "other").alias("dst"), "is_new"
    )
