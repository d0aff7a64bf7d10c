"""Column arithmetic on 64-bit ids: stable hashing and keyed permutations.

Everything here is a plain column expression, so it runs inside generated
code, needs no shuffle, and gives the same value however the rows are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PERMUTATION_ROUNDS = 2  # two half-rounds each; four make a good shuffle (Luby and Rackoff 1988)


def big(value: int) -> Column:
    return F.lit(value).cast("bigint")


def int_div(a: Column, b: Column) -> Column:
    """Integer quotient that stays exact above 2**53."""
    return F.call_function("div", a, b)


def community_of(node: Column, k: int) -> Column:
    """Community of a node when ids are dealt round-robin to ``k`` communities."""
    return F.pmod(node, big(k))


def same_community(u: Column, v: Column, k: int) -> Column:
    return community_of(u, k) == community_of(v, k)


def hash_below(limit: Column, *parts: Column) -> Column:
    """Pseudo-random id in ``[0, limit)`` that depends only on ``parts``."""
    return F.pmod(F.xxhash64(*parts), limit)


def with_permuted_cell(slots: DataFrame, index: Column, rows: int, width: int, *key: Column) -> DataFrame:
    """Add ``row`` and ``col``: a keyed one-to-one image of ``index`` in a grid.

    ``index`` runs over ``[0, rows * width)``.  Each round adds a hash of one
    digit to the other, modulo that digit's own range.  Adding is invertible,
    so distinct indexes land in distinct cells for any grid: nothing is
    rejected and nothing needs deduplicating afterwards.
    """
    out = slots.withColumns({"row": int_div(index, big(width)), "col": F.pmod(index, big(width))})
    for turn in range(PERMUTATION_ROUNDS):
        out = out.withColumn(
            "row", F.pmod(F.col("row") + hash_below(big(rows), *key, F.lit(2 * turn), F.col("col")), big(rows))
        )
        out = out.withColumn(
            "col", F.pmod(F.col("col") + hash_below(big(width), *key, F.lit(2 * turn + 1), F.col("row")), big(width))
        )
    return out
