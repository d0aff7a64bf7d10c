"""Edge-table operators: orientation, clean-up, id shifts, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def symmetrize(pairs: DataFrame) -> DataFrame:
    """Each pair in both orientations, from a single pass over the input."""
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pairs.select(F.inline(both))


def normalize_edges(edges: DataFrame) -> DataFrame:
    """Canonical edge set: ``src < dst``, each edge once, no self-loops, no nulls.

    Nodes that only have self-loops or null partners are not in it; take the
    node set from the raw edges with :func:`nodes` where they matter.
    """
    return (
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .dropDuplicates()
    )


def nodes(edges: DataFrame) -> DataFrame:
    """Every id that occurs as an endpoint, once."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).filter(F.col("node").isNotNull()).distinct()


def shift_ids(edges: DataFrame, offset: int | Column) -> DataFrame:
    """Move both endpoints by ``offset``, to keep id ranges of blocks apart."""
    offset = offset if isinstance(offset, Column) else F.lit(offset).cast("bigint")
    return edges.select((F.col("src") + offset).alias("src"), (F.col("dst") + offset).alias("dst"))


def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges found in either table, each once."""
    return left.unionByName(right).distinct()
