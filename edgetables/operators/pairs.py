"""Operators on pair tables ``(src, dst[, is_new])`` and component tables ``(node, component)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def dedup_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("src", "dst").dropDuplicates()


def dedup_flagged(rows: DataFrame) -> DataFrame:
    """Each pair once; flagged new if any of its copies is."""
    return rows.groupBy("src", "dst").agg(F.max("is_new").alias("is_new"))


def convergence_metrics(flagged: DataFrame) -> DataFrame:
    """One row ``(pair_count, new_pairs)``."""
    return flagged.agg(*metric_columns())


def metric_columns():
    return (
        F.count(F.lit(1)).alias("pair_count"),
        F.coalesce(F.sum(F.col("is_new").cast("bigint")), F.lit(0).cast("bigint")).alias("new_pairs"),
    )


def component_map(pairs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``(node, component)`` for every node of the star pairs, roots included.

    Each pair also votes for ``dst`` as its own component; a root gets no
    smaller vote.  ``more`` holds votes for nodes that may not occur in any pair.
    """
    node, root = F.col("src").alias("node"), F.col("dst").alias("component")
    votes = F.array(F.struct(node, root), F.struct(F.col("dst").alias("node"), root))
    votes = pairs.select(F.inline(votes))
    if more is not None:
        votes = votes.unionByName(more)
    return votes.groupBy("node").agg(F.min("component").alias("component"))


def attach_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Component of every node; a node without a label is its own component."""
    return nodes.join(labels, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))


def graph_stats(edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row ``(n_edges, n_nodes, n_components)``, counted rather than declared."""
    edge_rows = edges.select(F.lit(1).alias("e"), F.lit(0).alias("n"), F.lit(0).alias("c"))
    node_rows = components.select(
        F.lit(0).alias("e"), F.lit(1).alias("n"), (F.col("node") == F.col("component")).cast("int").alias("c")
    )
    return edge_rows.unionByName(node_rows).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
          for c, name in (("e", "n_edges"), ("n", "n_nodes"), ("c", "n_components"))]
    )
