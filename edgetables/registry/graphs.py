"""Edge tables derived from the given tables, over all their rows, and the same in SQL.

The two sides of a bipartite graph have even and odd ids, so they cannot collide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from edgetables.operators.groups import next_in_group, with_group_min
from edgetables.registry.base import table
from edgetables.sources.edge_lists import edges_from


def cust_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small stars: each customer with its orders."""
    return edges_from(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", two_sided=True)


def order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their parts, repeated lines included: one sparse giant component."""
    return edges_from(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", two_sided=True)


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their suppliers, as often as they sold: one dense giant component."""
    return edges_from(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", two_sided=True)


def event_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the same user's next one: long chains."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return next_in_group(events, ["user_id"], ["ts", "event_id"], "event_id")


def same_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document with a text and each later one with exactly that text."""
    documents = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("src"), F.col("doc_id").alias("dst"))
    firsts = with_group_min(documents).filter(F.col("min_dst") != F.col("dst"))
    return edges_from(firsts, "min_dst", "dst")


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of text: the digest of each text with the name of its document."""
    name = F.concat(F.lit("doc-"), "doc_id")
    return edges_from(table(spark, sf_dir, "documents"), F.sha2("text", 256), name)


def source_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two sides: the source and the language of each document."""
    return edges_from(table(spark, sf_dir, "documents"), "source", "lang", two_sided=True)


GRAPHS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cust_orders": cust_orders,
    "order_part": order_part,
    "part_supp": part_supp,
    "event_chain": event_chain,
    "same_doc": same_doc,
}

EDGE_SQL = {
    "cust_orders": "SELECT 2 * CAST(o_custkey AS BIGINT) AS src, 2 * CAST(o_orderkey AS BIGINT) + 1 AS dst FROM orders",
    "order_part": "SELECT 2 * CAST(l_orderkey AS BIGINT) AS src, 2 * CAST(l_partkey AS BIGINT) + 1 AS dst FROM lineitem",
    "part_supp": "SELECT 2 * CAST(l_partkey AS BIGINT) AS src, 2 * CAST(l_suppkey AS BIGINT) + 1 AS dst FROM lineitem",
    "event_chain": (
        "SELECT src, dst FROM (SELECT event_id AS src, lead(event_id) OVER "
        "(PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL"
    ),
    "text_docs": (
        "SELECT coalesce(sha256(text), 'doc-' || doc_id) AS src, coalesce('doc-' || doc_id, sha256(text)) AS dst "
        "FROM documents WHERE text IS NOT NULL OR doc_id IS NOT NULL"
    ),
    "source_lang": (
        "SELECT coalesce('0' || source, '1' || lang) AS src, coalesce('1' || lang, '0' || source) AS dst "
        "FROM documents WHERE source IS NOT NULL OR lang IS NOT NULL"
    ),
    "same_doc": (
        "SELECT m AS src, doc_id AS dst FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS m "
        "FROM documents) WHERE m <> doc_id"
    ),
}
