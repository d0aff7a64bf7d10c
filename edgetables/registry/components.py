"""Queries that run the loop to its fixed point."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgetables.operators import pairs as P
from edgetables.plans.components import component_pairs, connected_components, find_components
from edgetables.plans.diameter import component_diameters
from edgetables.plans.fixed_point import fixed_point
from edgetables.plans.keys import number_edges, number_keys
from edgetables.plans.steps import step_join
from edgetables.registry.base import query, table
from edgetables.registry.graphs import (
    EDGE_SQL,
    GRAPHS,
    cust_orders,
    event_chain,
    order_part,
    same_doc,
    source_lang,
    text_docs,
)
from edgetables.sources.edge_lists import edges_from


def labels_sql(graph: str, tail: str = "SELECT node, comp AS component FROM cc") -> str:
    """Smallest reachable id per node, by a recursion that keeps one row per node."""
    return (
        f"WITH RECURSIVE e AS ({EDGE_SQL[graph]}), "
        "s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), "
        "cc(node, comp) USING KEY (node) AS ("
        "SELECT src, least(src, min(dst)) FROM s GROUP BY src UNION "
        "SELECT s.src, min(c.comp) FROM s JOIN cc c ON c.node = s.dst JOIN recurring.cc r ON r.node = s.src "
        f"WHERE c.comp < r.comp GROUP BY s.src) {tail}"
    )


RUNS = [
    ("contract", "cust_orders"),
    ("contract", "order_part"),
    ("contract", "part_supp"),
    ("contract", "event_chain"),
    ("contract", "same_doc"),
    ("window", "order_part"),
    ("window", "part_supp"),
    ("window", "event_chain"),
    ("window", "cust_orders"),
    ("join", "order_part"),
    ("join", "part_supp"),
    ("list", "order_part"),
    ("list", "same_doc"),
]
# Groups above so many rows count as hot, so that the plans of very large tables are checked too.
SPLIT_RUNS = [
    ("contract", "order_part", 20),
    ("window", "part_supp", 50),
    ("join", "part_supp", 50),
    ("list", "part_supp", 50),
]

for strategy, graph, limit in [(*run, None) for run in RUNS] + SPLIT_RUNS:
    query(f"cc_{strategy}_{graph}{'_split' if limit else ''}", labels_sql(graph))(
        lambda spark, sf_dir, strategy=strategy, graph=graph, limit=limit: connected_components(
            GRAPHS[graph](spark, sf_dir), strategy, max_group_rows=limit
        )
    )


@query("component_pairs", labels_sql("event_chain", "SELECT node AS src, comp AS dst FROM cc WHERE node <> comp"))
def _(spark, sf_dir):
    return component_pairs(event_chain(spark, sf_dir))


@query("fixed_point_join", labels_sql("same_doc", "SELECT node AS src, comp AS dst FROM cc WHERE node <> comp"))
def _(spark, sf_dir):
    return fixed_point(P.dedup_pairs(same_doc(spark, sf_dir)), step_join).pairs


# Keys that are no whole numbers; the split form takes the plans of very large tables.
for suffix, limit in (("", None), ("_split", 20)):

    @query(f"cc_keys_text_docs{suffix}", labels_sql("text_docs"))
    def _(spark, sf_dir, limit=limit):
        return connected_components(text_docs(spark, sf_dir), max_group_rows=limit)


@query(
    "cc_keys_source_lang",
    labels_sql(
        "source_lang",
        "SELECT CAST(node[1] AS INTEGER) AS side, node[2:] AS key, CAST(comp[1] AS INTEGER) AS component_side, "
        "comp[2:] AS component_key FROM cc",
    ),
)
def _(spark, sf_dir):
    labels = connected_components(source_lang(spark, sf_dir))
    return labels.select(
        "node.side", "node.key", F.col("component.side").alias("component_side"), F.col("component.key").alias("component_key")
    )


@query("pairs_keys_text_docs", labels_sql("text_docs", "SELECT node AS src, comp AS dst FROM cc WHERE node <> comp"))
def _(spark, sf_dir):
    return component_pairs(text_docs(spark, sf_dir))


@query(
    "number_keys",
    "SELECT c_name AS key, row_number() OVER (ORDER BY c_name) - 1 AS id FROM (SELECT DISTINCT c_name FROM customer WHERE c_name IS NOT NULL)",
)
def _(spark, sf_dir):
    return number_keys(table(spark, sf_dir, "customer"), "c_name")


@query(
    "number_edges",
    "WITH e AS (SELECT o_orderdate AS src, l_shipdate AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey), "
    "k AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS id FROM (SELECT src AS key FROM e UNION SELECT dst FROM e) "
    "WHERE key IS NOT NULL) SELECT a.id AS src, b.id AS dst FROM e LEFT JOIN k a ON a.key = src LEFT JOIN k b ON b.key = dst",
)
def _(spark, sf_dir):
    """Dates as keys: the day of each order with the days on which its lines left."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    dated = table(spark, sf_dir, "orders").join(lines, "o_orderkey")
    return number_edges(edges_from(dated, "o_orderdate", "l_shipdate")).edges


@query(
    "component_sizes",
    labels_sql("cust_orders", "SELECT comp AS component, count(*) AS n_nodes FROM cc GROUP BY comp"),
)
def _(spark, sf_dir):
    return P.component_sizes(connected_components(cust_orders(spark, sf_dir)))


@query(
    "graph_stats",
    labels_sql(
        "order_part",
        "SELECT (SELECT count(*) FROM e) AS n_edges, count(*) AS n_nodes, count(DISTINCT comp) AS n_components FROM cc",
    ),
)
def _(spark, sf_dir):
    edges = order_part(spark, sf_dir)
    return P.graph_stats(edges, find_components(edges).labels())


def diameters_sql(graph: str) -> str:
    """Component, nodes and diameter from the distances of all pairs of nodes, lonely nodes included."""
    return (
        f"WITH RECURSIVE e AS ({EDGE_SQL[graph]}), "
        "s AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), "
        "d(a, b, k) USING KEY (a, b) AS (SELECT src, src, 0 FROM (SELECT src FROM e UNION SELECT dst FROM e) UNION "
        "SELECT d.a, s.dst, min(d.k) + 1 FROM d JOIN s ON s.src = d.b LEFT JOIN recurring.d r ON r.a = d.a AND r.b = s.dst "
        "WHERE r.a IS NULL GROUP BY d.a, s.dst) "
        "SELECT component, count(*) AS n_nodes, CAST(max(far) AS BIGINT) AS diameter "
        "FROM (SELECT a, min(b) AS component, max(k) AS far FROM d GROUP BY a) GROUP BY component"
    )


for graph in ("cust_orders", "part_supp", "same_doc"):
    query(f"diameter_{graph}", diameters_sql(graph))(
        lambda spark, sf_dir, graph=graph: component_diameters(GRAPHS[graph](spark, sf_dir))
    )
