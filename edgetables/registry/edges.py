"""Queries for edge, group, pair and step operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, functions as F

from edgetables.functions.ids import same_community
from edgetables.operators import edges as E, groups as G, pairs as P
from edgetables.plans.contract import step_contract
from edgetables.plans.storage import stored_rows
from edgetables.plans.steps import step_join, step_list, step_window
from edgetables.registry.base import query, table
from edgetables.registry.graphs import EDGE_SQL, cust_orders, event_chain, order_part, part_supp, same_doc
from edgetables.sources.edge_lists import edges_from

BLOCK = 2**56  # line numbers are below 2**7, ids below the block
COMMUNITIES = 7


def with_edges(graph: str, body: str) -> str:
    return f"WITH e AS ({EDGE_SQL[graph]}), {body}"


def both_ways(graph: str, body: str) -> str:
    return with_edges(graph, f"s AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) {body}")


for graph_name, graph in (
    ("cust_orders", cust_orders),
    ("order_part", order_part),
    ("part_supp", part_supp),
    ("event_chain", event_chain),
    ("same_doc", same_doc),
):
    query(f"edges_{graph_name}", EDGE_SQL[graph_name])(graph)


@query("symmetrize", both_ways("part_supp", "SELECT src, dst FROM s"))
def _(spark, sf_dir):
    return E.symmetrize(part_supp(spark, sf_dir))


@query(
    "normalize_edges",
    with_edges(
        "order_part",
        "s AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e UNION ALL SELECT src, src FROM e) "
        "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM s WHERE src <> dst",
    ),
)
def _(spark, sf_dir):
    edges = order_part(spark, sf_dir)
    loops = edges.select("src", F.col("src").alias("dst"))
    return E.normalize_edges(E.symmetrize(edges).unionByName(loops))


@query("edge_nodes", with_edges("cust_orders", "n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node FROM n"))
def _(spark, sf_dir):
    return E.nodes(cust_orders(spark, sf_dir))


@query(
    "shift_ids",
    f"SELECT l_orderkey + CAST(l_linenumber AS BIGINT) * {BLOCK} AS src, "
    f"l_partkey + CAST(l_linenumber AS BIGINT) * {BLOCK} AS dst FROM lineitem",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber")
    return E.shift_ids(edges, F.col("l_linenumber").cast("bigint") * BLOCK)


@query(
    "same_community",
    with_edges(
        "part_supp",
        f"c AS (SELECT src, dst, src % {COMMUNITIES} = dst % {COMMUNITIES} AS inside FROM e) "
        "SELECT inside, count(*) AS n_edges, count(DISTINCT src) AS n_src FROM c GROUP BY inside",
    ),
)
def _(spark, sf_dir):
    inside = same_community(F.col("src"), F.col("dst"), COMMUNITIES).alias("inside")
    return (
        part_supp(spark, sf_dir)
        .select("src", inside)
        .groupBy("inside")
        .agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("n_src"))
    )


@query("union_distinct", f"{EDGE_SQL['order_part']} UNION {EDGE_SQL['cust_orders']}")
def _(spark, sf_dir):
    return E.union_distinct(order_part(spark, sf_dir), cust_orders(spark, sf_dir))


@query("edges_from", "SELECT CAST(s_nationkey AS BIGINT) - 100 AS src, CAST(s_suppkey AS BIGINT) AS dst FROM supplier")
def _(spark, sf_dir):
    """Nation keys are below 100."""
    return edges_from(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", src_offset=-100)


@query("min_neighbour", both_ways("part_supp", "SELECT src, min(dst) AS min_dst FROM s GROUP BY src"))
def _(spark, sf_dir):
    return G.min_neighbour(E.symmetrize(part_supp(spark, sf_dir)))


@query(
    "propagating", both_ways("order_part", "SELECT src, min(dst) AS min_dst FROM s GROUP BY src HAVING min(dst) < src")
)
def _(spark, sf_dir):
    return G.propagating(G.min_neighbour(E.symmetrize(order_part(spark, sf_dir))))


@query("neighbour_list", both_ways("part_supp", "SELECT src, dst, min(dst) OVER (PARTITION BY src) AS min_dst FROM s"))
def _(spark, sf_dir):
    lists = G.neighbour_list(E.symmetrize(part_supp(spark, sf_dir)))
    return lists.select("src", F.explode("values").alias("dst"), "min_dst")


@query("group_min_window", both_ways("order_part", "SELECT src, dst, min(dst) OVER (PARTITION BY src) AS min_dst FROM s"))
def _(spark, sf_dir):
    return G.with_group_min(E.symmetrize(order_part(spark, sf_dir)))


@query(
    "secondary_sort_rank",
    both_ways(
        "order_part",
        ", d AS (SELECT DISTINCT src, dst FROM s) SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) "
        "AS row_num, first_value(dst) OVER (PARTITION BY src ORDER BY dst) AS min_dst FROM d",
    ),
)
def _(spark, sf_dir):
    return G.secondary_sort_rank(E.symmetrize(order_part(spark, sf_dir)))


@query("secondary_sort", both_ways("cust_orders", "SELECT src, dst FROM s"))
def _(spark, sf_dir):
    return G.secondary_sort(E.symmetrize(cust_orders(spark, sf_dir)))


@query("dedup_pairs", f"SELECT DISTINCT src, dst FROM ({EDGE_SQL['part_supp']})")
def _(spark, sf_dir):
    return P.dedup_pairs(part_supp(spark, sf_dir))


def step_sql(graph: str, tail: str) -> str:
    return both_ways(
        graph,
        ", p AS (SELECT src, min(dst) AS m FROM s GROUP BY src HAVING min(dst) < src), "
        "r AS (SELECT src, m AS dst, 0 AS n FROM p UNION ALL "
        "SELECT s.dst, p.m, 1 FROM s JOIN p ON p.src = s.src WHERE s.dst <> p.m) " + tail,
    )


STEP_TAIL = "SELECT src, dst, CAST(max(n) AS INTEGER) AS is_new FROM r GROUP BY src, dst"

def one_step(step: Callable[..., DataFrame], pairs: DataFrame) -> DataFrame:
    n_pairs = pairs.count()
    return stored_rows(P.dedup_flagged(step(pairs, n_pairs)), 2 * n_pairs)


for step_name, step, graph, graph_name in (
    ("step_list", step_list, part_supp, "part_supp"),
    ("step_join", step_join, part_supp, "part_supp"),
    ("step_join_broadcast", partial(step_join, join="broadcast"), order_part, "order_part"),
    ("step_join_merge", partial(step_join, join="merge"), order_part, "order_part"),
    ("step_window", step_window, order_part, "order_part"),
    ("step_window_chain", step_window, event_chain, "event_chain"),
):
    query(step_name, step_sql(graph_name, STEP_TAIL))(
        lambda spark, sf_dir, step=step, graph=graph: one_step(step, graph(spark, sf_dir))
    )


@query("step_rows_union", step_sql("event_chain", "SELECT src, dst, n AS is_new FROM r"))
def _(spark, sf_dir):
    return step_window(event_chain(spark, sf_dir))


CONTRACT_SQL = (
    with_edges(
        "order_part",
        "p AS (SELECT DISTINCT greatest(src, dst) AS src, least(src, dst) AS dst FROM e WHERE src <> dst), "
        "m AS (SELECT src, min(dst) AS parent FROM p GROUP BY src), "
        "l AS (SELECT p.src, p.dst, m.parent, a.parent AS above FROM p JOIN m ON m.src = p.src "
        "LEFT JOIN m a ON a.src = p.dst), "
        "r AS (SELECT CASE WHEN dst = parent THEN src ELSE parent END AS x, coalesce(above, dst) AS y, "
        "CASE WHEN dst = parent AND above IS NULL THEN 0 ELSE 1 END AS n FROM l) "
        "SELECT greatest(x, y) AS src, least(x, y) AS dst, CAST(max(n) AS INTEGER) AS is_new FROM r "
        "WHERE x <> y GROUP BY greatest(x, y), least(x, y)",
    )
)


# The split form takes the plan of very large tables: groups above a few rows count as hot.
for name, limit in (("step_contract", None), ("step_contract_split", 20)):

    @query(name, CONTRACT_SQL)
    def _(spark, sf_dir, limit=limit):
        pairs = E.normalize_edges(order_part(spark, sf_dir)).select(
            F.col("dst").alias("src"), F.col("src").alias("dst")
        )
        return P.dedup_flagged(step_contract(pairs, None, limit))


@query(
    "convergence_metrics",
    step_sql(
        "part_supp",
        ", d AS (SELECT src, dst, max(n) AS n FROM r GROUP BY src, dst) "
        "SELECT count(*) AS pair_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS new_pairs FROM d",
    ),
)
def _(spark, sf_dir):
    return P.convergence_metrics(one_step(step_window, part_supp(spark, sf_dir)))


@query(
    "component_map",
    with_edges(
        "cust_orders",
        "v AS (SELECT dst AS node, src AS component FROM e UNION ALL SELECT src, src FROM e) "
        "SELECT node, min(component) AS component FROM v GROUP BY node",
    ),
)
def _(spark, sf_dir):
    stars = cust_orders(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return P.component_map(stars)


@query(
    "attach_labels",
    "SELECT c_custkey AS node, coalesce(m.component, c_custkey) AS component FROM customer LEFT JOIN "
    "(SELECT o_custkey, -1 - min(o_orderkey) AS component FROM orders GROUP BY o_custkey) m "
    "ON m.o_custkey = c_custkey",
)
def _(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    firsts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    labels = firsts.select(F.col("o_custkey").alias("node"), (-1 - F.col("first")).alias("component"))
    return P.attach_labels(nodes, labels)
