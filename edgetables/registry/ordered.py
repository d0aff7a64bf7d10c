"""Queries for order within groups: text, ties, null keys and groups without a value."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgetables.operators import groups as G, runs as R
from edgetables.registry.base import query, table
from edgetables.registry.runs import STATUS_SQL, line_runs, rounded, stats_sql

PARTS = 7  # ranges, so that groups cross their borders at every size


@query(
    "rank_text",
    "SELECT l_returnflag AS flag, CAST(l_orderkey AS VARCHAR) AS word, l_linenumber, row_number() OVER "
    "(PARTITION BY l_returnflag ORDER BY CAST(l_orderkey AS VARCHAR), l_linenumber) AS row_num FROM lineitem",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_orderkey").cast("string").alias("word"), "l_linenumber"
    )
    return G.rank_in_group(rows, ["flag"], ["word", "l_linenumber"], PARTS)


@query(
    "rank_ties",
    "SELECT l_linestatus, l_linenumber, l_orderkey, row_number() OVER "
    "(PARTITION BY l_linestatus ORDER BY l_linenumber, l_orderkey) AS row_num FROM lineitem",
)
def _(spark, sf_dir):
    """Seven line numbers order all rows; the order key splits their ties."""
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_linenumber", "l_orderkey")
    return G.rank_in_group(rows, ["l_linestatus"], ["l_linenumber", "l_orderkey"], PARTS)


@query(
    "rank_null_key",
    "SELECT nullif(o_orderstatus, 'F') AS status, o_orderkey, row_number() OVER "
    "(PARTITION BY nullif(o_orderstatus, 'F') ORDER BY o_orderkey) AS row_num FROM orders",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.expr("nullif(o_orderstatus, 'F')").alias("status"), "o_orderkey")
    return G.rank_in_group(rows, ["status"], ["o_orderkey"], PARTS)


@query(
    "next_null_key",
    "SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER "
    "(PARTITION BY nullif(o_orderstatus, 'F') ORDER BY o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.expr("nullif(o_orderstatus, 'F')").alias("status"), "o_orderkey")
    return G.next_in_group(rows, ["status"], ["o_orderkey"], "o_orderkey", PARTS)


@query(
    "median_all_null",
    "SELECT nullif(l_returnflag, 'R') AS flag, median(CASE WHEN l_returnflag <> 'A' THEN l_quantity END) AS median "
    "FROM lineitem GROUP BY nullif(l_returnflag, 'R')",
)
def _(spark, sf_dir):
    """A null key with values, and a key all of whose values are null."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.expr("nullif(l_returnflag, 'R')").alias("flag"),
        F.expr("CASE WHEN l_returnflag <> 'A' THEN l_quantity END").alias("value"),
    )
    return R.exact_median(rows, ["flag"], "value", PARTS)


NULL_KEYS = {"algo": "nullif(l_returnflag, 'R')", "graph": "nullif(CAST(l_partkey % 50 AS VARCHAR), '7')"}


@query(
    "run_stats_null_keys",
    stats_sql("stddev_samp").replace("l_returnflag AS algo", f"{NULL_KEYS['algo']} AS algo").replace(
        "CAST(l_partkey AS VARCHAR) AS graph", f"{NULL_KEYS['graph']} AS graph"
    ),
)
def _(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select(
        F.expr("nullif(l_returnflag, 'R')").alias("algo"),
        F.expr("nullif(CAST(l_partkey % 50 AS STRING), '7')").alias("graph"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("run"),
        F.col("l_quantity").alias("wall_s"),
        F.col("l_linenumber").alias("iterations"),
        F.expr(STATUS_SQL).alias("status"),
    )
    return rounded(R.run_stats(keys))


@query(
    "runs_table",
    f"WITH s AS ({stats_sql('stddev_samp')}), c AS (SELECT CAST(p_partkey AS VARCHAR) AS graph, 'part' AS graph_type, "
    "CAST(p_size AS BIGINT) AS n_nodes, CAST(p_partkey AS BIGINT) AS n_edges, CAST(1 AS BIGINT) AS n_components, "
    "CAST(-1 AS INTEGER) AS diameter FROM part) "
    "SELECT algo, graph_type, n_nodes, n_edges, n_components, diameter, median_time_s, mean_time_s, stdev_time_s, "
    "iterations, CAST(successful_runs AS INTEGER) AS successful_runs, CAST(timeout_runs AS INTEGER) AS timeout_runs, "
    "CAST(n_runs AS INTEGER) AS n_runs, timed_out, error FROM s LEFT JOIN c USING (graph)",
)
def _(spark, sf_dir):
    """Summaries of runs with a catalog in which each part is a graph."""
    catalog = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("graph"),
        F.lit("part").alias("graph_type"),
        F.col("p_size").alias("n_nodes"),
        F.col("p_partkey").alias("n_edges"),
        F.lit(1).alias("n_components"),
        F.lit(-1).alias("diameter"),
    )
    return R.runs_table(rounded(R.run_stats(line_runs(spark, sf_dir))), catalog)
