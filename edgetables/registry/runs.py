"""Queries for run summaries; events and order lines stand in for benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from edgetables.functions.text import display_name
from edgetables.operators import runs as R
from edgetables.registry.base import query, table

ALGOS = ["A", "N", "R"]
STATUS_SQL = (
    "CASE WHEN l_returnflag = 'A' AND l_discount >= 0.05 THEN 'timeout' "
    "WHEN l_discount >= 0.09 THEN 'error' ELSE 'ok' END"
)


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line as one run: part by return flag, quantity as seconds."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("algo"),
        F.col("l_partkey").cast("string").alias("graph"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("run"),
        F.col("l_quantity").alias("wall_s"),
        F.col("l_linenumber").alias("iterations"),
        F.expr(STATUS_SQL).alias("status"),
    )


def stats_sql(spread: str) -> str:
    return (
        "WITH r AS (SELECT l_returnflag AS algo, CAST(l_partkey AS VARCHAR) AS graph, "
        f"l_orderkey * 8 + l_linenumber AS run, l_quantity AS wall_s, l_linenumber AS iterations, {STATUS_SQL} AS status "
        "FROM lineitem) SELECT algo, graph, "
        "coalesce(median(wall_s) FILTER (status = 'ok'), 0.0) AS median_time_s, "
        "coalesce(round(avg(wall_s) FILTER (status = 'ok'), 6), 0.0) AS mean_time_s, "
        f"coalesce(round({spread}(wall_s) FILTER (status = 'ok'), 6), 0.0) AS stdev_time_s, "
        "coalesce(arg_min(iterations, run) FILTER (status = 'ok'), -1) AS iterations, "
        "count(*) FILTER (status = 'ok') AS successful_runs, count(*) FILTER (status = 'timeout') AS timeout_runs, "
        "count(*) AS n_runs, CAST(bool_or(status = 'timeout') AS INTEGER) AS timed_out, "
        "CAST(bool_or(status = 'error') AS INTEGER) AS error FROM r GROUP BY algo, graph"
    )


def rounded(stats: DataFrame) -> DataFrame:
    return stats.withColumns({c: F.round(c, 6) for c in ("mean_time_s", "stdev_time_s")})


@query("run_stats", stats_sql("stddev_samp"))
def _(spark, sf_dir):
    return rounded(R.run_stats(line_runs(spark, sf_dir)))


@query("run_stats_population", stats_sql("stddev_pop"))
def _(spark, sf_dir):
    return rounded(R.run_stats(line_runs(spark, sf_dir), stdev="population"))


@query("exact_median", "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type")
def _(spark, sf_dir):
    medians = R.exact_median(table(spark, sf_dir, "events"), ["event_type"], "value")
    return medians.select("event_type", F.round("median", 6).alias("median"))


def graph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("graph_type"),
        F.col("l_suppkey").alias("n_nodes"),
        F.col("l_linenumber").alias("n_edges"),
        F.lit(1).alias("n_components"),
        F.col("l_returnflag").alias("algo"),
        F.col("l_quantity").alias("mean_time_s"),
    )


GRAPH_RUNS_SQL = (
    "SELECT l_linestatus AS graph_type, l_suppkey AS n_nodes, l_linenumber AS n_edges, 1 AS n_components, "
    "l_returnflag AS algo, l_quantity AS mean_time_s FROM lineitem"
)
PIVOT_SQL = (
    "SELECT graph_type, n_nodes, n_edges, n_components, "
    + ", ".join(f"coalesce(avg(mean_time_s) FILTER (algo = '{a}'), -1.0) AS \"{a}\"" for a in ALGOS)
    + f" FROM ({GRAPH_RUNS_SQL}) GROUP BY graph_type, n_nodes, n_edges, n_components"
)


@query("runs_pivot", PIVOT_SQL)
def _(spark, sf_dir):
    return R.runs_pivot(graph_runs(spark, sf_dir), ALGOS)


@query(
    "best_per_row",
    f"WITH p AS ({PIVOT_SQL}), c AS (SELECT graph_type, n_nodes, n_edges, n_components, algo, t FROM p UNPIVOT "
    '(t FOR algo IN ("A", "N", "R")) WHERE t > 0), '
    "b AS (SELECT graph_type, n_nodes, n_edges, n_components, min(t) AS best_time_s, "
    "arg_min(algo, (t, algo)) AS best_algo FROM c GROUP BY ALL) "
    'SELECT p.*, b.best_time_s, b.best_algo FROM p LEFT JOIN b USING (graph_type, n_nodes, n_edges, n_components)',
)
def _(spark, sf_dir):
    return R.best_per_row(R.runs_pivot(graph_runs(spark, sf_dir), ALGOS), ALGOS)


@query("order_runs", GRAPH_RUNS_SQL)
def _(spark, sf_dir):
    return R.order_runs(graph_runs(spark, sf_dir))


@query(
    "stack_runs",
    f"SELECT *, CAST(NULL AS INTEGER) AS iterations FROM ({GRAPH_RUNS_SQL}) UNION ALL "
    "SELECT o_orderpriority, o_custkey, 0, 1, o_orderstatus, o_totalprice, 1 FROM orders",
)
def _(spark, sf_dir):
    later = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("graph_type"),
        F.col("o_custkey").alias("n_nodes"),
        F.lit(0).alias("n_edges"),
        F.lit(1).alias("n_components"),
        F.col("o_orderstatus").alias("algo"),
        F.col("o_totalprice").alias("mean_time_s"),
        F.lit(1).alias("iterations"),
    )
    return R.stack_runs(graph_runs(spark, sf_dir), later)


@query("graph_types", "SELECT DISTINCT o_orderpriority AS graph_type FROM orders")
def _(spark, sf_dir):
    return R.graph_types(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("graph_type")))


@query(
    "display_name",
    "SELECT event_type, array_to_string(list_transform(string_split(replace(event_type, '_', ' '), ' '), "
    "lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title, count(*) AS n FROM events GROUP BY event_type",
)
def _(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("event_type", display_name(F.col("event_type")).alias("title"), "n")
