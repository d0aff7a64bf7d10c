"""Queries that write files derived from the given tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgetables.plans.hot_groups import join_facts
from edgetables.plans.keys import number_keys
from edgetables.plans.storage import Workspace
from edgetables.registry.base import query, row_count, table
from edgetables.registry.graphs import EDGE_SQL, cust_orders, order_part
from edgetables.sources.edge_lists import read_edge_list, read_graph_catalog, read_graph_meta, write_edge_list
from edgetables.sources.runs import read_runs, write_runs


@query("edge_list_roundtrip", EDGE_SQL["order_part"])
def _(spark, sf_dir):
    path = Workspace(spark).table("edges")
    write_edge_list(order_part(spark, sf_dir), path)
    return read_edge_list(spark, path)


@query("edge_list_gzip", EDGE_SQL["cust_orders"])
def _(spark, sf_dir):
    path = Workspace(spark).table("edges")
    write_edge_list(cust_orders(spark, sf_dir), path, compression="gzip")
    return read_edge_list(spark, f"{path}/*.gz")


@query("edge_list_gzip_folder", EDGE_SQL["order_part"])
def _(spark, sf_dir):
    path = Workspace(spark).table("edges")
    write_edge_list(order_part(spark, sf_dir), path, compression="gzip")
    return read_edge_list(spark, path)


@query(
    "edge_list_dropmalformed",
    "SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag IN ('A', 'R')",
)
def _(spark, sf_dir):
    """Lines flagged A come as edges with a third token, R with odd blanks, the rest as comments or junk."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", F.concat_ws(" ", "l_orderkey", "l_partkey", "l_suppkey"))
        .when(F.col("l_returnflag") == "R", F.concat(F.lit("  "), "l_orderkey", F.lit("\t "), "l_partkey", F.lit(" ")))
        .when(F.col("l_linestatus") == "F", F.concat(F.lit("# "), "l_orderkey", F.lit(" "), "l_partkey"))
        .when(F.col("l_linenumber") == 1, F.lit(" "))
        .otherwise(F.concat(F.lit("part "), "l_partkey"))
        .alias("value")
    )
    path = Workspace(spark).table("lines")
    lines.write.text(path)
    return read_edge_list(spark, path, mode="dropmalformed")


FILE_EDGES = 1_000_000
CATALOG_SQL = (
    "SELECT o_orderpriority AS graph_type, count(*) AS n_nodes, CAST(0 AS BIGINT) AS n_edges, "
    "CAST(-1 AS BIGINT) AS n_components, count(DISTINCT o_custkey) AS diameter FROM orders GROUP BY o_orderpriority"
)


def priority_files(spark, sf_dir) -> str:
    """Edges of customers and orders by order priority: files of about a million edges, each under its header lines."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey", "o_orderkey")
    counts = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("d"))
    numbered = number_keys(counts, "o_orderpriority").select(F.col("key").alias("o_orderpriority"), F.col("id").alias("graph"))
    graphs = counts.join(numbered, "o_orderpriority").withColumn("files", F.ceil(F.col("n") / FILE_EDGES).cast("bigint"))
    file = F.pmod(F.xxhash64("o_orderkey"), F.col("files"))
    edges = join_facts(orders, graphs.select("o_orderpriority", "graph", "files"), "o_orderpriority", row_count(spark, sf_dir, "orders"))
    edges = edges.select("graph", file.alias("file"), F.lit(1).alias("line"), F.concat_ws(" ", "o_custkey", "o_orderkey").alias("value"))
    header = F.array(
        F.concat(F.lit("# graph_type: "), "o_orderpriority"),
        F.concat(F.lit("# n_nodes: "), "n"),
        F.concat(F.lit("# note: "), "n"),
        F.concat(F.lit("# diameter: "), "d"),
    )
    heads = graphs.select("graph", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("files") - 1)).alias("file"), header.alias("header"))
    heads = heads.select("graph", "file", F.lit(0).alias("line"), F.explode("header").alias("value"))
    lines = heads.unionByName(edges).repartition("graph", "file").sortWithinPartitions("graph", "file", "line")
    path = Workspace(spark).table("graphs")
    lines.drop("line").write.partitionBy("graph", "file").text(path)
    return f"{path}/*/*/*.txt"


# Read from the tops of the files, and from all of their lines.
for name, headers in (("graph_catalog", "top"), ("graph_catalog_anywhere", "anywhere")):

    @query(name, CATALOG_SQL)
    def _(spark, sf_dir, headers=headers):
        """Edges and components stay undeclared; the files of a graph say the same of it."""
        return read_graph_catalog(spark, priority_files(spark, sf_dir), headers=headers).drop("path").distinct()


@query("catalog_edges", "SELECT o_custkey AS src, o_orderkey AS dst FROM orders")
def _(spark, sf_dir):
    """The edges below the headers of the same files."""
    return read_edge_list(spark, priority_files(spark, sf_dir))


@query(
    "graph_meta",
    "SELECT 'star' AS graph_type, count(DISTINCT o_custkey) + count(*) AS n_nodes, count(*) AS n_edges, "
    "count(DISTINCT o_custkey) AS n_components, CAST(-1 AS BIGINT) AS diameter FROM orders",
)
def _(spark, sf_dir):
    edges = cust_orders(spark, sf_dir)
    seen = edges.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("src").alias("stars")).first()
    path = Workspace(spark).table("edges")
    meta = {
        "graph_type": "star",
        "n_nodes": seen["stars"] + seen["rows"],
        "n_edges": seen["rows"],
        "n_components": seen["stars"],
    }
    write_edge_list(edges, path, meta)
    return read_graph_meta(spark, f"{path}.meta").drop("path")


ROUNDTRIP_SQL = (
    "SELECT l_returnflag AS algo, l_linestatus AS graph_type, l_partkey AS n_nodes, l_suppkey AS n_edges, "
    "CAST(l_linenumber AS BIGINT) AS n_components, CAST(NULL AS INTEGER) AS diameter, l_quantity AS median_time_s, "
    "l_extendedprice AS mean_time_s, l_discount AS stdev_time_s, CAST(NULL AS INTEGER) AS iterations, "
    "l_linenumber AS successful_runs, 0 AS timeout_runs, l_linenumber AS n_runs, 0 AS timed_out, 0 AS error "
    "FROM lineitem"
)


def line_table(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("algo"),
        F.col("l_linestatus").alias("graph_type"),
        F.col("l_partkey").alias("n_nodes"),
        F.col("l_suppkey").alias("n_edges"),
        F.col("l_linenumber").alias("n_components"),
        F.col("l_quantity").alias("median_time_s"),
        F.col("l_extendedprice").alias("mean_time_s"),
        F.col("l_discount").alias("stdev_time_s"),
        F.col("l_linenumber").alias("successful_runs"),
        F.lit(0).alias("timeout_runs"),
        F.col("l_linenumber").alias("n_runs"),
        F.lit(0).alias("timed_out"),
        F.lit(0).alias("error"),
    )


@query("runs_roundtrip", ROUNDTRIP_SQL)
def _(spark, sf_dir):
    """Written in the older form, without diameter and iterations."""
    path = Workspace(spark).table("runs")
    write_runs(line_table(spark, sf_dir), path)
    return read_runs(spark, path)


@query(
    "runs_mixed_headers",
    f"WITH r AS ({ROUNDTRIP_SQL}) SELECT * FROM r UNION ALL "
    "SELECT * REPLACE (CAST(n_runs AS INTEGER) AS diameter, 5 AS iterations) FROM r WHERE algo = 'R'",
)
def _(spark, sf_dir):
    """Files of both forms under one path."""
    path = Workspace(spark).table("runs")
    runs = line_table(spark, sf_dir)
    write_runs(runs, f"{path}/old")
    newer = runs.filter("algo = 'R'").withColumns({"diameter": F.col("n_runs"), "iterations": F.lit(5)})
    write_runs(newer, f"{path}/new")
    return read_runs(spark, f"{path}/*")
