import random
import statistics

import pytest
from pyspark.sql import functions as F

from edgetables.functions.text import display_name
from edgetables.operators import runs as R

SCHEMA = "algo string, graph string, run int, wall_s double, iterations int, status string"
ROWS = [
    ("a", "g", 1, 3.0, 7, "ok"),
    ("a", "g", 2, 1.0, 6, "ok"),
    ("a", "g", 3, 2.5, 6, "ok"),
    ("a", "g", 4, None, None, "timeout"),
    ("b", "g", 1, 4.0, 5, "ok"),
    ("b", "h", 1, None, None, "error"),
]


@pytest.mark.parametrize("stdev, pick", [("sample", statistics.stdev), ("population", statistics.pstdev)])
def test_run_stats(spark, stdev, pick):
    got = {(r["algo"], r["graph"]): r for r in R.run_stats(spark.createDataFrame(ROWS, SCHEMA), stdev).collect()}
    first = got["a", "g"]
    assert (first["median_time_s"], first["iterations"]) == (2.5, 7)
    assert first["mean_time_s"] == pytest.approx(6.5 / 3)
    assert first["stdev_time_s"] == pytest.approx(pick([3.0, 1.0, 2.5]))
    assert [first[c] for c in ("successful_runs", "timeout_runs", "n_runs", "timed_out", "error")] == [3, 1, 4, 1, 0]
    assert got["b", "g"]["stdev_time_s"] == 0.0
    assert tuple(got["b", "h"])[2:] == (0.0, 0.0, 0.0, -1, 0, 0, 1, 0, 1)


@pytest.mark.parametrize("partitions", [None, 1, 9])
def test_exact_median_does_not_depend_on_the_partitions(spark, partitions):
    rng = random.Random(5)
    values = {"hot": [rng.gauss(0, 50) for _ in range(201)], "even": [1.0, 2.0, 5.0, 9.0], "same": [2.5] * 40, "one": [7.0]}
    values[None] = [4.0, 1.0]
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("one", None), ("none", None), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["median"] for r in R.exact_median(frame, ["k"], "v", partitions).collect()}
    assert got.pop("none") is None
    assert got == pytest.approx({k: statistics.median(vs) for k, vs in values.items()})


def test_run_stats_keeps_null_keys(spark):
    rows = [("A", None, 1, 1.0, 1, "ok"), ("A", None, 2, 3.0, 1, "ok"), (None, "g", 1, 5.0, 1, "ok")]
    got = {(r["algo"], r["graph"]): r["median_time_s"] for r in R.run_stats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("A", None): 2.0, (None, "g"): 5.0}


def test_runs_table_takes_graph_facts_from_the_catalog(spark):
    stats = R.run_stats(spark.createDataFrame(ROWS, SCHEMA))
    schema = "graph string, graph_type string, n_nodes long, n_edges long, n_components long, diameter long"
    table = R.runs_table(stats, spark.createDataFrame([("g", "star", 5, 4, 1, 2)], schema))
    got = {(r["algo"], r["graph_type"]): (r["n_nodes"], r["diameter"], r["n_runs"]) for r in table.collect()}
    assert got == {("a", "star"): (5, 2, 4), ("b", "star"): (5, 2, 1), ("b", None): (None, None, 1)}


def test_pivot_and_best(spark):
    schema = "graph_type string, n_nodes long, n_edges long, n_components long, algo string, mean_time_s double"
    rows = [("s", 10, 9, 1, "x", 2.0), ("s", 10, 9, 1, "x", 4.0), ("s", 10, 9, 1, "y", 3.0), ("c", 5, 4, 1, "y", 0.0)]
    runs = spark.createDataFrame(rows, schema)
    pivot = R.runs_pivot(runs, ["x", "y"])
    got = {r["graph_type"]: (r["x"], r["y"]) for r in pivot.collect()}
    assert got == {"s": (3.0, 3.0), "c": (-1.0, 0.0)}
    best = {r["graph_type"]: (r["best_time_s"], r["best_algo"]) for r in R.best_per_row(pivot, ["x", "y"]).collect()}
    assert best == {"s": (3.0, "x"), "c": (None, None)}


def test_stack_order_and_names(spark):
    a = spark.createDataFrame([("web_google", 5), ("chain", 9)], "graph_type string, n_nodes long")
    b = spark.createDataFrame([("chain", 1, 3)], "graph_type string, n_nodes long, iterations int")
    stacked = R.stack_runs(a, b)
    assert [tuple(r) for r in R.order_runs(stacked).collect()] == [("chain", 1, 3), ("chain", 9, None), ("web_google", 5, None)]
    assert sorted(r[0] for r in R.graph_types(stacked).collect()) == ["chain", "web_google"]
    assert {r[0] for r in a.select(display_name(F.col("graph_type"))).collect()} == {"Web Google", "Chain"}
