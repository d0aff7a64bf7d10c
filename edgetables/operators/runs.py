"""Summaries of run-metrics tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from edgetables.functions.ids import big, int_div
from edgetables.plans.ordered import null_safe_join, ordered_groups
from edgetables.sources.runs import RUN_COLUMNS

RUN_KEYS = ["algo", "graph"]
# The columns that name a graph in a run table, and what a missing time is written as.
GRAPH_KEYS = ["graph_type", "n_nodes", "n_edges", "n_components"]
MISSING = -1.0


def exact_median(rows: DataFrame, keys: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """``(keys, median)``: middle value of each group, the mean of two for an even size.

    Null keys are a group; a group without a value has a null median.  Values are
    counted first and then walked in order, so repeated values cost nothing.
    """
    counted = rows.groupBy(*keys, value).agg(F.count(value).alias("copies"))
    groups = ordered_groups(counted, keys, [value], "copies", partitions)
    group = Window.partitionBy(*groups.part_keys)
    so_far = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = groups.rows.select(
        *keys,
        value,
        "copies",
        (F.sum("copies").over(so_far) + groups.before).alias("last"),
        F.coalesce(groups.total, F.sum("copies").over(group)).alias("size"),
    )

    def value_at(rank):
        return F.max(F.when((rank <= F.col("last")) & (rank > F.col("last") - F.col("copies")), F.col(value)))

    lower, upper = int_div(F.col("size") + 1, big(2)), int_div(F.col("size") + 2, big(2))
    return placed.groupBy(*keys).agg(((value_at(lower) + value_at(upper)) / 2).alias("median"))


def run_stats(runs: DataFrame, stdev: str = "sample", partitions: int | None = None) -> DataFrame:
    """Per (algo, graph): times of the successful runs and counts by outcome.

    Times are 0 and iterations -1 where no run succeeded; the sample standard
    deviation of a single run is 0.  ``iterations`` is that of the first
    successful run.
    """
    spread = {"sample": F.stddev_samp, "population": F.stddev_pop}[stdev]
    ok = F.col("status") == "ok"
    time = F.when(ok, F.col("wall_s"))
    timeouts, errors = F.count_if(F.col("status") == "timeout"), F.count_if(F.col("status") == "error")
    counts = runs.groupBy(*RUN_KEYS).agg(
        F.coalesce(F.avg(time), F.lit(0.0)).alias("mean_time_s"),
        F.coalesce(spread(time), F.lit(0.0)).alias("stdev_time_s"),
        F.coalesce(F.min_by("iterations", F.when(ok, F.col("run"))), F.lit(-1)).alias("iterations"),
        F.count_if(ok).alias("successful_runs"),
        timeouts.alias("timeout_runs"),
        F.count(F.lit(1)).alias("n_runs"),
        (timeouts > 0).cast("int").alias("timed_out"),
        (errors > 0).cast("int").alias("error"),
    )
    medians = exact_median(runs.select(*RUN_KEYS, time.alias("wall_s")), RUN_KEYS, "wall_s", partitions)
    return null_safe_join(counts, medians, RUN_KEYS).select(
        *RUN_KEYS,
        F.coalesce("median", F.lit(0.0)).alias("median_time_s"),
        *[c for c in counts.columns if c not in RUN_KEYS],
    )


def runs_table(stats: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of a run table: summaries of :func:`run_stats` with what the catalog says about their graph.

    ``catalog`` has a column ``graph`` beside the ones of a graph catalog, once per
    graph; a graph that it lacks leaves them null.
    """
    facts = catalog.select("graph", *GRAPH_KEYS, "diameter")
    joined = stats.join(facts, "graph", "left")
    return joined.select(*[F.col(name).cast(kind).alias(name) for name, kind in RUN_COLUMNS.items()])


def runs_pivot(runs: DataFrame, algos: list[str]) -> DataFrame:
    """One row per graph, one column for each of ``algos`` with its average mean time, -1 where missing."""
    table = runs.groupBy(*GRAPH_KEYS).pivot("algo", algos).agg(F.avg("mean_time_s"))
    return table.fillna(MISSING, [c for c in table.columns if c not in GRAPH_KEYS])


def best_per_row(pivot: DataFrame, algos: list[str]) -> DataFrame:
    """``best_time_s`` and ``best_algo``: smallest positive cell of each row, null if there is none."""
    cells = F.array(*[F.struct(F.col(a).alias("time"), F.lit(a).alias("algo")) for a in algos])
    best = F.array_min(F.filter(cells, lambda cell: cell["time"] > 0))
    return pivot.withColumn("best", best).select(
        *pivot.columns, F.col("best.time").alias("best_time_s"), F.col("best.algo").alias("best_algo")
    )


def stack_runs(*tables: DataFrame) -> DataFrame:
    """Run tables on top of each other; columns missing in one are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def graph_types(runs: DataFrame) -> DataFrame:
    return runs.select("graph_type").distinct()


def order_runs(runs: DataFrame) -> DataFrame:
    """Rows by graph type and, within it, by number of nodes."""
    return runs.orderBy("graph_type", "n_nodes")
