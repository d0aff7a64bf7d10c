import pathlib
import random

import pytest
from pyspark.sql import functions as F

from edgetables import (
    NotConverged,
    attach_labels,
    component_map,
    component_pairs,
    component_sizes,
    connected_components,
    find_components,
    fixed_point,
    graph_stats,
    nodes,
    step_window,
)
from edgetables.plans.storage import checkpoint_root
from tests.reference_labels import labels

STRATEGIES = ["contract", "window", "join", "list"]


def shuffled_path(n, seed):
    ids = random.Random(seed).sample(range(n), n)
    return list(zip(ids, ids[1:]))


def sparse(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


CASES = {
    "reciprocal": [(1, 2), (2, 1)],
    "self_loop_only": [(5, 5)],
    "self_loop_and_edge": [(5, 5), (5, 6)],
    "duplicates": [(1, 2), (1, 2), (2, 3)],
    "negative_ids": [(-1, -2), (-2, 3)],
    "first_key_minus_one": [(-1, 0), (0, 7)],
    "empty": [],
    "triangle": [(1, 2), (2, 3), (1, 3)],
    "null_ends": [(1, 2), (2, None), (1, 3), (None, 9), (7, None), (None, None)],
    "mixed_direction": [(2, 1), (2, 3), (4, 3)],
    "wide_ids": [(2**62, -(2**62)), (2**62, 5)],
    "hub_is_largest": [(1000, i) for i in range(150)],
    "two_hubs": [(0, 500 + i) for i in range(80)] + [(999, i) for i in range(60)] + [(999, 501)],
    "shuffled_path": shuffled_path(120, 1),
    "sparse": sparse(150, 110, 2) * 2,
}


def found(frame):
    rows = frame.collect()
    result = {row["node"]: row["component"] for row in rows}
    assert len(result) == len(rows), "a node appears twice"
    return result


@pytest.mark.parametrize("case", CASES)
def test_every_node_gets_the_smallest_id_of_its_component(edges, case):
    assert found(connected_components(edges(CASES[case]))) == labels(CASES[case])


@pytest.mark.parametrize("strategy", STRATEGIES[1:])
@pytest.mark.parametrize("case", ["null_ends", "duplicates", "two_hubs", "shuffled_path", "sparse"])
def test_strategies_agree(edges, case, strategy):
    assert found(connected_components(edges(CASES[case]), strategy)) == labels(CASES[case])


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("case", ["hub_is_largest", "two_hubs", "sparse"])
def test_labels_do_not_depend_on_how_hot_groups_are_split(edges, case, strategy):
    assert found(connected_components(edges(CASES[case]), strategy, max_group_rows=5)) == labels(CASES[case])


def test_direction_order_copies_and_shift_do_not_matter(edges):
    rows = CASES["sparse"]
    want = labels(rows)
    changed = [(b, a) for a, b in reversed(rows)] + rows[:30]
    assert found(connected_components(edges(changed))) == want
    shifted = [(a - 1000, b - 1000) for a, b in rows]
    assert found(connected_components(edges(shifted))) == {k - 1000: v - 1000 for k, v in want.items()}


def test_star_pairs_leave_out_roots_and_are_stable(edges):
    pairs = component_pairs(edges(CASES["sparse"]))
    rows = [tuple(r) for r in pairs.collect()]
    assert sorted(rows) == sorted((n, c) for n, c in labels(CASES["sparse"]).items() if n != c)
    again = component_pairs(pairs)
    assert sorted(tuple(r) for r in again.collect()) == sorted(rows)


def tables_left(spark):
    root = pathlib.Path(checkpoint_root(spark))
    return {p.name for p in root.glob("edgetables-*")} if root.exists() else set()


def test_no_table_is_left_after_close_or_failure(spark, edges):
    before = tables_left(spark)
    with find_components(edges([*CASES["sparse"], (7, 7)])) as run:
        assert len(tables_left(spark)) == len(before) + 1 and run.labels().count() > 0
    with pytest.raises(NotConverged):
        connected_components(edges(CASES["shuffled_path"]), max_iterations=1)
    assert tables_left(spark) == before


@pytest.mark.parametrize("limit", [None, 5])
def test_ends_of_two_types_are_refused_at_every_size(spark, limit):
    rows = spark.createDataFrame([("a", 1)] * 9, "src string, dst long")
    with pytest.raises(TypeError, match="one type"):
        connected_components(rows, max_group_rows=limit)
    small = spark.createDataFrame([(1, 2), (2, 3)], "src int, dst smallint")
    assert found(connected_components(small, max_group_rows=limit)) == {1: 1, 2: 1, 3: 1}


def test_iteration_limit_raises_or_returns(edges):
    rows = edges(CASES["shuffled_path"])
    with pytest.raises(NotConverged):
        connected_components(rows, max_iterations=1)
    with pytest.raises(TypeError, match="find_components"):
        connected_components(rows, max_iterations=1, on_limit="return")
    run = find_components(rows, max_iterations=1, on_limit="return")
    assert not run.converged and run.iterations == 1 and run.metrics[0]["new_pairs"] > 0
    assert run.metrics[0]["seconds"] > 0


def test_contracting_never_grows_the_table(edges):
    rows = CASES["sparse"]
    run = find_components(edges(rows))
    counts = [m["pair_count"] for m in run.metrics]
    assert counts == sorted(counts, reverse=True) and counts[0] <= len(rows)
    assert run.metrics[-1]["new_pairs"] == 0


def test_custom_step(edges):
    calls = []

    def step(pairs, n):
        calls.append(n)
        return step_window(pairs, n)

    run = fixed_point(edges([(1, 2), (2, 3), (3, 4)]), step)
    assert sorted(tuple(r) for r in run.pairs.collect()) == [(2, 1), (3, 1), (4, 1)]
    assert calls[0] == 3 and len(calls) == run.iterations


def test_component_tables(edges):
    rows = [(2, 1), (3, 1), (9, 8)]
    assert found(component_map(edges(rows))) == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    raw = edges([(2, 1), (3, 1), (9, 8), (4, 4)])
    assert found(attach_labels(nodes(raw), component_map(edges(rows)))) == {1: 1, 2: 1, 3: 1, 4: 4, 8: 8, 9: 8}
    components = connected_components(raw)
    sizes = {r["component"]: r["n_nodes"] for r in component_sizes(components).collect()}
    assert sizes == {1: 3, 4: 1, 8: 2}
    assert tuple(graph_stats(raw, components).first()) == (4, 6, 3)
    assert tuple(graph_stats(raw.limit(0), components.limit(0)).first()) == (0, 0, 0)


def test_both_ends_of_an_edge_share_a_component(spark, edges):
    rows = edges(sparse(400, 380, 9))
    component = connected_components(rows)
    src = component.withColumnRenamed("node", "src").withColumnRenamed("component", "c1")
    dst = component.withColumnRenamed("node", "dst").withColumnRenamed("component", "c2")
    joined = rows.join(src, "src").join(dst, "dst")
    assert joined.count() == rows.count()
    assert joined.filter(F.col("c1") != F.col("c2")).count() == 0
    assert component.filter(F.col("component") > F.col("node")).count() == 0
