import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from edgetables import NotConverged, component_diameters, find_diameters
from edgetables.operators import synth
from edgetables.plans import diameter
from tests.test_components import CASES, sparse


def brute_force(edges):
    """``{(component, n_nodes, diameter)}`` by a search from every node."""
    near = defaultdict(set)
    for a, b in edges:
        for node, other in ((a, b), (b, a)):
            if node is not None:
                near[node] |= {other} - {None, node}
    out = set()
    for start in near:
        far, level, seen = 0, [start], {start: 0}
        while level:
            level = [b for a in level for b in near[a] if seen.setdefault(b, seen[a] + 1) > seen[a]]
            level = list(dict.fromkeys(b for b in level if seen[b] == far + 1))
            far += bool(level)
        out.add((min(seen), len(seen), start, far))
    best = defaultdict(int)
    for component, n, _, far in out:
        best[component, n] = max(best[component, n], far)
    return {(component, n, far) for (component, n), far in best.items()}


def rows(frame):
    return {tuple(r) for r in frame.select("component", "n_nodes", "diameter").collect()}


def cycle(n):
    return [(i, (i + 1) % n) for i in range(n)]


def grid(n):
    return [(a * n + b, c * n + d) for a in range(n) for b in range(n) for c, d in ((a + 1, b), (a, b + 1)) if c < n and d < n]


def joined(edges):
    """All small cases side by side, ids apart, so that one run checks them."""
    return [tuple(None if v is None else v + 10_000 * k for v in e) for k, case in enumerate(edges) for e in case]


SMALL = [c for name, c in CASES.items() if name not in ("wide_ids", "shuffled_path")] + [cycle(5), cycle(20), grid(6), sparse(90, 120, 7)]


@pytest.mark.parametrize("limit, cases", [(None, [*SMALL, CASES["shuffled_path"]]), (40, SMALL)])
def test_all_components_at_once(edges, limit, cases):
    case = joined(cases)
    assert rows(component_diameters(edges(case), max_group_rows=limit)) == brute_force(case)


def test_components_larger_than_one_round(edges):
    rng = random.Random(3)
    tree = [(i, rng.randrange(i)) for i in range(1, 150)]
    case = joined([tree, cycle(70)])
    with find_diameters(edges(case)) as found:
        assert found.exact and found.rounds > 1
        assert rows(found.rows.withColumn("diameter", F.col("at_least"))) == brute_force(case)


def test_a_graph_of_given_diameter(spark):
    got = component_diameters(synth.fixed_diameter(spark, 300, 900, 12)).collect()
    assert [tuple(r) for r in got] == [(0, 300, 12)]


def test_text_keys(spark):
    frame = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", None), ("c", "d")], "src string, dst string")
    assert rows(component_diameters(frame)) == {("a", 4, 3), ("x", 1, 0)}


def test_empty_and_lonely(edges):
    assert rows(component_diameters(edges([]))) == set()
    assert rows(component_diameters(edges([(4, 4), (None, 7), (None, None)]))) == {(4, 1, 0), (7, 1, 0)}


def test_the_limit_of_rounds(edges):
    case = edges(cycle(80))
    with pytest.raises(NotConverged):
        find_diameters(case, max_rounds=1)
    with find_diameters(case, max_rounds=1, on_limit="return") as found:
        row = found.rows.collect()[0]
        assert not found.exact and row["at_least"] <= 40 <= row["at_most"] and row["n_nodes"] == 80
    with pytest.raises(TypeError):
        component_diameters(case, on_limit="return")


def test_stars_and_complete_graphs_need_no_search(edges):
    case = joined([[(0, i) for i in range(1, 90)], [(i, j) for i in range(70) for j in range(i)], [(4, 4)]])
    with find_diameters(edges(case)) as found:
        assert found.exact and found.rounds == 0
        assert rows(found.rows.withColumn("diameter", F.col("at_least"))) == brute_force(case)


def test_a_dense_graph_of_two_sides_takes_few_rounds(edges):
    rng = random.Random(6)
    case = [(2 * a, 2 * b + 1) for a in range(900) for b in rng.sample(range(300), 30)]
    with find_diameters(edges(case)) as found:
        assert found.exact and found.rounds <= 4  # by the bounds of single nodes: as many as the smaller side asks for
        assert rows(found.rows.withColumn("diameter", F.col("at_least"))) == brute_force(case)


@pytest.mark.parametrize("width, limit", [(8, 300), (2, 5000)])
def test_a_sparse_graph_of_two_sides_takes_few_rounds(edges, monkeypatch, width, limit):
    monkeypatch.setattr(diameter, "WIDTH", width)  # with 2: rows of several blocks of words
    rng = random.Random(6)
    case = [(2 * a, 2 * b + 1) for a in range(900) for b in rng.sample(range(200), 6)]
    with find_diameters(edges(case), max_group_rows=limit) as found:
        assert found.exact and found.rounds <= 4  # by 64 searches a round it was not settled after eight
        assert rows(found.rows.withColumn("diameter", F.col("at_least"))) == brute_force(case)
