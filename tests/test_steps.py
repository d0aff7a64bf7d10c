import random

import pytest
from pyspark.sql import functions as F

from edgetables.operators import edges as E, groups as G, pairs as P
from edgetables.plans.components import find_components
from edgetables.plans.contract import step_contract
from edgetables.plans import hot_groups as H, ordered, storage
from edgetables.plans.fixed_point import fixed_point
from edgetables.plans.hot_groups import hot_groups, salted_groups
from edgetables.plans.ordered import ordered_groups
from edgetables.plans.steps import in_turn, step_join, step_list, step_window
from tests.reference_labels import labels, one_step

FORMS = {
    "list": step_list,
    "window": step_window,
    "join": step_join,
    "join_broadcast": lambda *a: step_join(*a, join="broadcast"),
    "join_merge": lambda *a: step_join(*a, join="merge"),
}
rng = random.Random(4)
ROWS = {
    "loop": [(5, 5), (5, 6), (6, 7)],
    "copies": [(1, 2), (2, 1), (1, 2), (2, 3)],
    "random": [(rng.randrange(40), rng.randrange(40)) for _ in range(90)],
    "hub": [(50, i) for i in range(40)] + [(0, 60 + i) for i in range(40)] + [(50, 60)],
}


@pytest.mark.parametrize(
    "case, limit", [("loop", None), ("copies", None), ("random", None), ("random", 6), ("hub", None), ("hub", 6)]
)
@pytest.mark.parametrize("form", FORMS)
def test_one_step(edges, case, form, limit):
    flagged = P.dedup_flagged(FORMS[form](edges(ROWS[case]), None, limit))
    assert {(r["src"], r["dst"]): r["is_new"] for r in flagged.collect()} == one_step(ROWS[case])


def test_contract_step_is_the_same_with_and_without_hot_nodes(edges):
    pairs = edges([(max(p), min(p)) for p in ROWS["hub"] + ROWS["random"] if p[0] != p[1]] * 2)
    plain = {tuple(r) for r in P.dedup_flagged(step_contract(pairs)).collect()}
    split = {tuple(r) for r in P.dedup_flagged(step_contract(pairs, None, 6)).collect()}
    assert plain == split


def test_hot_groups_are_found_exactly_and_split(edges):
    pairs = E.symmetrize(edges(ROWS["hub"]))
    hot = {r["src"]: (r["hot_min"], r["salts"]) for r in hot_groups(pairs, 10).collect()}
    assert hot == {50: (0, 5), 0: (50, 5)}
    split = salted_groups(pairs, None, 10)
    sizes = split.rows.groupBy("src", "salt").count().agg(F.max("count")).first()[0]
    assert split.rows.count() == pairs.count() and sizes < 25
    kept = salted_groups(pairs, None, 10, drop_roots=True).rows
    assert kept.filter("src = 0").count() == 0 and kept.filter("src = 50").count() == 41


def test_many_hot_groups_are_joined_by_shuffle(edges, monkeypatch):
    pairs = E.symmetrize(edges(ROWS["hub"]))
    want = sorted(tuple(r) for r in G.with_group_min(pairs).collect())
    monkeypatch.setattr(H, "MAX_HOT_KEYS", 0)
    assert sorted(tuple(r) for r in G.with_group_min(pairs, None, 7).collect()) == want


@pytest.mark.parametrize("limit", [None, 7])
def test_neighbour_lists_and_group_minima(edges, limit):
    pairs = E.symmetrize(edges(ROWS["hub"]))
    want = {}
    for a, b in [tuple(r) for r in pairs.collect()]:
        want.setdefault(a, []).append(b)
    lists = G.neighbour_list(pairs, None, limit).collect()
    got = {}
    for row in lists:
        assert row["min_dst"] == min(want[row["src"]])
        got.setdefault(row["src"], []).extend(row["values"])
        assert limit is None or len(row["values"]) < 4 * limit
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    minima = G.with_group_min(pairs, None, limit).collect()
    assert len(minima) == pairs.count() and all(r["min_dst"] == min(want[r["src"]]) for r in minima)


@pytest.mark.parametrize("partitions", [None, 1, 11])
def test_ranks(edges, partitions):
    ranked = G.secondary_sort_rank(E.symmetrize(edges(ROWS["hub"] * 2)), partitions).collect()
    groups = {}
    for row in ranked:
        groups.setdefault(row["src"], []).append((row["row_num"], row["dst"], row["min_dst"]))
    for rows in groups.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert [r[1] for r in rows] == sorted(r[1] for r in rows)
        assert {r[2] for r in rows} == {rows[0][1]}
    assert len(groups[50]) == 41


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_rank_of_text_ties_and_null_keys(spark, partitions):
    rows = [(None if i % 3 else "k", str(i * 7 % 90), i % 4, i) for i in range(240)]
    frame = spark.createDataFrame(rows, "k string, word string, tie int, id int")
    got = {r["id"]: r["row_num"] for r in G.rank_in_group(frame, ["k"], ["word", "tie", "id"], partitions).collect()}
    want = {}
    for key in (None, "k"):
        for n, row in enumerate(sorted(r[1:] for r in rows if r[0] == key), 1):
            want[row[2]] = n
    assert got == want


def test_a_group_that_ties_spreads_over_partitions(spark):
    frame = spark.createDataFrame([("k", 1, i) for i in range(400)], "k string, tie int, id int")
    groups = ordered_groups(frame, ["k"], ["tie"], partitions=8)
    assert groups.rows.groupBy(groups.part_keys[-1]).count().agg(F.max("count")).first()[0] < 200
    ranks = [r["row_num"] for r in G.rank_in_group(frame, ["k"], ["tie"], 8).collect()]
    assert sorted(ranks) == list(range(1, 401))


@pytest.mark.parametrize("partitions", [None, 1, 9])
def test_next_in_group(spark, partitions):
    rows = [(g, (i * 37) % 101, g * 1000 + i) for g, n in ((1, 60), (2, 3), (3, 1)) for i in range(n)]
    frame = spark.createDataFrame(rows, "g int, at int, item bigint")
    got = {tuple(r) for r in G.next_in_group(frame, ["g"], ["at", "item"], "item", partitions).collect()}
    want = set()
    for g in (1, 2, 3):
        items = [item for _, item in sorted((at, item) for gg, at, item in rows if gg == g)]
        want |= set(zip(items, items[1:]))
    assert got == want


def test_secondary_sort_keeps_order_inside_partitions(edges):
    parts = G.secondary_sort(E.symmetrize(edges(ROWS["random"]))).rdd.glom().collect()
    for part in parts:
        assert [tuple(r) for r in part] == sorted(tuple(r) for r in part)
    assert sum(map(len, parts)) == 180


def test_edge_operators(edges):
    raw = edges([(2, 1), (1, 2), (3, 3), (None, 4), (5, None)])
    assert [tuple(r) for r in E.normalize_edges(raw).collect()] == [(1, 2)]
    assert sorted(r[0] for r in E.nodes(raw).collect()) == [1, 2, 3, 4, 5]
    assert [tuple(r) for r in E.shift_ids(edges([(1, 2)]), 10).collect()] == [(11, 12)]
    assert E.union_distinct(edges([(1, 2), (1, 2)]), edges([(1, 2), (2, 3)])).count() == 2


def test_metrics(spark, edges):
    flagged = P.dedup_flagged(spark.createDataFrame([(1, 2, 0), (1, 2, 1), (3, 4, 0)], "src long, dst long, is_new int"))
    assert tuple(P.convergence_metrics(flagged).first()) == (2, 1)
    assert tuple(P.convergence_metrics(flagged.limit(0)).first()) == (0, 0)


@pytest.mark.parametrize("step", [step_list, step_window, step_join])
def test_steps_in_turn_never_grow_the_table(edges, step):
    chain = [(i, i + 1) for i in range(60)]
    run = fixed_point(edges([(b, a) for a, b in chain]), in_turn(step))
    assert max(m["pair_count"] for m in run.metrics) <= 60  # a step to all neighbours yields more
    assert sorted(tuple(r) for r in run.pairs.collect()) == [(i, 0) for i in range(1, 61)]


@pytest.mark.parametrize("step", [step_list, step_window, step_join])
def test_steps_in_turn_meet_copies_early(edges, step):
    numbers = random.Random(3)
    pairs = {(1000 + i, numbers.randrange(30)) for i in range(300) for _ in range(4)}
    run = fixed_point(edges(list(pairs)), in_turn(step))
    assert run.metrics[1]["pair_count"] < len(pairs) / 2  # with the step to larger neighbours first the second one still yields more
    labels = dict(tuple(r) for r in run.pairs.collect())
    assert set(labels.values()) == {0} and len(labels) == len({a for a, _ in pairs}) + 29


def test_neighbour_lists_are_made_after_the_shuffle(edges):
    lists = G.neighbour_list(edges(ROWS["random"]))
    plan = lists._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffle = next(i for i, line in enumerate(plan) if "Exchange" in line)
    assert not any("collect_list" in line for line in plan[shuffle:])  # lists of few rows each would be as large as the rows
    assert sum("Exchange" in line for line in plan) == 1


def test_tasks_stay_small_and_settings_are_put_back(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    monkeypatch.setattr(ordered, "TASK_ROWS", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with storage.small_tasks(spark, 1000):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "10"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    groups = ordered_groups(spark.range(2000).selectExpr("id % 2 AS k", "id"), ["k"], ["id"], partitions=2)
    assert groups.rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 400


@pytest.mark.parametrize("limit", [None, 5])
@pytest.mark.parametrize("step", [step_list, step_window, step_join])
def test_steps_that_settle_go_on_without_the_step_that_finds_nothing(edges, step, limit):
    numbers = random.Random(5)
    rows = [(i + 1, i) for i in range(100)] + [(i, i - numbers.randrange(1, 200)) for i in range(300, 400)] * 2
    taken = []

    def noted(name, half):
        return lambda pairs, n: taken.append(name) or half(pairs, n, limit)

    halves = tuple(noted(name, half) for name, half in zip(("smaller", "larger"), in_turn(step)))
    run = fixed_point(edges(rows), halves, settles=True)
    quiet = next(i for i, m in enumerate(run.metrics) if taken[i] == "smaller" and not m["new_pairs"])
    assert run.converged and len(taken) > quiet + 2 and set(taken[quiet + 1 :]) == {"larger"}  # two in turn: as many smaller
    assert {m["pair_count"] for m in run.metrics[quiet:]} == {len({a for a, _ in rows})}
    found = sorted(tuple(r) for r in run.pairs.collect())
    assert found == sorted((n, c) for n, c in labels(rows).items() if n != c)


def test_a_loop_that_settles_looks_for_no_copies(edges):
    chain = [(i + 1, i) for i in range(100)]
    run = find_components(edges(chain), "window")
    assert run.iterations == 9 and run.metrics[0]["new_pairs"] == 0  # in turn it took 16
    assert sorted(tuple(r) for r in run.pairs.collect()) == [(i, 0) for i in range(1, 101)]
