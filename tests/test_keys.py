"""Ids that are no whole numbers."""

import datetime
import decimal
import random

import pytest

from edgetables import component_pairs, connected_components, edges_from, find_components, number_edges, number_keys
from edgetables.plans.hot_groups import join_facts

DAY = datetime.date(2020, 1, 1)
MAKERS = {
    "string": lambda k: f"key {k:03d} é",
    "date": lambda k: DAY + datetime.timedelta(days=k),
    "timestamp": lambda k: datetime.datetime(2021, 5, 1) + datetime.timedelta(seconds=k),
    "decimal(30,2)": lambda k: decimal.Decimal(k) / 4,
    "double": lambda k: k / 8 - 3,
    "binary": lambda k: b"\x00" + bytes([k]),
    "struct<a:string,b:int>": lambda k: (f"{k // 7:02d}", k),
    "array<int>": lambda k: [k // 10, k % 10],
}


def plain(edges):
    label = {}
    for a, b in edges:
        for end in (a, b):
            if end is not None:
                label.setdefault(end, end)
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a is not None and b is not None and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return label


@pytest.mark.parametrize("kind", sorted(MAKERS))
def test_components_of_keys_of_any_type(spark, kind):
    rng = random.Random(kind)
    numbers = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(61, 61), (62, None), (None, 63), (None, None)]
    make = lambda k: None if k is None else MAKERS[kind](k)
    frame = spark.createDataFrame([(make(a), make(b)) for a, b in numbers], f"src {kind}, dst {kind}")
    hashable = lambda x: tuple(x) if isinstance(x, (list, tuple)) else bytes(x) if isinstance(x, bytearray) else x
    got = {hashable(r["node"]): hashable(r["component"]) for r in connected_components(frame).collect()}
    want = plain(numbers)
    assert got == {hashable(make(k)): hashable(make(c)) for k, c in want.items()}


@pytest.mark.parametrize("strategy", ["contract", "window", "join", "list"])
@pytest.mark.parametrize("limit", [None, 3])
def test_hot_keys_take_the_split_plans(spark, strategy, limit):
    edges = [("hub", f"leaf{k}") for k in range(40)] + [("a", "b")] * 9 + [("b", "c"), (None, "hub"), ("z", None)] * 5
    frame = spark.createDataFrame(edges, "src string, dst string")
    labels = {r["node"]: r["component"] for r in connected_components(frame, strategy, max_group_rows=limit).collect()}
    assert labels == plain(edges)
    pairs = {tuple(r) for r in component_pairs(frame, strategy, max_group_rows=limit).collect()}
    assert pairs == {(k, c) for k, c in plain(edges).items() if k != c}


@pytest.mark.parametrize("ranges", [1, 2, 7, 50])
def test_numbers_are_dense_and_in_order(spark, ranges):
    words = [f"{k % 23:x}-{k % 5}" for k in range(300)] + [None, ""]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = number_keys(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["key"]: r["id"] for r in got} == {w: k for k, w in enumerate(sorted(set(words) - {None}))}


def test_numbers_of_nothing(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert number_keys(none, "src").count() == 0 and connected_components(none).count() == 0
    keyed = number_edges(spark.createDataFrame([(None, None)], none.schema))
    assert [tuple(r) for r in keyed.edges.collect()] == [(None, None)] and keyed.keys.count() == 0


def test_edges_keep_copies_and_null_ends(spark):
    keyed = number_edges(spark.createDataFrame([("b", "a"), ("b", "a"), (None, "c")], "src string, dst string"))
    assert sorted(map(str, (tuple(r) for r in keyed.edges.collect()))) == ["(1, 0)", "(1, 0)", "(None, 2)"]
    assert sorted(tuple(r) for r in keyed.decoded(keyed.edges.filter("src is not null")).collect()) == [("b", "a")] * 2


def test_facts_reach_hot_missing_and_null_keys(spark):
    rows = [("hot", k) for k in range(30)] + [(None, k) for k in range(20)] + [("cold", 1), ("missing", 2)] + [("gone", k) for k in range(9)]
    frame = spark.createDataFrame(rows, "k string, v int")
    facts = spark.createDataFrame([("hot", 1.5, "x"), ("cold", 2.5, None)], "k string, f double, g string")
    known = {"hot": (1.5, "x"), "cold": (2.5, None)}
    for limit in (5, 1000):
        got = join_facts(frame, facts, "k", 61, limit).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str((k, v, *known.get(k, (None, None)))) for k, v in rows)


def test_edges_from_other_keys(spark):
    frame = spark.createDataFrame([("x", "x", DAY), (None, "y", DAY)], "a string, b string, c date")
    assert [tuple(r) for r in edges_from(frame, "a", "b").collect()] == [("x", "x"), (None, "y")]
    mixed = edges_from(frame, "a", "c", two_sided=True).collect()
    assert tuple(mixed[0]["src"]) == (0, "x") and tuple(mixed[0]["dst"]) == (1, "2020-01-01") and mixed[1]["src"] is None
    with pytest.raises(TypeError, match="offsets"):
        edges_from(frame, "a", "b", src_offset=1)
    with find_components(edges_from(frame, "a", "b", two_sided=True)) as run:
        labels = {tuple(r["node"]): tuple(r["component"]) for r in run.labels().collect()}
    assert labels == {(0, "x"): (0, "x"), (1, "x"): (0, "x"), (1, "y"): (1, "y")}
