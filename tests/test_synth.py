from collections import Counter, deque

import pytest

from edgetables import connected_components
from edgetables.operators import synth


def rows(frame):
    pairs = [tuple(r) for r in frame.collect()]
    assert len(set(pairs)) == len(pairs), "an edge appears twice"
    assert all(a < b for a, b in pairs)
    return pairs


def n_components(frame):
    return connected_components(frame).filter("node = component").count()


def test_chain_and_star(spark):
    assert sorted(rows(synth.chain(spark, 5))) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert sorted(rows(synth.star(spark, 4))) == [(0, 1), (0, 2), (0, 3)]
    assert rows(synth.chain(spark, 1)) == [] and rows(synth.star(spark, 0)) == []


@pytest.mark.parametrize("n, m", [(7, 21), (8, 28), (8, 1000), (101, 300), (1000, 4000), (2, 1), (1, 3)])
def test_random_edges_number_and_range(spark, n, m):
    pairs = rows(synth.random_edges(spark, n, m))
    assert len(pairs) == min(m, n * (n - 1) // 2)
    assert all(0 <= a < b < n for a, b in pairs)


def test_random_edges_depend_on_the_seed_only(spark):
    first = set(rows(synth.random_edges(spark, 500, 900, seed=1)))
    assert first == set(rows(synth.random_edges(spark, 500, 900, seed=1).repartition(3)))
    assert len(first & set(rows(synth.random_edges(spark, 500, 900, seed=2)))) < 60


def test_random_edges_spread_over_the_nodes(spark):
    degree = Counter(v for pair in rows(synth.random_edges(spark, 200, 4000)) for v in pair)
    assert len(degree) == 200 and max(degree.values()) < 3 * min(degree.values())


@pytest.mark.parametrize("n, k, m", [(10, 3, 100), (11, 3, 7), (20, 20, 5), (40, 21, 7), (1000, 7, 3000), (5, 9, 2)])
def test_multi_component_blocks(spark, n, k, m):
    pairs = rows(synth.multi_component(spark, n, k, m))
    k = min(k, n)
    sizes = [n // k + (i < n % k) for i in range(k)]
    starts = [sum(sizes[:i]) for i in range(k)]
    capacity = [s * (s - 1) // 2 for s in sizes]
    assert len(pairs) == min(m, sum(capacity))
    block = {v: i for i in range(k) for v in range(starts[i], starts[i] + sizes[i])}
    assert all(block[a] == block[b] for a, b in pairs)
    quota = Counter(block[a] for a, _ in pairs)
    for i in range(k):
        share = len(pairs) * capacity[i] / max(sum(capacity), 1)
        assert share - 1 < quota[i] < share + 1 + 1e-9


def test_dense_blocks_are_components(spark):
    assert n_components(synth.multi_component(spark, 600, 6, 6000)) == 6


@pytest.mark.parametrize("n, k, inside, between", [(20, 4, 30, 50), (21, 4, 45, 165), (50, 60, 0, 100), (900, 10, 3000, 500)])
def test_communities(spark, n, k, inside, between):
    pairs = rows(synth.communities(spark, n, k, inside, between))
    same = sum(a % k == b % k for a, b in pairs)
    assert (same, len(pairs) - same) == (inside, between)
    assert all(0 <= a < b < n for a, b in pairs)


def test_communities_refuses_what_does_not_fit(spark):
    with pytest.raises(ValueError):
        synth.communities(spark, 10, 1, 5, 1)
    with pytest.raises(ValueError):
        synth.communities(spark, 10, 10, 1, 5)


@pytest.mark.parametrize("n, m0", [(10, 1), (10, 2), (500, 3), (400, 5), (3, 5)])
def test_scale_free(spark, n, m0):
    frame = synth.scale_free(spark, n, m0)
    pairs = rows(frame)
    if n <= m0:
        assert len(pairs) == n * (n - 1) // 2
        return
    assert len(pairs) == m0 * (m0 - 1) // 2 + (n - m0) * m0
    links = Counter(b for _, b in pairs)
    assert all(links[v] == m0 for v in range(m0, n))
    assert n_components(frame) == 1
    if n >= 400:
        degree = sorted(Counter(v for pair in pairs for v in pair).values())
        assert degree[-1] > 8 * degree[len(degree) // 2]


def diameter(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    longest = 0
    for start in near:
        depth, queue = {start: 0}, deque([start])
        while queue:
            node = queue.popleft()
            for other in near[node]:
                if other not in depth:
                    depth[other] = depth[node] + 1
                    queue.append(other)
        assert len(depth) == len(near), "not connected"
        longest = max(longest, *depth.values())
    return longest, len(near)


@pytest.mark.parametrize("n, m, d", [(10, 9, 9), (10, 100, 3), (30, 29, 7), (200, 1500, 10), (12, 66, 2), (100, 300, 99)])
def test_fixed_diameter(spark, n, m, d):
    pairs = rows(synth.fixed_diameter(spark, n, m, d))
    assert diameter(pairs) == (d, n)
    assert n - 1 <= len(pairs) <= m
    if n == 200:
        assert len(pairs) == m


def test_fixed_diameter_limits(spark):
    assert len(rows(synth.fixed_diameter(spark, 9, 50, 1))) == 36
    with pytest.raises(ValueError):
        synth.fixed_diameter(spark, 5, 10, 5)
    with pytest.raises(ValueError):
        synth.fixed_diameter(spark, 5, 3, 2)
