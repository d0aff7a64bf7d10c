"""Brute force: components by union-find and one propagation step by loops."""

from __future__ import annotations

from collections import defaultdict


def labels(edges) -> dict[int, int]:
    parent: dict[int, int] = {}

    def root(node):
        parent.setdefault(node, node)
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    for a, b in edges:
        ends = [root(v) for v in (a, b) if v is not None]
        if len(ends) == 2:
            parent[max(ends)] = min(ends)
    return {node: root(node) for node in parent}


def one_step(edges) -> dict[tuple[int, int], int]:
    groups = defaultdict(list)
    for a, b in edges:
        groups[a].append(b)
        groups[b].append(a)
    out: dict[tuple[int, int], int] = {}
    for node, neighbours in groups.items():
        low = min(neighbours)
        if low < node:
            out.setdefault((node, low), 0)
            for other in neighbours:
                if other != low:
                    out[other, low] = 1
    return out
