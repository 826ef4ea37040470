"""Cycles of graphs against plain loops."""

from __future__ import annotations

import random

from quartzfolio.operators import graph


def core(edges):
    e = {(a, b) for a, b in edges if a is not None and b is not None}
    while True:
        kept = {(a, b) for a, b in e if any(b == x for x, _ in e) and any(a == y for _, y in e)}
        if kept == e:
            return e
        e = kept


def cycles_of(edges):
    step = {}
    for a, b in core(edges):
        step[a] = min(b, step.get(a, b))
    out = set()
    for a in step:
        seen = []
        while a not in seen:
            seen.append(a)
            a = step[a]
        ring = seen[seen.index(a) :]
        i = ring.index(min(ring))
        out.add(tuple(ring[i:] + ring[:i]))
    return out


def got(spark, edges):
    rows = graph.found_cycles(spark.createDataFrame(edges, "src long, dst long")).collect()
    rings = {}
    for r in rows:
        rings.setdefault(r["start"], []).append((r["place"], r["node"], r["length"]))
    assert all({x[2] for x in v} == {len(v)} and [x[0] for x in sorted(v)] == list(range(len(v))) for v in rings.values())
    return {tuple(n for _, n, _ in sorted(v)) for v in rings.values()}


def test_found_cycles(spark):
    rng = random.Random(5)
    long = [(i, i + 1) for i in range(100, 137)] + [(137, 100)]  # a long ring
    tail = [(i, i + 1) for i in range(200, 212)]  # a chain that ends
    hub = [(i, 300) for i in range(301, 380)] + [(300, 301)]  # many that lead to one
    sparse = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)]
    edges = long + tail + hub + sparse + [(50, 100), (212, 100), (400, 400), (400, 401), (None, 3), (3, None), (500, 501), (501, 500), (501, 500)]
    want = cycles_of(edges)
    assert got(spark, edges) == want
    assert tuple(range(100, 138)) in want and (500, 501) in want and (400,) in want


def test_no_cycle_and_no_edge(spark):
    assert got(spark, [(1, 2), (2, 3), (1, 3), (3, 4)]) == set()
    assert got(spark, []) == set()
