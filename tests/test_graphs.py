"""Walks whose rounds must not grow with the length of chains."""

import random

from credence.operators import graphs


def _reached(start, edges):
    seen, todo = set(start), list(start)
    callers = {}
    for a, b in edges:
        callers.setdefault(b, []).append(a)
    while todo:
        for a in callers.get(todo.pop(), ()):
            if a not in seen:
                seen.add(a)
                todo.append(a)
    return seen


def _got(spark, start, edges):
    rows = graphs.reachable(spark.createDataFrame([(n,) for n in start], "node long"), spark.createDataFrame(edges, "caller long, callee long")).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node for r in rows}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    cuts, own = [], graphs._cut
    monkeypatch.setattr(graphs, "_cut", lambda df: cuts.append(1) or own(df))
    n = 300  # a chain that leads to the start, one that leads nowhere, and a ring with a tail
    edges = [(k, k - 1) for k in range(1, n)] + [(1000 + k, 999 + k) for k in range(1, 20)] + [(2000 + k, 2000 + (k + 1) % 7) for k in range(7)] + [(2100, 2003), (2101, 2100)]
    assert _got(spark, [0], edges) == set(range(n))
    assert len(cuts) < 30


def test_random_graphs_with_forks_rings_and_loops(spark):
    rand = random.Random(5)
    for _ in range(3):
        edges = [(rand.randrange(60), rand.randrange(60)) for _ in range(rand.choice((40, 60, 90)))]
        edges += [(100 + k, 99 + k) for k in range(1, 30)] + [(100, 7), (129, 3), (112, 120)] + edges[:5]
        start = rand.sample(range(60), 3)
        assert _got(spark, start, edges) == _reached(start, edges)
