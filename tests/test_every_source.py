"""Searches from every node, on graphs whose sources take several batches and on more edges than the driver's limit was."""

import random
from collections import defaultdict, deque

import numpy as np
import pytest

from loomgraph.algorithms import iterative as I
from loomgraph.algorithms import packed
from loomgraph.algorithms import sequential as S


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(9)
    far = 5_000_000_000
    own = [(far + rng.randrange(150), far + rng.randrange(150), float(rng.randrange(1, 50))) for _ in range(700)] + [(k, k + 1, 1.0) for k in range(40)]
    return own, spark.createDataFrame(own, "src long, dst long, weight double")


def hops(own):
    out = defaultdict(set)
    for a, b, _ in own:
        out[a].add(b)
        out[b]  # noqa: B018
    found = {}
    for s in out:
        depth, queue = {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            for u in out[v] - depth.keys():
                depth[u] = depth[v] + 1
                queue.append(u)
        found |= {(s, v): d for v, d in depth.items()}
    return found


@pytest.fixture(params=["as it is", "narrow"])
def narrow(request, monkeypatch):
    """Tables and steps so small that sources take many batches and heads several steps."""
    if request.param == "narrow":
        monkeypatch.setattr(packed, "STEP", 64)
        monkeypatch.setattr(packed, "words", lambda g, tasks: 1)
        monkeypatch.setattr(packed, "columns", lambda g: 3)


def test_hops_from_every_node(spark, graph, narrow):
    own, e = graph
    want = hops(own)
    assert {(r["source"], r["id"]): r["depth"] for r in packed.reached(e).collect()} == want
    assert {(r["src"], r["dst"]) for r in I.transitive_closure(e).collect()} == set(want)
    sizes = defaultdict(int)
    for (s, _), d in want.items():
        sizes[s, d] += 1
    assert {(r["source"], r["depth"]): r["n"] for r in packed.level_sizes(e).collect()} == sizes
    assert I.diameter(e) == max(hops(own + [(b, a, w) for a, b, w in own]).values())


def test_distances_from_every_node(spark, graph, narrow):
    own, e = graph
    ids, m = S.floyd_warshall(e)
    for negative in (False, True):
        got = {(r["source"], r["id"]): r["distance"] for r in I.all_pairs(e, negative=negative).collect()}
        assert got == {(a, b): m[i, j] for i, a in enumerate(ids) for j, b in enumerate(ids) if m[i, j] < np.inf}
    below = spark.createDataFrame([(1, 2, -4.0), (2, 3, 1.0), (1, 3, 0.0), (3, 4, 2.0)], "src long, dst long, weight double")
    assert {(r["source"], r["id"]): r["distance"] for r in I.all_pairs(below, negative=True).collect()}[1, 4] == -1
    with pytest.raises(I.NegativeWeight):
        I.all_pairs(below)
    with pytest.raises(I.NegativeCycle):
        I.all_pairs(below.union(spark.createDataFrame([(3, 1, 1.0)], below.schema)), negative=True)


def naive_betweenness(own):
    out = defaultdict(list)
    for a, b, _ in own:
        out[a].append(b)
        out[b]  # noqa: B018
    total = dict.fromkeys(out, 0.0)
    for s in out:
        depth, paths, order = {s: 0}, defaultdict(int, {s: 1}), deque([s])
        seen = []
        while order:
            v = order.popleft()
            seen.append(v)
            for u in out[v]:
                if u not in depth:
                    depth[u] = depth[v] + 1
                    order.append(u)
                if depth[u] == depth[v] + 1:
                    paths[u] += paths[v]
        share = defaultdict(float)
        for v in reversed(seen):
            for u in out[v]:
                if depth[u] == depth[v] + 1:
                    share[v] += paths[v] / paths[u] * (1 + share[u])
            if v != s:
                total[v] += share[v]
    return total


def test_betweenness_counts_parallel_edges(spark, graph, narrow):
    own, e = graph
    want = naive_betweenness(own)
    got = {r["id"]: r["betweenness"] for r in S.betweenness(e).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-6 for v in want)
    from pyspark.sql import functions as F

    got = {r["id"]: r["betweenness"] for r in S.betweenness(e.withColumn("weight", F.lit(2.0)), weighted=True).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-6 for v in want)


def test_no_limit_of_edges(spark, graph, monkeypatch):
    own, e = graph
    monkeypatch.setattr(S, "LIMIT", 100)
    assert len(S.betweenness(e).collect()) == len({v for x in own for v in x[:2]})


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long, weight double")
    assert not I.closeness(none).collect() and not I.all_pairs(none).collect() and not S.betweenness(none).collect() and I.diameter(none) == 0


def test_floyd_warshall_beyond_the_matrix(spark):
    star = spark.createDataFrame([(k, -1, float(k % 3)) for k in range(4200)] + [(-1, -2, -5.0)], "src long, dst long, weight double")
    with pytest.raises(S.TooLarge):
        S.floyd_warshall(star)
    got = I.floyd_warshall(star).where("source in (-1, 4199)").collect()
    assert {(r["source"], r["id"]): r["distance"] for r in got} == {(-1, -1): 0, (-1, -2): -5, (4199, 4199): 0, (4199, -1): 2, (4199, -2): -3}
