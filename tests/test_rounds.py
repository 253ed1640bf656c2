"""Rounds over packed edges: few of them where peeling took many, and nothing of the edges shuffled again."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from loomgraph.algorithms import iterative as I
from loomgraph.algorithms import rounds


@pytest.fixture
def steps(monkeypatch):
    taken, step = [], rounds.Rounds.step
    monkeypatch.setattr(rounds.Rounds, "step", lambda *a: taken.append(1) or step(*a))
    return taken


@pytest.fixture(scope="module")
def own():
    rng = random.Random(3)
    return [(rng.randrange(90), rng.randrange(90)) for _ in range(900)] + [(7_000_000_000 + k, 7_000_000_001 + k) for k in range(200)] + [(500, 500)]


def test_levels_of_a_long_chain_take_few_rounds(spark, own, steps):
    dag = [(a, b) for a, b in own if a < b] + [(3, 7_000_000_000)]
    level = defaultdict(int)
    for a, b in sorted(dag):
        level[b] = max(level[b], level[a] + 1)
    got = I.topological_levels(spark.createDataFrame(dag, "src long, dst long"))
    assert {r["id"]: r["level"] for r in got.collect()} == level and max(level.values()) > 200
    assert len(steps) < 10
    assert got.schema["level"].dataType.simpleString() == "int"
    with pytest.raises(I.CycleError):
        I.topological_levels(spark.createDataFrame([*dag, (7_000_000_009, 7_000_000_001)], "src long, dst long"))


def test_cores_against_peeling(spark, own, steps):
    near = defaultdict(set)
    for a, b in own:
        near[a], near[b]  # noqa: B018
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want, left, k = {}, {v: set(x) for v, x in near.items()}, 0
    while left:
        thin = [v for v in left if len(left[v]) <= k]
        k += not thin
        for v in thin:
            want[v] = k
            for u in left.pop(v):
                left[u].discard(v)
    assert {r["id"]: r["coreness"] for r in I.k_core(spark.createDataFrame(own, "src long, dst long")).collect()} == want
    assert max(want.values()) > 10


def test_triangles_of_each_node(spark, own):
    und = {frozenset(x) for x in own if x[0] != x[1]}
    tri = [t for t in combinations(range(90), 3) if all(frozenset(p) in und for p in combinations(t, 2))]
    got = I.triangles(spark.createDataFrame(own, "src long, dst long"))
    assert {r["id"]: r["triangles"] for r in got.collect()} == Counter(v for t in tri for v in t) and len(tri) > 100


def test_power_rounds_count_parallel_edges(spark, own):
    few = [x for x in own if x[0] < 90] * 2
    ids = sorted({v for x in few for v in x})
    at = {v: i for i, v in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for a, b in few:
        m[at[b], at[a]] += 1
    e = spark.createDataFrame(few, "src long, dst long")
    alpha = 0.85 / (1 + m.sum(axis=1).max())
    want = np.linalg.solve(np.eye(len(ids)) - alpha * m, np.ones(len(ids)))
    got = {r["id"]: r["score"] for r in I.katz(e, tol=1e-12).collect()}
    assert max(abs(got[v] - want[at[v]] / np.linalg.norm(want)) for v in ids) < 1e-9
    x = np.full(len(ids), 1.0)
    for _ in range(300):
        x = x + m @ x
        x /= np.linalg.norm(x)
    got = {r["id"]: r["score"] for r in I.eigenvector(e, tol=1e-12).collect()}
    assert max(abs(got[v] - x[at[v]]) for v in ids) < 1e-8
