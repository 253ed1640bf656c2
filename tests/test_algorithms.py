"""Algorithms against naive references on small graphs, by invariant."""

import itertools
import random

import numpy as np
import pytest

from loomgraph.algorithms import iterative as I
from loomgraph.algorithms import sequential as S


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(4)
    own = sorted({(rng.randrange(14), rng.randrange(14), float(rng.randrange(1, 9))) for _ in range(26)})
    return own, spark.createDataFrame(own, "src long, dst long, weight double")


def nodes(own):
    return sorted({v for e in own for v in e[:2]})


def floyd(own):
    ids = nodes(own)
    d = {(a, b): 0.0 if a == b else float("inf") for a in ids for b in ids}
    for a, b, w in own:
        d[a, b] = min(d[a, b], w)
    for k, a, b in itertools.product(ids, ids, ids):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return d


def test_distances(spark, graph):
    own, e = graph
    d = floyd(own)
    s = spark.createDataFrame([(own[0][0],)], "id long")
    want = {b: x for (a, b), x in d.items() if a == own[0][0] and x < float("inf")}
    assert {r["id"]: r["distance"] for r in I.dijkstra(e, s).collect()} == want
    assert {r["id"]: r["distance"] for r in I.bellman_ford(e, s).collect()} == want
    ids, m = S.floyd_warshall(e)
    assert all(m[i, j] == d[a, b] for i, a in enumerate(ids) for j, b in enumerate(ids))
    far = max(want, key=want.get)
    assert S.a_star(e, own[0][0], far)[0] == want[far]
    costs = [c for c, _ in S.yen(e, own[0][0], far, 4)]
    assert costs == sorted(costs) and costs[0] == want[far]


def test_negative_weights(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, -3.0), (3, 1, 1.0)], "src long, dst long, weight double")
    s = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(I.NegativeWeight):
        I.dijkstra(e, s)
    with pytest.raises(I.NegativeCycle):
        I.bellman_ford(e, s)


def test_components_and_closure(spark, graph):
    own, e = graph
    d = floyd(own)
    reach = {k for k, x in d.items() if x < float("inf")}
    assert {(r["src"], r["dst"]) for r in I.transitive_closure(e).collect()} == reach
    scc = {r["id"]: r["component"] for r in I.strongly_connected_components(e).collect()}
    assert all((scc[a] == scc[b]) == ((a, b) in reach and (b, a) in reach) for a, b in itertools.product(nodes(own), repeat=2))
    wcc = {r["id"]: r["component"] for r in I.weakly_connected_components(e).collect()}
    assert all(wcc[a] == wcc[b] for a, b, _ in own) and all(min(v for v in wcc if wcc[v] == c) == c for c in wcc.values())


def test_cores_triangles_topology(spark, graph):
    own, e = graph
    und = {frozenset(x[:2]) for x in own if x[0] != x[1]}
    tri = [t for t in itertools.combinations(nodes(own), 3) if all(frozenset(p) in und for p in itertools.combinations(t, 2))]
    assert sum(r["triangles"] for r in I.triangles(e).collect()) == 3 * len(tri)
    core = {r["id"]: r["coreness"] for r in I.k_core(e).collect()}
    for k in range(1, max(core.values()) + 1):
        keep = {v for v in core if core[v] >= k}
        assert all(sum(len(x & keep) == 2 and v in x for x in und) >= k for v in keep)
    dag = spark.createDataFrame([(1, 2), (1, 3), (3, 2), (2, 4)], "src long, dst long")
    level = {r["id"]: r["level"] for r in I.topological_levels(dag).collect()}
    assert level == {1: 0, 3: 1, 2: 2, 4: 3}
    with pytest.raises(I.CycleError):
        I.topological_levels(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))


def test_centrality(spark, graph):
    own, e = graph
    ids = nodes(own)
    at = {v: i for i, v in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for a, b, _ in own:
        m[at[a], at[b]] += 1
    x = np.full(len(ids), 1 / len(ids))
    out = m.sum(axis=1)
    for _ in range(200):
        share = np.where(out[:, None] > 0, m / np.maximum(out, 1)[:, None], 0)
        x = 0.15 / len(ids) + 0.85 * (x @ share + x[out == 0].sum() / len(ids))
    got = {r["id"]: r["rank"] for r in I.pagerank(e, tol=1e-9).collect()}
    assert max(abs(got[v] - x[at[v]]) for v in ids) < 1e-6 and abs(sum(got.values()) - 1) < 1e-9
    assert set(r["id"] for r in S.betweenness(e).collect()) == set(ids)
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    assert {r["id"]: r["betweenness"] for r in S.betweenness(path).collect()} == {1: 0, 2: 2, 3: 2, 4: 0}
    assert {r["id"]: round(r["harmonic"], 6) for r in I.harmonic(path).collect()}[1] == round((1 + 1 / 2 + 1 / 3) / 3, 6)


def test_trees_cuts_flows(spark, graph):
    own, e = graph
    light = sorted((w, a, b) for a, b, w in own if a != b)
    parent = {v: v for v in nodes(own)}

    def root(v):
        return v if parent[v] == v else root(parent[v])

    total = 0
    for w, a, b in light:
        if root(a) != root(b):
            parent[root(a)] = root(b)
            total += w
    assert sum(r["weight"] for r in I.minimum_spanning_forest(e).collect()) == total
    caps = spark.createDataFrame([(0, 1, 3, 1), (0, 2, 2, 2), (1, 2, 5, 1), (1, 3, 2, 3), (2, 3, 3, 1)], "src long, dst long, capacity long, cost long")
    assert S.max_flow(caps, 0, 3) == 5
    assert S.min_cost_flow(caps, 0, 3) == (5, 17)
    two = spark.createDataFrame([(1, 2, 3.0), (2, 3, 3.0), (1, 3, 3.0), (4, 5, 3.0), (5, 6, 3.0), (4, 6, 3.0), (3, 4, 1.0)], "src long, dst long, weight double")
    assert S.stoer_wagner(two) == 1.0
    assert S.biconnected(two)["bridges"] == [(3, 4)] and S.biconnected(two)["articulation"] == [3, 4]
    assert len(set(S.leiden(two).values())) == 2


def test_matching_assignment_trails(spark):
    b = spark.createDataFrame([(1, 11), (1, 12), (2, 11), (3, 12), (3, 13)], "src long, dst long")
    assert len(S.hopcroft_karp(b)) == 3
    rng = np.random.default_rng(2)
    c = rng.integers(1, 20, (4, 5)).astype(float)
    best = min(sum(c[i, p[i]] for i in range(4)) for p in itertools.permutations(range(5), 4))
    total, pick = S.hungarian(c)
    assert total == best and len(set(pick)) == 4
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4)], "src long, dst long")
    assert len(S.euler_trail(e)) == 5
    with pytest.raises(ValueError):
        S.euler_trail(spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long"))
    assert I.bidirectional_bfs(e, 2, 4) == 3 and I.bidirectional_bfs(e, 4, 1) is None


def test_routes_without_a_limit_of_edges(spark, graph, monkeypatch):
    own, e = graph
    monkeypatch.setattr(S, "LIMIT", 3)
    d, light = floyd(own), {}
    for a, b, w in own:
        light[a, b] = min(w, light.get((a, b), w))
    source = own[0][0]
    far = max((b for b in nodes(own) if d[source, b] < float("inf")), key=lambda b: d[source, b])
    for search in (S.a_star, S.bidirectional_dijkstra, lambda *x: S.a_star(*x, heuristic=lambda v: d[v, far] / 2 if d[v, far] < 1e9 else 1e9)):
        cost, path = search(e, source, far)
        assert cost == d[source, far] == sum(light[x] for x in itertools.pairwise(path)) and (path[0], path[-1]) == (source, far)
        assert search(e, source, source) == (0, [source])
        with pytest.raises(S.NoPath):
            search(e, source, -1)
