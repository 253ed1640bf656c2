"""Numbers of links against brute force."""

import itertools
import random
from collections import Counter

import pytest

from loomgraph import iterate
from loomgraph.llm import common, jaccard


def brute(rows, n, num, den):
    sets = []
    for i, text in rows:
        w = text.split()
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    links = Counter()
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and den * len(a & b) >= num * len(a | b):
            links[i] += 1
            links[j] += 1
    return {i: links[i] for i, _ in rows}


@pytest.mark.parametrize(("n", "num", "den", "block"), [(3, 90, 100, 1024), (5, 4, 5, 1024), (3, 4, 5, 7)])
def test_every_link_counts_once(spark, monkeypatch, n, num, den, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(n)
    base = [[rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(3, 160))] for _ in range(6)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice("klmno") + str(rng.randrange(9))
        rows.append((i, " ".join(w)))
    rows += [(200, ""), (202, "a"), (203, "a"), (204, "a b")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.classes(d, n=n, num=num, den=den, links=True).collect()
    want = brute(rows, n, num, den)
    assert {r["id"]: r["n_links"] for r in got} == want and sum(want.values()) > 300 and len(got) == len(rows)
    assert sorted(tuple(r)[:3] for r in got) == sorted(tuple(r) for r in jaccard.classes(d, n=n, num=num, den=den).collect())


@pytest.mark.parametrize(("most", "block"), [(1, 7), (2, 1024), (4, 1024), (16, 1024)])
def test_sparse_and_dense_columns_lose_no_link(spark, monkeypatch, most, block):
    monkeypatch.setattr(jaccard, "MOST", most)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(most)
    base = [[rng.choice("abcdefghij") * rng.randrange(1, 6) for _ in range(rng.randrange(3, 120))] for _ in range(12)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            w[rng.randrange(len(w))] = rng.choice("klmno") + str(rng.randrange(9))
        rows.append((i, " ".join(w + [f"end{k}" for k in range(rng.choice([0, 0, 1, 6]))])))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.classes(d, n=3, num=4, den=5, links=True).collect()
    assert {r["id"]: r["n_links"] for r in got} == brute(rows, 3, 4, 5)
    assert sorted(tuple(r)[:3] for r in got) == sorted(tuple(r) for r in jaccard.classes(d, n=3, num=4, den=5).collect())


def test_texts_that_share_single_passages_are_not_compared(spark, monkeypatch):
    """In a larger corpus nearly every text shares some deciding n-grams, with others each: their sets must not move."""
    asked, stars = [], jaccard.stars
    monkeypatch.setattr(jaccard, "stars", lambda pairs, *a: (asked.append(pairs.count()), stars(pairs, *a))[1])
    rng = random.Random(5)
    pool = [" ".join(f"p{i}w{k}" for k in range(22)) for i in range(1000)]
    rows = [(i, " ".join(rng.sample(pool, 40))) for i in range(200)]
    rows.append((200, rows[7][1] + " more"))
    got = {r["id"]: r["component_id"] for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=9, den=10).collect()}
    assert got == {i: i for i in range(200)} | {200: 7}
    assert 1 <= sum(asked) < 50


def test_full_collections_do_not_follow_one_another(spark):
    """They make the driver's heap grow: ten at once before."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    count = lambda: sum(b.getCollectionCount() for b in beans)
    common.let_go(spark)
    before = count()
    for _ in range(10):
        common.let_go(spark)
    assert count() - before <= 5


@pytest.mark.parametrize(("edges", "cuts"), [([], 1), ([(3, 1), (1, 2), (1, 4), (7, 7), (9, 8), (8, 9)], 1), ([(i, i + 1) for i in range(40)] + [(90, 60), (60, 75)], None)])
def test_components_take_no_round_that_changes_nothing(spark, monkeypatch, edges, cuts):
    made, cut = [], iterate.cut
    monkeypatch.setattr(iterate, "cut", lambda df: (made.append(1), cut(df))[1])
    got = {r["id"]: r["component"] for r in iterate.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {i: i for e in edges for i in e}
    for _ in edges:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert cuts is None or len(made) == cuts
