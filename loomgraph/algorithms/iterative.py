"""Graph algorithms as DataFrame loops.  edges: columns src, dst (and weight); rows of results are live nodes only.

Every round's state is cut by a reliable checkpoint and aggregates combine map-side.  What comes to the driver is counters
and sums, and in topological_levels, k_core, katz and eigenvector vectors of 8 bytes a node (see rounds).
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.algorithms import packed, rounds
from loomgraph.iterate import components, cut


class NegativeWeight(ValueError):
    pass


class NegativeCycle(ValueError):
    pass


class NoPath(ValueError):
    pass


class NotConverged(ValueError):
    pass


class CycleError(ValueError):
    pass


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *cols).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols))


def simple(edges: DataFrame) -> DataFrame:
    """Undirected, without loops and parallels: src < dst."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def bfs(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(source, id, depth): fewest hops from each source (column id)."""
    out = cut(edges.select("src", "dst").distinct())
    seen = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("depth")).distinct())
    level, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = level.join(out, F.col("id") == F.col("src")).select("source", F.col("dst").alias("id"), F.lit(depth).alias("depth")).distinct()
        level = cut(nxt.join(seen, ["source", "id"], "left_anti"))
        if not level.limit(1).count():
            break
        seen = cut(seen.unionByName(level))
    return seen


direction_optimising_bfs = bfs


def bidirectional_bfs(edges: DataFrame, source: int, target: int) -> int | None:
    """Hops of a shortest path, by frontiers grown from both ends, or None."""
    if source == target:
        return 0
    spark = edges.sparkSession
    ahead = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    sides = [(spark.createDataFrame([(source,)], "id bigint"), ahead), (spark.createDataFrame([(target,)], "id bigint"), ahead.select(F.col("b").alias("a"), F.col("a").alias("b")))]
    seen = [s[0] for s in sides]
    level = [s[0] for s in sides]
    hops = 0
    while True:
        k = 0 if level[0].count() <= level[1].count() else 1
        nxt = level[k].join(sides[k][1], F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        level[k] = cut(nxt.join(seen[k], "id", "left_anti"))
        hops += 1
        if not level[k].limit(1).count():
            return None
        if level[k].join(seen[1 - k], "id", "left_semi").limit(1).count():
            return hops
        seen[k] = cut(seen[k].union(level[k]))


def checked(edges: DataFrame, negative: bool) -> tuple[DataFrame, bool]:
    """The edges, and whether a weight is below zero."""
    bad = edges.agg(F.max(F.isnan("weight") | F.abs("weight").isin(float("inf"))).alias("nan"), F.min("weight").alias("least")).first()
    if bad["nan"] or not negative and bad["least"] is not None and bad["least"] < 0:
        raise NegativeWeight("weights must be finite and, without negative=True, not below zero")
    return edges, (bad["least"] or 0) < 0


def shortest_distances(edges: DataFrame, sources: DataFrame, *, negative: bool = False, max_rounds: int = 100_000) -> DataFrame:
    """(source, id, distance): least weight sums by rounds of relaxation; only improved nodes relax further."""
    edges, _ = checked(edges, negative)
    out = cut(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    known = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance")).distinct())
    level, limit = known, vertices(out).count() + 1
    for k in range(max_rounds):
        step = level.join(out, F.col("id") == F.col("src")).groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("nearer"))
        better = cut(step.join(known, ["source", "id"], "left").where(F.col("distance").isNull() | (F.col("nearer") < F.col("distance"))).select("source", "id", F.col("nearer").alias("distance")))
        if not better.limit(1).count():
            return known
        if negative and k >= limit:
            raise NegativeCycle("a negative cycle can be reached")
        known = cut(known.unionByName(better).groupBy("source", "id").agg(F.min("distance").alias("distance")))
        level = better
    return known


def dijkstra(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return shortest_distances(edges, sources)


def bellman_ford(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return shortest_distances(edges, sources, negative=True)


def all_pairs(edges: DataFrame, *, negative: bool = False) -> DataFrame:
    """(source, id, distance) from every node, in tasks that each hold the packed graph and a share of the sources."""
    edges, below = checked(edges, negative)
    found = packed.distances(edges, below)
    if not below:
        return found
    try:
        return cut(found)
    except PythonException as e:
        if "negative cycle" in str(e):
            raise NegativeCycle("the graph has a negative cycle") from None
        raise


class _Routes:
    """(id, distance, prev) known from one node, grown by rounds of relaxation that let go what the caller's bound excludes."""

    def __init__(self, out: DataFrame, start: int):
        self.out = out
        self.known = self.level = cut(out.sparkSession.createDataFrame([(start, 0.0, None)], "id bigint, distance double, prev bigint"))
        self.going = True

    def grow(self, worth) -> None:
        """Nodes of the last round for which worth(distance, id) holds relax their edges."""
        on = self.level.where(worth(F.col("distance"), F.col("id"))).select(F.col("id").alias("src"), "distance")
        best = F.min(F.struct((F.col("distance") + F.col("weight")).alias("distance"), F.col("src").alias("prev"))).alias("m")
        step = on.join(self.out, "src").groupBy(F.col("dst").alias("id")).agg(best).select("id", "m.*")
        had = self.known.select("id", F.col("distance").alias("had"))
        self.level = cut(step.join(had, "id", "left").where("had is null or distance < had").drop("had"))
        self.going = bool(self.level.limit(1).count())
        if self.going:
            self.known = cut(self.known.unionByName(self.level).groupBy("id").agg(F.min(F.struct("distance", "prev")).alias("m")).select("id", "m.*"))

    def back(self, node: int) -> list:
        """Nodes from this one to the start."""
        path = [node]
        while (prev := self.known.where(F.col("id") == path[-1]).first()["prev"]) is not None:
            path.append(prev)
        return path


def a_star(edges: DataFrame, source: int, target: int, heuristic=None) -> tuple[float, list]:
    """(cost, path) by rounds of relaxation; a node goes on only while its distance and heuristic stay below the best cost
    known at the target.  The heuristic must not overestimate."""
    edges, _ = checked(edges, False)
    routes, best = _Routes(cut(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))), source), float("inf")
    rest = (lambda v: F.lit(0.0)) if heuristic is None else F.udf(lambda v: float(heuristic(v)), "double")
    while routes.going:
        routes.grow(lambda d, v: d + rest(v) < F.lit(best))  # noqa: B023
        if at := routes.known.where(F.col("id") == target).first():
            best = at["distance"]
    if best == float("inf"):
        raise NoPath(f"{target} can't be reached")
    return best, routes.back(target)[::-1]


def bidirectional_dijkstra(edges: DataFrame, source: int, target: int) -> tuple[float, list]:
    """(cost, path) by relaxation from both ends; each goes on from nodes no further than half the best cost known, as one
    of a path's edges has both its ends that near."""
    edges, _ = checked(edges, False)
    out = cut(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    ahead, behind = _Routes(out, source), _Routes(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), target)
    best, middle = float("inf"), None
    while ahead.going or behind.going:
        for side in (ahead, behind):
            if side.going:
                side.grow(lambda d, v: d <= F.lit(best / 2))  # noqa: B023
        both = ahead.known.select("id", F.col("distance").alias("a")).join(behind.known.select("id", F.col("distance").alias("b")), "id")
        met = both.agg(F.min(F.struct((F.col("a") + F.col("b")).alias("cost"), "id")).alias("m")).first()["m"]
        if met is not None:
            best, middle = met["cost"], met["id"]
    if middle is None:
        raise NoPath(f"{target} can't be reached")
    return best, ahead.back(middle)[::-1] + behind.back(middle)[1:]


def floyd_warshall(edges: DataFrame) -> DataFrame:
    """(source, id, distance), negative weights allowed: on graphs of any size the matrix's rows are relaxed in blocks of
    sources; sequential.floyd_warshall gives the matrix itself, up to 4000 nodes."""
    return all_pairs(edges, negative=True)


def transitive_closure(edges: DataFrame) -> DataFrame:
    """(src, dst) with every node reaching itself."""
    return packed.reached(edges).select(F.col("source").alias("src"), F.col("id").alias("dst"))


def weakly_connected_components(edges: DataFrame) -> DataFrame:
    return components(edges.select("src", "dst").union(edges.select("src", F.col("src").alias("dst"))))


def strongly_connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): least id of the component, by forward colouring and backward search among equal colours."""
    left = cut(edges.select("src", "dst").distinct())
    nodes = cut(vertices(left))
    done = None
    while nodes.limit(1).count():
        colour = cut(nodes.select("id", F.col("id").alias("c")))
        while True:
            step = colour.join(left, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "c").unionByName(colour).groupBy("id").agg(F.min("c").alias("c"))
            step = cut(step)
            if step.join(colour, ["id", "c"], "left_anti").limit(1).count() == 0:
                break
            colour = step
        inside = left.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst", "cs")
        inside = cut(inside)
        found = level = cut(colour.where("id = c"))
        while level.limit(1).count():
            nxt = level.join(inside, (F.col("id") == F.col("dst")) & (F.col("c") == F.col("cs"))).select(F.col("src").alias("id"), "c").distinct()
            level = cut(nxt.join(found, "id", "left_anti"))
            found = cut(found.unionByName(level))
        part = found.select("id", F.col("c").alias("component"))
        done = part if done is None else cut(done.unionByName(part))
        nodes = cut(nodes.join(found, "id", "left_anti"))
        left = cut(left.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return done


def topological_levels(edges: DataFrame) -> DataFrame:
    """(id, level): the longest way from a node without incoming edges; ordering by level, id is a topological order.

    Each round a block of nodes gives levels to all of its own that what is known, or it finds itself, allows."""
    edges = cut(edges.select("src", "dst", F.lit(1.0).alias("weight")).distinct())
    r = rounds.Rounds(edges, vertices(edges))
    into, _ = r.step(lambda heads, *_: (heads, heads))
    level = np.zeros(len(r.ids))
    level[into] = -1
    while (level < 0).any():
        at, found = r.step(rounds.freed, level)
        if not len(at):
            raise CycleError("the graph has a cycle")
        level[at] = found
    return r.frame("level", level.astype(np.int32))


def k_core(edges: DataFrame) -> DataFrame:
    """(id, coreness), loops and parallel edges don't count: from the degrees down, each node takes the h-index of its
    neighbours' values until none moves; a block of nodes settles by itself before it tells the others."""
    edges = cut(edges.select("src", "dst").distinct())
    r = rounds.Rounds(both_ways(simple(edges)).withColumn("weight", F.lit(1.0)), vertices(edges))
    at, degree = r.step(lambda heads, starts, tails, *_: (heads, np.diff(np.r_[starts, len(tails)])))
    core, moved = np.zeros(len(r.ids)), np.zeros(len(r.ids), bool)
    core[at], moved[at] = degree, True
    while moved.any():
        at, found = r.step(rounds.h_index, core, moved)
        moved[:] = False
        moved[at], core[at] = True, found
    return r.frame("coreness", core.astype(np.int64))


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles) of nodes that have any, in tasks that each hold the packed graph and a share of the nodes."""
    return packed.triangles(cut(simple(edges)))


def pagerank(edges: DataFrame, *, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6, source: int | None = None) -> DataFrame:
    """(id, rank), summing to 1; dangling mass goes to all nodes, or with ``source`` (personalised) back to it."""
    nodes = cut(vertices(edges))
    n = nodes.count()
    out = cut(edges.join(edges.groupBy("src").count(), "src").groupBy("src", "dst").agg((F.count(F.lit(1)) / F.max("count")).alias("share")))
    start = F.lit(1.0 / n) if source is None else (F.col("id") == source).cast("double")
    rank = cut(nodes.withColumn("rank", start))
    sinks = cut(nodes.join(out.select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
    for _ in range(max_iter):
        lost = rank.join(sinks, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = rank.join(out, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        base = F.lit((1 - damping + damping * lost) / n) if source is None else F.when(F.col("id") == source, 1 - damping + damping * lost).otherwise(0.0)
        nxt = cut(rank.join(got, F.col("id") == F.col("dst"), "left").select("id", F.col("rank").alias("was"), (base + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
        moved = nxt.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
        rank = nxt.select("id", "rank")
        if moved is None or moved < tol:
            break
    return rank


def personalized_pagerank(edges: DataFrame, source: int, *, alpha: float = 0.85, eps: float = 1e-6) -> DataFrame:
    return pagerank(edges, damping=alpha, tol=eps, source=source)


def _power(edges: DataFrame, step, max_iter: int, tol: float, what: str) -> DataFrame:
    into = cut(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")))
    r = rounds.Rounds(into, vertices(into))
    x = np.full(len(r.ids), 1.0 / max(1, len(r.ids)) ** 0.5)
    for _ in range(max_iter):
        at, sums = r.step(rounds.times, x)
        got = np.zeros(len(x))
        got[at] = sums
        raw = step(x, got)
        norm = float(np.sqrt(raw @ raw)) if what == "eigenvector" else 1.0
        moved = np.abs(raw / norm - x).sum() if len(x) else 0.0
        x = raw / norm
        if moved < tol:
            return r.frame("score", x / np.sqrt(x @ x) if what == "katz" and len(x) else x)
    raise NotConverged(f"{what} has not converged in {max_iter} rounds")


def eigenvector(edges: DataFrame, *, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """(id, score): x <- x + A'x with unit length."""
    return _power(edges, lambda x, got: x + got, max_iter, tol, "eigenvector")


def katz(edges: DataFrame, *, alpha: float | None = None, beta: float = 1.0, max_iter: int = 1000, tol: float = 1e-6) -> DataFrame:
    if alpha is None:
        most = edges.groupBy("dst").count().agg(F.max("count")).first()[0] or 0
        alpha = 0.85 / (1 + most)
    return _power(edges, lambda x, got: alpha * got + beta, max_iter, tol, "katz")


def closeness(edges: DataFrame) -> DataFrame:
    """(id, closeness) over out-edges: (r / (n-1)) * (r / sum of distances), r reached nodes."""
    nodes = vertices(edges)
    n = nodes.count()
    d = packed.level_sizes(edges).where("depth > 0").groupBy(F.col("source").alias("id")).agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("depth")).alias("s"))
    return nodes.join(d, "id", "left").select("id", F.coalesce(F.col("r") / F.lit(max(1, n - 1)) * (F.col("r") / F.col("s")), F.lit(0.0)).alias("closeness"))


def harmonic(edges: DataFrame) -> DataFrame:
    nodes = vertices(edges)
    n = nodes.count()
    d = packed.level_sizes(edges).where("depth > 0").groupBy(F.col("source").alias("id")).agg(F.sum(F.col("n") / F.col("depth")).alias("s"))
    return nodes.join(d, "id", "left").select("id", F.coalesce(F.col("s") / F.lit(max(1, n - 1)), F.lit(0.0)).alias("harmonic"))


def diameter(edges: DataFrame) -> int:
    return packed.level_sizes(both_ways(edges)).agg(F.max("depth")).first()[0] or 0


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) by Boruvka: each component's lightest leaving edge, ties by ends; loops never count."""
    e = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    forest = e.where("false")
    comp = cut(vertices(e).select("id", F.col("id").alias("c")))
    while True:
        across = e.join(comp.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(comp.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs <> cd")
        across = cut(across)
        if not across.limit(1).count():
            return forest
        key = F.struct("weight", "src", "dst")
        best = across.select(F.col("cs").alias("c"), key.alias("k")).union(across.select("cd", key)).groupBy("c").agg(F.min("k").alias("k"))
        forest = cut(forest.unionByName(best.select("k.src", "k.dst", "k.weight")).distinct())
        comp = weakly_connected_components(forest.select("src", "dst")).select("id", F.col("component").alias("c"))
        alone = vertices(e).join(comp, "id", "left_anti").select("id", F.col("id").alias("c"))
        comp = cut(comp.unionByName(alone))


def euler_degrees(edges: DataFrame, *, directed: bool = True) -> dict:
    """Degree conditions of an Euler trail: counts of nodes by their imbalance."""
    if directed:
        d = degrees(edges).select((F.col("out_degree") - F.col("in_degree")).alias("d"))
        return {r["d"]: r["count"] for r in d.groupBy("d").count().collect()}
    d = both_ways(edges).groupBy("src").count().select((F.col("count") % 2).alias("d"))
    return {r["d"]: r["count"] for r in d.groupBy("d").count().collect()}
