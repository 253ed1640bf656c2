"""Registered queries of graph algorithms, sources and sinks over whole tables, and the SQL that must agree with them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph import sources
from loomgraph.algorithms import iterative, sequential
from loomgraph.graph import PropertyGraph, tables_graph
from loomgraph.iterate import checkpoint_dir


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user to the next one by event id in the hour of a type, weighted from 1 to 97."""
    w = Window.partitionBy("event_type", F.to_date("ts"), F.hour("ts")).orderBy("event_id")
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"), (F.col("event_id") % 97 + 1).cast("double").alias("weight")).where("dst is not null and src <> dst")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions to nations to customers: a forest, its labels apart by millions."""
    n = _t(spark, sf_dir, "nation").select((F.col("n_regionkey") + 2_000_000_000).cast("long").alias("src"), (F.col("n_nationkey") + 1_000_000_000).cast("long").alias("dst"))
    return n.union(_t(spark, sf_dir, "customer").select((F.col("c_nationkey") + 1_000_000_000).cast("long"), F.col("c_custkey").cast("long")))


def _ids(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id bigint")


E_ = "e AS (SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type, ts::DATE, hour(ts) ORDER BY event_id) AS dst, (event_id % 97 + 1)::DOUBLE AS weight FROM events) WHERE dst IS NOT NULL AND src <> dst), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), d AS (SELECT src, dst, min(weight) AS weight FROM e GROUP BY 1, 2)"
P_ = "p AS (SELECT n_regionkey + 2000000000 AS src, n_nationkey + 1000000000 AS dst FROM nation UNION ALL SELECT c_nationkey + 1000000000, c_custkey FROM customer)"
#: Levels of a search from all users at once; a shortest path has fewer hops than ROUNDS in these tables.
ROUNDS = 40
HOPS = f"h(s, id, k) AS (SELECT id, id, 0 FROM v UNION SELECT h.s, d.dst, h.k + 1 FROM h JOIN d ON d.src = h.id WHERE h.k < (SELECT least({ROUNDS}, count(*)) FROM v)), a AS (SELECT s, id, min(k) AS k FROM h GROUP BY 1, 2)"
#: Distances by rounds of relaxation from all sources in s0.
RELAX = f"r(k, s, id, x) AS (SELECT 0, id, id, 0::DOUBLE FROM s0 UNION ALL SELECT k + 1, s, id, min(x) FROM (SELECT r.k, r.s, d.dst AS id, r.x + d.weight AS x FROM r JOIN d ON d.src = r.id UNION ALL SELECT k, s, id, x FROM r) WHERE k < {ROUNDS} GROUP BY k, s, id)"


def bfs_levels(spark, sf_dir):
    return iterative.bfs(user_edges(spark, sf_dir), _ids(spark, 0)).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def sssp(spark, sf_dir):
    return iterative.dijkstra(user_edges(spark, sf_dir), _ids(spark, 0)).select("id", "distance")


def bellman_ford(spark, sf_dir):
    return iterative.bellman_ford(user_edges(spark, sf_dir), _ids(spark, 0, 7)).select("source", "id", "distance")


def _rows_of(d: DataFrame) -> DataFrame:
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("total"), F.max("distance").alias("far"))


def all_pairs(spark, sf_dir):
    return _rows_of(iterative.all_pairs(user_edges(spark, sf_dir)))


def floyd_warshall(spark, sf_dir):
    return _rows_of(iterative.floyd_warshall(user_edges(spark, sf_dir)))


def a_star(spark, sf_dir):
    return spark.createDataFrame([(float(iterative.a_star(user_edges(spark, sf_dir), 0, 5)[0]),)], "cost double")


def bidirectional_dijkstra(spark, sf_dir):
    return spark.createDataFrame([(float(iterative.bidirectional_dijkstra(user_edges(spark, sf_dir), 0, 5)[0]),)], "cost double")


def bidirectional_bfs(spark, sf_dir):
    return spark.createDataFrame([(iterative.bidirectional_bfs(user_edges(spark, sf_dir), 0, 5),)], "hops int")


def transitive_closure(spark, sf_dir):
    return iterative.transitive_closure(user_edges(spark, sf_dir)).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


def scc(spark, sf_dir):
    return iterative.strongly_connected_components(user_edges(spark, sf_dir))


def topological_levels(spark, sf_dir):
    return iterative.topological_levels(user_edges(spark, sf_dir).where("src < dst"))


def k_core(spark, sf_dir):
    return iterative.k_core(user_edges(spark, sf_dir))


def triangles(spark, sf_dir):
    return iterative.triangles(user_edges(spark, sf_dir))


def pagerank(spark, sf_dir):
    return iterative.pagerank(user_edges(spark, sf_dir), max_iter=20, tol=0.0).select("id", F.round("rank", 9).alias("rank"))


def personalized_pagerank(spark, sf_dir):
    return iterative.pagerank(user_edges(spark, sf_dir), max_iter=20, tol=0.0, source=0).select("id", F.round("rank", 9).alias("rank"))


def katz(spark, sf_dir):
    return iterative.katz(user_edges(spark, sf_dir), tol=1e-9).select("id", F.round("score", 5).alias("score"))


def eigenvector(spark, sf_dir):
    return iterative.eigenvector(user_edges(spark, sf_dir), tol=1e-9).select("id", F.round("score", 5).alias("score"))


def closeness(spark, sf_dir):
    return iterative.closeness(user_edges(spark, sf_dir)).select("id", F.round("closeness", 9).alias("closeness"))


def harmonic(spark, sf_dir):
    return iterative.harmonic(user_edges(spark, sf_dir)).select("id", F.round("harmonic", 9).alias("harmonic"))


def betweenness(spark, sf_dir):
    return sequential.betweenness(user_edges(spark, sf_dir).select("src", "dst").distinct()).select("id", F.round("betweenness", 5).alias("betweenness"))


def diameter(spark, sf_dir):
    return spark.createDataFrame([(iterative.diameter(user_edges(spark, sf_dir)),)], "hops int")


def mst_total(spark, sf_dir):
    return iterative.minimum_spanning_forest(user_edges(spark, sf_dir)).agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))


def bridges(spark, sf_dir):
    found = sequential.biconnected(places(spark, sf_dir))
    return spark.createDataFrame([(int(a), int(b)) for a, b in found["bridges"]], "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def articulation_points(spark, sf_dir):
    return spark.createDataFrame([(int(x),) for x in sequential.biconnected(places(spark, sf_dir))["articulation"]], "id bigint")


def max_matching(spark, sf_dir):
    edges = _t(spark, sf_dir, "customer").select((F.col("c_nationkey") + 1_000_000_000).cast("long").alias("src"), F.col("c_custkey").alias("dst"))
    return spark.createDataFrame([(len(sequential.hopcroft_karp(edges)),)], "n bigint")


def _network(spark, sf_dir) -> DataFrame:
    """A source to nations by their customers, nations to a sink by their suppliers; an unit's cost is the nation's key."""
    count = lambda name, key: _t(spark, sf_dir, name).groupBy(F.col(key).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("capacity"))
    return count("customer", "c_nationkey").select(F.lit(-1).cast("long").alias("src"), F.col("k").alias("dst"), "capacity", F.col("k").alias("cost")).union(count("supplier", "s_nationkey").select("k", F.lit(-2).cast("long"), "capacity", F.lit(0).cast("long")))


def max_flow(spark, sf_dir):
    return spark.createDataFrame([(int(sequential.max_flow(_network(spark, sf_dir), -1, -2)),)], "flow bigint")


def min_cost_flow(spark, sf_dir):
    flow, cost = sequential.min_cost_flow(_network(spark, sf_dir), -1, -2)
    return spark.createDataFrame([(int(flow), float(cost))], "flow bigint, cost double")


def csv_round_trip(spark, sf_dir):
    path = f"{checkpoint_dir(spark)}/edges-{uuid.uuid4().hex}"
    sources.write_edge_csv(user_edges(spark, sf_dir), path)
    return sources.read_edge_csv(spark, path).groupBy(F.col("src").cast("long").alias("src")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("weight").cast("double")).alias("weight"))


def jsonl_round_trip(spark, sf_dir):
    path = f"{checkpoint_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    g = PropertyGraph(spark).with_nodes("Customer", _t(spark, sf_dir, "customer"), "c_custkey").with_nodes("Nation", _t(spark, sf_dir, "nation"), "n_nationkey")
    sources.write_jsonl(g.with_rels("CUST_NATION", _t(spark, sf_dir, "customer"), ("Customer", "c_custkey"), ("Nation", "c_nationkey"), key="c_custkey"), path)
    got = sources.read_jsonl(spark, path)
    values = got["properties"].where("key = 'c_acctbal'").select("id", sources.typed_value("float64", F.col("value")).alias("bal"))
    return got["edges"].join(values, F.col("src") == F.col("id")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("bal")).alias("bal"))


def snapshot_round_trip(spark, sf_dir):
    path = f"{checkpoint_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    sources.write_snapshot(tables_graph(spark, sf_dir), path)
    return sources.read_snapshot(spark, path).cypher("MATCH (c:Customer)-[:CUST_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, count(c) AS n")


QUERIES = {
    "bfs_levels": (bfs_levels, f"WITH RECURSIVE {E_}, {HOPS} SELECT k AS depth, count(*) AS n FROM a WHERE s = 0 GROUP BY 1"),
    "sssp": (sssp, f"WITH RECURSIVE {E_}, s0 AS (SELECT 0::BIGINT AS id), {RELAX} SELECT id, min(x) AS distance FROM r GROUP BY 1"),
    "bellman_ford": (bellman_ford, f"WITH RECURSIVE {E_}, s0 AS (SELECT 0::BIGINT AS id UNION ALL SELECT 7), {RELAX} SELECT s AS source, id, min(x) AS distance FROM r GROUP BY 1, 2"),
    "all_pairs": (all_pairs, f"WITH RECURSIVE {E_}, s0 AS (SELECT id FROM v), {RELAX}, m AS (SELECT s, id, min(x) AS x FROM r GROUP BY 1, 2) SELECT s AS source, count(*) AS n, sum(x) AS total, max(x) AS far FROM m GROUP BY 1"),
    "floyd_warshall": (floyd_warshall, f"WITH RECURSIVE {E_}, s0 AS (SELECT id FROM v), {RELAX}, m AS (SELECT s, id, min(x) AS x FROM r GROUP BY 1, 2) SELECT s AS source, count(*) AS n, sum(x) AS total, max(x) AS far FROM m GROUP BY 1"),
    "a_star": (a_star, f"WITH RECURSIVE {E_}, s0 AS (SELECT 0::BIGINT AS id), {RELAX} SELECT min(x) AS cost FROM r WHERE id = 5"),
    "bidirectional_dijkstra": (bidirectional_dijkstra, f"WITH RECURSIVE {E_}, s0 AS (SELECT 0::BIGINT AS id), {RELAX} SELECT min(x) AS cost FROM r WHERE id = 5"),
    "bidirectional_bfs": (bidirectional_bfs, f"WITH RECURSIVE {E_}, {HOPS} SELECT k AS hops FROM a WHERE s = 0 AND id = 5"),
    "transitive_closure": (transitive_closure, f"WITH RECURSIVE {E_}, c(s, id) AS (SELECT id, id FROM v UNION SELECT c.s, d.dst FROM c JOIN d ON d.src = c.id) SELECT s AS src, count(*) AS n FROM c GROUP BY 1"),
    "scc": (scc, f"WITH RECURSIVE {E_}, c(s, id) AS (SELECT id, id FROM v UNION SELECT c.s, d.dst FROM c JOIN d ON d.src = c.id) SELECT x.s AS id, min(x.id) AS component FROM c x JOIN c y ON x.s = y.id AND x.id = y.s GROUP BY 1"),
    "topological_levels": (topological_levels, f"WITH RECURSIVE {E_}, f AS (SELECT src, dst FROM d WHERE src < dst), u AS (SELECT src AS id FROM f UNION SELECT dst FROM f), t(id, k) AS (SELECT id, 0 FROM u UNION SELECT f.dst, t.k + 1 FROM t JOIN f ON f.src = t.id) SELECT id, max(k) AS level FROM t GROUP BY 1"),
    "k_core": (k_core, f"WITH RECURSIVE {E_}, u AS (SELECT src AS a, dst AS b FROM d UNION SELECT dst, src FROM d), r(k, id, h) AS (SELECT 0, a, count(*) FROM u GROUP BY a UNION ALL SELECT k + 1, id, max(least(h, n)) FROM (SELECT r.k, u.a AS id, r.h, row_number() OVER (PARTITION BY u.a ORDER BY r.h DESC) AS n FROM r JOIN u ON u.b = r.id) WHERE k < {ROUNDS} GROUP BY k, id) SELECT id, min(h)::BIGINT AS coreness FROM r GROUP BY 1"),
    "triangles": (triangles, f"WITH {E_}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), t AS (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b) SELECT id, count(*) AS triangles FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1"),
    "pagerank": (pagerank, f"WITH RECURSIVE {E_}, n AS (SELECT count(*) AS n FROM v), o AS (SELECT src, count(*) AS n FROM e GROUP BY 1), w AS (SELECT e.src, e.dst, count(*) / max(o.n) AS share FROM e JOIN o ON o.src = e.src GROUP BY 1, 2), r(k, id, x) AS (SELECT 0, id, 1.0::DOUBLE / n FROM v, n UNION ALL SELECT k + 1, id, sum(x) FROM (SELECT r.k, w.dst AS id, 0.85 * r.x * w.share AS x FROM r JOIN w ON w.src = r.id UNION ALL SELECT r.k, r.id, 0.15 / n.n AS x FROM r, n UNION ALL SELECT r.k, v.id, 0.85 * r.x / n.n FROM r JOIN v ON true CROSS JOIN n WHERE r.id NOT IN (SELECT src FROM e)) WHERE k < 20 GROUP BY k, id) SELECT id, round(x, 9) AS rank FROM r WHERE k = 20"),
    "personalized_pagerank": (personalized_pagerank, f"WITH RECURSIVE {E_}, o AS (SELECT src, count(*) AS n FROM e GROUP BY 1), w AS (SELECT e.src, e.dst, count(*) / max(o.n) AS share FROM e JOIN o ON o.src = e.src GROUP BY 1, 2), r(k, id, x) AS (SELECT 0, id, (id = 0)::INT::DOUBLE FROM v UNION ALL SELECT k + 1, id, sum(x) FROM (SELECT r.k, w.dst AS id, 0.85 * r.x * w.share AS x FROM r JOIN w ON w.src = r.id UNION ALL SELECT r.k, r.id, CASE WHEN r.id = 0 THEN 0.15 ELSE 0.0 END AS x FROM r UNION ALL SELECT r.k, 0, 0.85 * r.x FROM r WHERE r.id NOT IN (SELECT src FROM e)) WHERE k < 20 GROUP BY k, id) SELECT id, round(x, 9) AS rank FROM r WHERE k = 20"),
    "katz": (katz, f"WITH RECURSIVE {E_}, m AS (SELECT 0.85 / (1 + max(n)) AS alpha FROM (SELECT count(*) AS n FROM e GROUP BY dst)), r(k, id, x) AS (SELECT 0, id, 0::DOUBLE FROM v UNION ALL SELECT k + 1, id, sum(x) FROM (SELECT r.k, e.dst AS id, m.alpha * r.x AS x FROM r JOIN e ON e.src = r.id, m UNION ALL SELECT k, id, 1.0 FROM r) WHERE k < 120 GROUP BY k, id) SELECT id, round(x / (SELECT sqrt(sum(x * x)) FROM r WHERE k = 120), 5) AS score FROM r WHERE k = 120"),
    "eigenvector": (eigenvector, f"WITH RECURSIVE {E_}, r(k, id, x) AS (SELECT 0, id, 1::DOUBLE FROM v UNION ALL SELECT k + 1, id, sum(x) / 50 FROM (SELECT r.k, e.dst AS id, r.x FROM r JOIN e ON e.src = r.id UNION ALL SELECT k, id, x FROM r) WHERE k < 100 GROUP BY k, id) SELECT id, round(x / (SELECT sqrt(sum(x * x)) FROM r WHERE k = 100), 5) AS score FROM r WHERE k = 100"),
    "closeness": (closeness, f"WITH RECURSIVE {E_}, {HOPS} SELECT v.id, round(coalesce((t.r / ((SELECT count(*) FROM v) - 1)) * (t.r / t.s), 0.0), 9) AS closeness FROM v LEFT JOIN (SELECT s AS id, count(*)::DOUBLE AS r, sum(k)::DOUBLE AS s FROM a WHERE k > 0 GROUP BY 1) t ON t.id = v.id"),
    "harmonic": (harmonic, f"WITH RECURSIVE {E_}, {HOPS} SELECT v.id, round(coalesce(t.s / ((SELECT count(*) FROM v) - 1), 0.0), 9) AS harmonic FROM v LEFT JOIN (SELECT s AS id, sum(1.0::DOUBLE / k) AS s FROM a WHERE k > 0 GROUP BY 1) t ON t.id = v.id"),
    "betweenness": (betweenness, f"WITH RECURSIVE {E_}, w(k, s, id, n) AS (SELECT 0, id, id, 1::DOUBLE FROM v UNION ALL SELECT k + 1, s, id, sum(n) FROM (SELECT w.k, w.s, d.dst AS id, w.n FROM w JOIN d ON d.src = w.id) WHERE k < 12 GROUP BY k, s, id), p AS (SELECT s, id, min(k) AS k, arg_min(n, k) AS n FROM w GROUP BY 1, 2) SELECT v.id, round(coalesce(t.b, 0.0), 5) AS betweenness FROM v LEFT JOIN (SELECT x.id, sum(x.n * y.n / z.n) AS b FROM p x JOIN p y ON y.s = x.id JOIN p z ON z.s = x.s AND z.id = y.id WHERE x.k + y.k = z.k AND x.s <> x.id AND y.id <> x.id AND x.s <> y.id GROUP BY 1) t ON t.id = v.id"),
    "diameter": (diameter, f"WITH RECURSIVE {E_}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), h(s, id, k) AS (SELECT id, id, 0 FROM v UNION SELECT h.s, u.dst, h.k + 1 FROM h JOIN u ON u.src = h.id WHERE h.k < {ROUNDS}) SELECT max(k) AS hops FROM (SELECT s, id, min(k) AS k FROM h GROUP BY 1, 2)"),
    "mst_total": (mst_total, f"WITH RECURSIVE {E_}, u AS (SELECT a, b, w, row_number() OVER (ORDER BY w, a, b) AS k FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(weight) AS w FROM e GROUP BY 1, 2)), t AS (SELECT a, b, k FROM u UNION ALL SELECT b, a, k FROM u), r(i, s, id, k) AS (SELECT 0, id, id, 0 FROM v UNION ALL SELECT i + 1, s, id, min(k) FROM (SELECT r.i, r.s, t.b AS id, greatest(r.k, t.k) AS k FROM r JOIN t ON t.a = r.id UNION ALL SELECT i, s, id, k FROM r) WHERE i < {ROUNDS} GROUP BY i, s, id), m AS (SELECT s, id, min(k) AS k FROM r GROUP BY 1, 2) SELECT count(*) AS edges, sum(u.w) AS weight FROM u JOIN m ON m.s = u.a AND m.id = u.b AND m.k = u.k"),
    "bridges": (bridges, f"WITH {P_} SELECT least(src, dst)::BIGINT AS a, greatest(src, dst)::BIGINT AS b FROM p"),
    "articulation_points": (articulation_points, f"WITH {P_} SELECT id::BIGINT AS id FROM (SELECT src AS id FROM p UNION ALL SELECT dst FROM p) GROUP BY 1 HAVING count(*) > 1"),
    "max_matching": (max_matching, "SELECT count(DISTINCT c_nationkey) AS n FROM customer"),
    "max_flow": (max_flow, "SELECT sum(least(c, s))::BIGINT AS flow FROM (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1) JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY 1) USING (k)"),
    "min_cost_flow": (min_cost_flow, "SELECT sum(least(c, s))::BIGINT AS flow, sum(least(c, s) * k)::DOUBLE AS cost FROM (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1) JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY 1) USING (k)"),
    "csv_round_trip": (csv_round_trip, f"WITH {E_} SELECT src, count(*) AS n, sum(weight) AS weight FROM e GROUP BY 1"),
    "jsonl_round_trip": (jsonl_round_trip, "SELECT 'CUST_NATION' AS label, count(*) AS n, round(sum(c_acctbal)) AS bal FROM customer"),
    "snapshot_round_trip": (snapshot_round_trip, "SELECT r_name AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
}


def queries() -> dict:
    return {n: f for n, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in QUERIES.items() if s}
