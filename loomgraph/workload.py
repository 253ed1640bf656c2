"""The registered graph queries over the relational tables, and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import workload_graph, workload_language
from loomgraph.algorithms import iterative
from loomgraph.graph import PropertyGraph, tables_graph

#: name: (query text, SQL)
CYPHER: dict[str, tuple[str, str]] = {
    "label_scan_filter_top": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000 RETURN c.c_mktsegment AS seg, count(*) AS n ORDER BY n DESC LIMIT 5",
        "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY 1 ORDER BY n DESC LIMIT 5",
    ),
    "all_nodes_count": (
        "MATCH (n) RETURN count(*) AS n",
        "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS n",
    ),
    "label_count": ("MATCH (n:Part) RETURN count(n) AS n", "SELECT count(*) AS n FROM part"),
    "point_lookup": ("MATCH (c:Customer {c_custkey: 42}) RETURN c.c_name AS name, c.c_acctbal AS bal", "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey = 42"),
    "range_scan_count": ("MATCH (p:Part) WHERE 10 <= p.p_size < 20 RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE p_size >= 10 AND p_size < 20"),
    "prefix_scan": ("MATCH (p:Part) WHERE p.p_brand STARTS WITH 'Brand#1' RETURN p.p_brand AS b, count(*) AS n", "SELECT p_brand AS b, count(*) AS n FROM part WHERE starts_with(p_brand, 'Brand#1') GROUP BY 1"),
    "seek_set": ("UNWIND [1, 5, 9, 5] AS k MATCH (c:Customer {c_custkey: k}) RETURN k, c.c_name AS name", "SELECT k, c_name AS name FROM (VALUES (1), (5), (9), (5)) t(k) JOIN customer ON c_custkey = k"),
    "index_intersection": ("MATCH (p:Part) WHERE p.p_size > 20 AND p.p_retailprice < 1200 AND p.p_size <= 40 RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE p_size > 20 AND p_size <= 40 AND p_retailprice < 1200"),
    "expand_two_hops": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:CUST_NATION]-(c:Customer) RETURN r.r_name AS region, count(c) AS n, round(sum(c.c_acctbal)) AS bal",
        "SELECT r_name AS region, count(*) AS n, round(sum(c_acctbal)) AS bal FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
    ),
    "expand_both": (
        "MATCH (n:Nation {n_nationkey: 3})-[r]-(x) RETURN type(r) AS t, count(*) AS n",
        "SELECT 'IN_REGION' AS t, count(*) AS n FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'CUST_NATION', count(*) FROM customer WHERE c_nationkey = 3 HAVING count(*) > 0 UNION ALL SELECT 'SUPP_NATION', count(*) FROM supplier WHERE s_nationkey = 3 HAVING count(*) > 0",
    ),
    "disconnected_join": (
        "MATCH (c:Customer), (s:Supplier) WHERE c.c_nationkey = s.s_nationkey AND s.s_acctbal > 0 RETURN count(*) AS n",
        "SELECT count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_acctbal > 0",
    ),
    "cartesian_product": ("MATCH (r:Region), (n:Nation) RETURN count(*) AS n", "SELECT count(*) AS n FROM region, nation"),
    "optional_match": (
        "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:SUPP_NATION]-(s:Supplier) WHERE s.s_acctbal > 5000 RETURN n.n_name AS nation, count(s) AS k",
        "SELECT n_name AS nation, count(s_suppkey) AS k FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_nationkey, n_name",
    ),
    "semi_apply": ("MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {o_orderstatus: 'F'}) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    "anti_semi_apply": ("MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->() RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "exists_subquery": (
        "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > c.c_acctbal * 40 } RETURN c.c_mktsegment AS seg, count(*) AS n",
        "SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40) GROUP BY 1",
    ),
    "count_subquery": (
        "MATCH (c:Customer) WHERE COUNT { (c)-[:PLACED]->(:Order) } > 12 RETURN c.c_custkey AS k, COUNT { (c)-[:PLACED]->() } AS n",
        "SELECT c_custkey AS k, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 12",
    ),
    "pattern_comprehension": (
        "MATCH (r:Region) RETURN r.r_name AS region, size([ (r)<-[:IN_REGION]-(n) WHERE n.n_nationkey > 10 | n.n_name ]) AS k",
        "SELECT r_name AS region, count(n_nationkey) AS k FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 10 GROUP BY 1",
    ),
    "var_length_zero": ("MATCH (n:Nation)-[:IN_REGION*0..1]->(x) RETURN labels(x)[0] AS l, count(*) AS n", "SELECT 'Nation' AS l, count(*) AS n FROM nation UNION ALL SELECT 'Region', count(*) FROM nation"),
    "shortest_path": (
        "MATCH (a:Customer {c_custkey: 1}), (b:Nation) MATCH p = shortestPath((a)-[:CUST_NATION|IN_REGION*..4]-(b)) RETURN b.n_nationkey AS k, length(p) AS l",
        "SELECT n.n_nationkey AS k, CASE WHEN n.n_nationkey = c_nationkey THEN 1 ELSE 3 END::BIGINT AS l FROM customer JOIN nation m ON m.n_nationkey = c_nationkey JOIN nation n ON n.n_regionkey = m.n_regionkey WHERE c_custkey = 1",
    ),
    "with_having": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS k, max(o.o_totalprice) AS top WHERE k >= 10 RETURN c.c_custkey AS key, k, top",
        "SELECT c_custkey AS key, count(*) AS k, max(o_totalprice) AS top FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) >= 10",
    ),
    "with_chain": (
        "MATCH (s:Supplier) WITH s ORDER BY s.s_acctbal DESC, s.s_suppkey LIMIT 5 MATCH (s)-[:SUPP_NATION]->(n:Nation) RETURN s.s_suppkey AS s, n.n_name AS n",
        "SELECT s_suppkey AS s, n_name AS n FROM (SELECT * FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5) JOIN nation ON s_nationkey = n_nationkey",
    ),
    "distinct_rows": ("MATCH (o:Order) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "skip_limit": ("MATCH (c:Customer) RETURN c.c_custkey AS k ORDER BY k SKIP 10 LIMIT 7", "SELECT c_custkey AS k FROM customer ORDER BY k OFFSET 10 LIMIT 7"),
    "order_by_hidden": ("MATCH (p:Part) RETURN p.p_name AS name, p.p_partkey AS k ORDER BY p.p_retailprice DESC, p.p_partkey LIMIT 6", "SELECT p_name AS name, p_partkey AS k FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 6"),
    "unwind_range": ("UNWIND range(1, 10, 3) AS x RETURN x, x / 2 AS half, x % 4 AS rest, x ^ 2 AS square", "SELECT x, x // 2 AS half, x % 4 AS rest, (x * x)::DOUBLE AS square FROM (VALUES (1), (4), (7), (10)) t(x)"),
    "union_all": ("MATCH (r:Region) RETURN r.r_name AS name UNION ALL MATCH (n:Nation) RETURN n.n_name AS name", "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation"),
    "union_distinct": ("MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "aggregates": (
        "MATCH (c:Customer) RETURN c.c_mktsegment AS seg, count(*) AS n, count(DISTINCT c.c_nationkey) AS nations, min(c.c_acctbal) AS lo, max(c.c_acctbal) AS hi, round(avg(c.c_acctbal)) AS mean, round(stdev(c.c_acctbal)) AS sd, round(stdevp(c.c_acctbal)) AS sdp",
        "SELECT c_mktsegment AS seg, count(*) AS n, count(DISTINCT c_nationkey) AS nations, min(c_acctbal) AS lo, max(c_acctbal) AS hi, round(avg(c_acctbal)) AS mean, round(stddev_samp(c_acctbal)) AS sd, round(stddev_pop(c_acctbal)) AS sdp FROM customer GROUP BY 1",
    ),
    "percentiles": (
        "MATCH (p:Part) RETURN p.p_brand AS b, percentileDisc(p.p_size, 0.5) AS d, floor(percentileCont(p.p_retailprice, 0.25)) AS c",
        "SELECT p_brand AS b, quantile_disc(p_size, 0.5) AS d, floor(quantile_cont(p_retailprice, 0.25)) AS c FROM part GROUP BY 1",
    ),
    "collect_size": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, size(collect(n.n_name)) AS k", "SELECT r_name AS r, count(*) AS k FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "sum_of_none": ("MATCH (c:Customer) WHERE c.c_custkey < 0 RETURN sum(c.c_acctbal) AS s, count(*) AS n, avg(c.c_acctbal) AS a", "SELECT 0::DOUBLE AS s, 0::BIGINT AS n, NULL::DOUBLE AS a"),
    "case_expression": (
        "MATCH (o:Order) RETURN CASE WHEN o.o_totalprice > 200000 THEN 'high' WHEN o.o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, count(*) AS n",
        "SELECT CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, count(*) AS n FROM orders GROUP BY 1",
    ),
    "list_functions": (
        "UNWIND [3, 5] AS n RETURN n, [x IN range(1, n) WHERE x % 2 = 1 | x * 10] AS odd, reduce(a = 0, x IN range(1, n) | a + x) AS total, head(range(n, 9)) AS h, last(range(n, 9)) AS l, size(tail(range(1, n))) AS t",
        "SELECT * FROM (VALUES (3, [10, 30], 6, 3, 9, 2), (5, [10, 30, 50], 15, 5, 9, 4)) t(n, odd, total, h, l, t)",
    ),
    "quantifiers": (
        "UNWIND [[1, 2], [2, 3], [4]] AS l RETURN size(l) AS s, all(x IN l WHERE x > 1) AS a, any(x IN l WHERE x = 1) AS b, none(x IN l WHERE x > 3) AS c, single(x IN l WHERE x = 2) AS d",
        "SELECT * FROM (VALUES (2, false, true, true, true), (2, true, false, true, true), (1, true, false, false, false)) t(s, a, b, c, d)",
    ),
    "string_functions": (
        "MATCH (n:Nation) RETURN toLower(n.n_name) AS lo, left(n.n_name, 3) AS l, right(n.n_name, 2) AS r, substring(n.n_name, 1, 3) AS s, replace(n.n_name, 'N', 'x') AS x, size(split(n.n_name, '_')) AS k, reverse(n.n_name) AS rev",
        "SELECT lower(n_name) AS lo, left(n_name, 3) AS l, right(n_name, 2) AS r, substr(n_name, 2, 3) AS s, replace(n_name, 'N', 'x') AS x, len(string_split(n_name, '_')) AS k, reverse(n_name) AS rev FROM nation",
    ),
    "string_predicates": ("MATCH (p:Part) WHERE p.p_name CONTAINS '1' AND p.p_name ENDS WITH '2' AND p.p_type =~ '[A-Z].*' RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE contains(p_name, '1') AND ends_with(p_name, '2') AND regexp_full_match(p_type, '[A-Z].*')"),
    "conversions": ("RETURN toInteger('2.9') AS a, toInteger('foo') AS b, toFloat('1.5') AS c, toBoolean('TRUE') AS d, toString(12) AS e", "SELECT 2::BIGINT AS a, NULL::BIGINT AS b, 1.5::DOUBLE AS c, true AS d, '12' AS e"),
    "null_logic": ("UNWIND [true, false, null] AS x RETURN x, x AND null AS a, x OR null AS o, NOT x AS n, x XOR true AS e", "SELECT x, x AND NULL AS a, x OR NULL AS o, NOT x AS n, x <> true AS e FROM (VALUES (true), (false), (NULL)) t(x)"),
    "null_order": ("UNWIND [2, null, 1] AS x RETURN x ORDER BY x DESC LIMIT 2", "SELECT x FROM (VALUES (2), (NULL), (1)) t(x) ORDER BY x DESC NULLS FIRST LIMIT 2"),
    "temporal": (
        "MATCH (o:Order) WHERE o.o_orderdate >= localdatetime('1997-01-01T00:00:00') RETURN o.o_orderdate.year AS y, o.o_orderdate.quarter AS q, count(*) AS n",
        "SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1, 2",
    ),
    "date_arithmetic": (
        "RETURN date('2020-01-31') + duration({months: 1}) AS a, date({year: 1984, week: 10, dayOfWeek: 3}) AS b, date.truncate('decade', date('1987-05-06')) AS c, duration.inDays(date('2020-01-01'), date('2020-03-01')).days AS d",
        "SELECT DATE '2020-02-29' AS a, DATE '1984-03-07' AS b, DATE '1980-01-01' AS c, 60::BIGINT AS d",
    ),
    "map_projection": ("MATCH (r:Region) WITH r{.r_name, key: r.r_regionkey} AS m RETURN m.r_name AS name, m.key AS k", "SELECT r_name AS name, r_regionkey AS k FROM region"),
    "relationship_properties": (
        "MATCH (:Order)-[c:CONTAINS]->(p:Part) WHERE c.l_quantity > 45 AND c.l_discount < 0.02 RETURN c.l_returnflag AS flag, count(*) AS n, round(sum(c.l_extendedprice)) AS total",
        "SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_extendedprice)) AS total FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02 GROUP BY 1",
    ),
    "degree_top": ("MATCH (c:Customer)-[:PLACED]->() RETURN c.c_custkey AS k, count(*) AS n ORDER BY n DESC, k LIMIT 10", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, k LIMIT 10"),
    "call_labels": ("CALL db.labels() YIELD label RETURN label", "SELECT * FROM (VALUES ('Customer'), ('Nation'), ('Order'), ('Part'), ('Region'), ('Supplier')) t(label)"),
    "expand_into": (
        "MATCH (p:Part)-[:SUPPLIED_BY]->(s:Supplier) MATCH (s)-[:SUPPLIES]->(p) RETURN count(*) AS n",
        "SELECT count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey",
    ),
    "relationship_uniqueness": (
        "MATCH (a:Order)-[:CONTAINS]->(p:Part)<-[:CONTAINS]-(b:Order) RETURN count(*) AS n",
        "SELECT coalesce(sum(k * (k - 1)), 0)::BIGINT AS n FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_partkey)",
    ),
    "var_length": (
        "MATCH (c:Customer)-[:CUST_NATION|IN_REGION*1..2]->(x) RETURN c.c_custkey AS k, count(x) AS n",
        "SELECT c_custkey AS k, 2::BIGINT AS n FROM customer",
    ),
    "named_path": (
        "MATCH p = (c:Customer)-[:CUST_NATION]->(:Nation)-[:IN_REGION]->(r:Region) RETURN length(p) AS l, size(nodes(p)) AS s, r.r_name AS r, count(*) AS n",
        "SELECT 2::BIGINT AS l, 3::BIGINT AS s, r_name AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "common_suppliers": (
        "MATCH (a:Supplier)-[:SUPPLIES]->(p:Part)<-[:SUPPLIES]-(b:Supplier) WHERE a.s_suppkey < b.s_suppkey RETURN a.s_suppkey AS a, b.s_suppkey AS b, count(*) AS n",
        "WITH d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM d x JOIN d y ON x.l_partkey = y.l_partkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2",
    ),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_graph(spark, sf_dir).cypher(CYPHER["label_scan_filter_top"][0])


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with the same value rank in one event type: u -> next user by event id within an hour of a type."""
    e = _t(spark, sf_dir, "events")
    from pyspark.sql.window import Window

    w = Window.partitionBy("event_type", F.to_date("ts"), F.hour("ts")).orderBy("event_id")
    return e.select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"), (F.col("event_id") % 97 + 1).cast("double").alias("weight")).where("dst is not null and src <> dst")


_USER_SQL = "e AS (SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type, ts::DATE, hour(ts) ORDER BY event_id) AS dst, (event_id % 97 + 1)::DOUBLE AS weight FROM events) WHERE dst IS NOT NULL AND src <> dst)"


def _nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to the supplier of their nation with the same key modulo: a small forest with several components."""
    return _t(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000000).alias("src"), F.col("c_nationkey").cast("long").alias("dst"))


def wcc(spark, sf_dir):
    return iterative.weakly_connected_components(_nation_edges(spark, sf_dir))


def triangle_total(spark, sf_dir):
    return iterative.triangles(_user_edges(spark, sf_dir)).agg((F.coalesce(F.sum("triangles"), F.lit(0)) / 3).cast("long").alias("n"))


def degree_table(spark, sf_dir):
    return iterative.degrees(_user_edges(spark, sf_dir))


def closure_size(spark, sf_dir):
    return iterative.transitive_closure(_nation_edges(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


def fluent_query(spark, sf_dir):
    g = tables_graph(spark, sf_dir)
    return g.match().vertex("Nation", ranges={"n_nationkey": (0, 9)}).into("SUPP_NATION").vertex("Supplier").collect({"s_suppkey"}).select("s_suppkey")


def create_and_match(spark, sf_dir):
    g = tables_graph(spark, sf_dir)
    _, g = g.execute("MATCH (n:Nation) WHERE n.n_nationkey < 5 CREATE (n)-[:TAGGED {w: n.n_nationkey}]->(:Tag {name: n.n_name})")
    return g.cypher("MATCH (n:Nation)-[t:TAGGED]->(x:Tag) RETURN n.n_nationkey AS k, x.name AS name, t.w AS w")


def set_and_match(spark, sf_dir):
    g = tables_graph(spark, sf_dir)
    _, g = g.execute("MATCH (r:Region) WHERE r.r_regionkey > 2 SET r.big = true, r.r_name = toLower(r.r_name)")
    return g.cypher("MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS name, r.big AS big")


def detach_delete(spark, sf_dir):
    g = tables_graph(spark, sf_dir)
    _, g = g.execute("MATCH (n:Nation) WHERE n.n_nationkey >= 20 DETACH DELETE n")
    return g.cypher("MATCH (n:Nation)<-[:SUPP_NATION]-(s) RETURN n.n_nationkey AS k, count(s) AS n")


def merge_nodes(spark, sf_dir):
    g = PropertyGraph(spark).with_nodes("Nation", _t(spark, sf_dir, "nation"), "n_nationkey")
    _, g = g.execute("UNWIND [1, 2, 100, 100, 101] AS k MERGE (n:Nation {n_nationkey: k}) ON CREATE SET n.fresh = true")
    return g.cypher("MATCH (n:Nation) RETURN n.fresh AS fresh, count(*) AS n")


_UNDIRECTED = "u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e)"
ALGORITHMS = {
    "wcc": (wcc, "WITH c AS (SELECT c_custkey + 1000000 AS src, c_nationkey::BIGINT AS dst FROM customer) SELECT src AS id, dst AS component FROM c UNION SELECT dst, dst FROM c"),
    "triangle_total": (triangle_total, f"WITH {_USER_SQL}, {_UNDIRECTED} SELECT count(*) AS n FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b"),
    "degree_table": (degree_table, f"WITH {_USER_SQL} SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1"),
    "closure_size": (closure_size, "SELECT (SELECT 2 * count(*) FROM customer) + (SELECT count(DISTINCT c_nationkey) FROM customer) AS n"),
    "fluent_query": (fluent_query, "SELECT s_suppkey FROM supplier WHERE s_nationkey BETWEEN 0 AND 9"),
    "create_and_match": (create_and_match, "SELECT n_nationkey AS k, n_name AS name, n_nationkey AS w FROM nation WHERE n_nationkey < 5"),
    "set_and_match": (set_and_match, "SELECT r_regionkey AS k, CASE WHEN r_regionkey > 2 THEN lower(r_name) ELSE r_name END AS name, CASE WHEN r_regionkey > 2 THEN true END AS big FROM region"),
    "detach_delete": (detach_delete, "SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey < 20 GROUP BY 1"),
    "merge_nodes": (merge_nodes, "SELECT NULL::BOOLEAN AS fresh, count(*) AS n FROM nation UNION ALL SELECT true, 2"),
}


def _cypher(text: str):
    return lambda spark, sf_dir: tables_graph(spark, sf_dir).cypher(text)


def queries() -> dict:
    return {n: _cypher(q) for n, (q, _) in CYPHER.items()} | {n: f for n, (f, _) in ALGORITHMS.items()} | workload_graph.queries() | workload_language.queries()


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in CYPHER.items()} | {n: s for n, (_, s) in ALGORITHMS.items()} | workload_graph.oracle_sql() | workload_language.oracle_sql()
