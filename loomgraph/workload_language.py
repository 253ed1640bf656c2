"""Registered queries of functions, predicates and writes, and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph, tables_graph

#: name: (query text, SQL)
READS: dict[str, tuple[str, str]] = {
    "label_intersection": ("MATCH (n:Nation) WHERE n:Nation AND NOT n:Region RETURN count(*) AS n", "SELECT count(*) AS n FROM nation"),
    "label_predicate": ("MATCH (n) WHERE n:Region OR n:Supplier RETURN count(*) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM supplier) AS n"),
    "in_list": ("MATCH (c:Customer) WHERE c.c_mktsegment IN ['BUILDING', 'MACHINERY'] RETURN c.c_mktsegment AS s, count(*) AS n", "SELECT c_mktsegment AS s, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1"),
    "is_null": ("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:SUPP_NATION]-(s) WITH n, s WHERE s IS NULL RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)"),
    "is_not_null": ("MATCH (o:Order) WHERE o.o_totalprice IS NOT NULL AND o.nosuch IS NULL RETURN count(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL"),
    "math_functions": (
        "MATCH (s:Supplier) RETURN s.s_suppkey AS k, abs(s.s_acctbal) AS a, ceil(s.s_acctbal) AS c, floor(s.s_acctbal) AS f, sign(s.s_acctbal) AS g, round(sqrt(abs(s.s_acctbal)), 6) AS q, round(exp(s.s_acctbal / 10000), 6) AS e, round(log(abs(s.s_acctbal) + 1), 6) AS l, round(log10(abs(s.s_acctbal) + 1), 6) AS t",
        "SELECT s_suppkey AS k, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, sign(s_acctbal)::BIGINT AS g, round(sqrt(abs(s_acctbal)), 6) AS q, round(exp(s_acctbal / 10000), 6) AS e, round(ln(abs(s_acctbal) + 1), 6) AS l, round(log10(abs(s_acctbal) + 1), 6) AS t FROM supplier",
    ),
    "trigonometry": (
        "MATCH (p:Part) WITH DISTINCT p.p_size AS s RETURN s, round(sin(s), 8) AS a, round(cos(s), 8) AS b, round(tan(s), 6) AS c, round(atan(s), 8) AS d, round(atan2(s, 2), 8) AS e, round(asin(1.0 / s), 8) AS f, round(acos(1.0 / s), 8) AS g, round(radians(s), 8) AS h, round(degrees(s), 6) AS i, round(haversin(s), 8) AS j",
        "SELECT DISTINCT p_size AS s, round(sin(p_size), 8) AS a, round(cos(p_size), 8) AS b, round(tan(p_size), 6) AS c, round(atan(p_size), 8) AS d, round(atan2(p_size, 2), 8) AS e, round(asin(1.0 / p_size), 8) AS f, round(acos(1.0 / p_size), 8) AS g, round(radians(p_size), 8) AS h, round(degrees(p_size), 6) AS i, round((1 - cos(p_size)) / 2, 8) AS j FROM part",
    ),
    "constants_and_nan": ("RETURN round(pi(), 9) AS p, round(e(), 9) AS e, isNaN(0.0 / 0) AS n, isNaN(1.0) AS m", "SELECT 3.141592654::DOUBLE AS p, 2.718281828::DOUBLE AS e, true AS n, false AS m"),
    "null_functions": ("MATCH (c:Customer) RETURN coalesce(c.nosuch, c.c_mktsegment) AS s, nullIf(c.c_mktsegment, 'BUILDING') AS m, count(*) AS n", "SELECT c_mktsegment AS s, nullif(c_mktsegment, 'BUILDING') AS m, count(*) AS n FROM customer GROUP BY 1, 2"),
    "entity_functions": ("MATCH (n:Nation)-[r:IN_REGION]->(g:Region) RETURN type(r) AS t, labels(g)[0] AS l, id(n) = id(g) AS same, size(keys(g)) AS k, count(*) AS n", "SELECT 'IN_REGION' AS t, 'Region' AS l, false AS same, 2::BIGINT AS k, count(*) AS n FROM nation"),
    "properties_of": ("MATCH (r:Region) RETURN properties(r).r_name AS name, r['r_regionkey'] AS k", "SELECT r_name AS name, r_regionkey AS k FROM region"),
    "trim_functions": ("MATCH (r:Region) WITH '  ' + r.r_name + ' ' AS s RETURN trim(s) AS a, lTrim(s) AS b, rTrim(s) AS c, toUpper(s) AS d, size(s) AS n", "SELECT r_name AS a, r_name || ' ' AS b, '  ' || r_name AS c, upper('  ' || r_name || ' ') AS d, (length(r_name) + 3)::BIGINT AS n FROM region"),
    "list_conversions": ("RETURN toIntegerList(['1', 'x', '3']) AS a, toFloatList(['1.5', 'y']) AS b, toBooleanList(['true', 'no']) AS c, toStringList([1, 2]) AS d", "SELECT [1, NULL, 3]::BIGINT[] AS a, [1.5, NULL]::DOUBLE[] AS b, [true, NULL] AS c, ['1', '2'] AS d"),
    "integer_overflow_of_text": ("RETURN toInteger('9223372036854775807') AS a, toInteger('9223372036854775808') AS b, toInteger('-9.9') AS c", "SELECT 9223372036854775807::BIGINT AS a, NULL::BIGINT AS b, -9::BIGINT AS c"),
    "slices": ("UNWIND [[1, 2, 3, 4, 5]] AS l RETURN l[1..3] AS a, l[..-2] AS b, l[-2..] AS c, l[-1] AS d, l[9] AS e", "SELECT [2, 3]::BIGINT[] AS a, [1, 2, 3]::BIGINT[] AS b, [4, 5]::BIGINT[] AS c, 5::BIGINT AS d, NULL::BIGINT AS e"),
    "comparison_chain": ("MATCH (p:Part) WHERE 5 < p.p_size <= 10 <> 11 RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE p_size > 5 AND p_size <= 10"),
    "xor_and_not": ("MATCH (p:Part) WHERE (p.p_size > 10) XOR (p.p_retailprice > 1000) RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE (p_size > 10) <> (p_retailprice > 1000)"),
    "power_and_modulo": ("MATCH (p:Part) RETURN p.p_size % 7 AS m, sum(p.p_size ^ 2) AS s", "SELECT p_size % 7 AS m, sum(p_size * p_size)::DOUBLE AS s FROM part GROUP BY 1"),
    "distinct_aggregates": (
        "MATCH (p:Part) RETURN p.p_brand AS b, sum(DISTINCT p.p_size) AS s, avg(DISTINCT p.p_size) AS a, round(stdev(DISTINCT p.p_size), 6) AS d, round(stdevp(DISTINCT p.p_size), 6) AS e, percentileCont(DISTINCT p.p_size, 0.5) AS c, percentileDisc(DISTINCT p.p_size, 0.5) AS m, size(collect(DISTINCT p.p_size)) AS k",
        "WITH d AS (SELECT DISTINCT p_brand, p_size FROM part) SELECT p_brand AS b, sum(p_size)::BIGINT AS s, avg(p_size) AS a, round(coalesce(stddev_samp(p_size), 0), 6) AS d, round(stddev_pop(p_size), 6) AS e, quantile_cont(p_size, 0.5)::DOUBLE AS c, quantile_disc(p_size, 0.5) AS m, count(*) AS k FROM d GROUP BY 1",
    ),
    "regex_whole_match": ("UNWIND ['abc', 'xabc', 'ABC'] AS s RETURN s, s =~ 'abc' AS a, s =~ '(?i)abc' AS b, s =~ '.*b.*' AS c, s =~ '[' AS d", "SELECT s, s = 'abc' AS a, lower(s) = 'abc' AS b, contains(s, 'b') AS c, NULL::BOOLEAN AS d FROM (VALUES ('abc'), ('xabc'), ('ABC')) t(s)"),
    "regex_line_end": ("WITH 'abc\\n' AS s RETURN s =~ 'abc' AS a", "SELECT false AS a"),
    "unwind_null": ("MATCH (r:Region) UNWIND null AS x RETURN count(x) AS n", "SELECT 0::BIGINT AS n"),
    "unwind_one": ("MATCH (r:Region) UNWIND r.r_name AS x RETURN x", "SELECT r_name AS x FROM region"),
    "shortest_path_by_property": (
        "MATCH (s:Supplier {s_suppkey: 1}), (p:Part) MATCH q = shortestPath((p)-[:SUPPLIED_BY*..1 {l_returnflag: 'R'}]->(s)) RETURN p.p_partkey AS k, length(q) AS l",
        "SELECT DISTINCT l_partkey AS k, 1::BIGINT AS l FROM lineitem WHERE l_suppkey = 1 AND l_returnflag = 'R'",
    ),
    "bound_hops_by_property": ("MATCH (p:Part)-[r:SUPPLIED_BY*1..1 {l_linestatus: 'F'}]->(s) RETURN count(*) AS n", "SELECT count(*) AS n FROM lineitem WHERE l_linestatus = 'F'"),
    "date_truncation": ("MATCH (o:Order) RETURN date.truncate('month', o.o_orderdate) AS m, count(*) AS n", "SELECT date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n FROM orders GROUP BY 1"),
    "date_parts": ("MATCH (o:Order) RETURN o.o_orderdate.month AS m, o.o_orderdate.week AS w, o.o_orderdate.dayOfWeek AS d, count(*) AS n", "SELECT month(o_orderdate) AS m, weekofyear(o_orderdate) AS w, isodow(o_orderdate) AS d, count(*) AS n FROM orders GROUP BY 1, 2, 3"),
    "duration_between": ("MATCH (o:Order) RETURN duration.inDays(date('1992-01-01'), date(o.o_orderdate)).days AS d, count(*) AS n", "SELECT datediff('day', DATE '1992-01-01', o_orderdate::DATE) AS d, count(*) AS n FROM orders GROUP BY 1"),
    "union_of_labels": ("MATCH (c:Customer) WHERE c.c_acctbal < 0 RETURN c.c_name AS name UNION MATCH (s:Supplier) WHERE s.s_acctbal < 0 RETURN s.s_name AS name", "SELECT c_name AS name FROM customer WHERE c_acctbal < 0 UNION SELECT s_name FROM supplier WHERE s_acctbal < 0"),
    "all_shortest_paths": (
        "MATCH (c:Customer), (r:Region) MATCH p = allShortestPaths((c)-[:CUST_NATION|IN_REGION*..2]->(r)) RETURN r.r_name AS r, length(p) AS l, count(*) AS n",
        "SELECT r_name AS r, 2::BIGINT AS l, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
    ),
    "nested_comprehension": ("MATCH (r:Region) RETURN r.r_name AS r, [x IN [y IN range(1, 4) | y * y] WHERE x > 3 | x + r.r_regionkey] AS l", "SELECT r_name AS r, [4 + r_regionkey, 9 + r_regionkey, 16 + r_regionkey]::BIGINT[] AS l FROM region"),
    "call_relationship_types": ("CALL db.relationshipTypes() YIELD relationshipType RETURN relationshipType AS t", "SELECT * FROM (VALUES ('CONTAINS'), ('CUST_NATION'), ('IN_REGION'), ('PLACED'), ('SUPPLIED_BY'), ('SUPPLIES'), ('SUPP_NATION')) t(t)"),
    "path_nodes": (
        "MATCH p = (c:Customer)-[:CUST_NATION]->(:Nation)-[:IN_REGION]->(:Region) RETURN [n IN nodes(p) | coalesce(n.c_name, n.n_name, n.r_name)] AS names",
        "SELECT [c_name, n_name, r_name] AS names FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey",
    ),
    "path_relationships": (
        "MATCH p = (o:Order)-[:CONTAINS]->(:Part) RETURN o.o_orderstatus AS s, round(sum(reduce(s = 0.0, r IN relationships(p) | s + r.l_quantity))) AS q",
        "SELECT o_orderstatus AS s, round(sum(l_quantity)) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1",
    ),
    "relationship_ends": (
        "MATCH ()-[r:CUST_NATION]->() RETURN endNode(r).n_name AS n, round(sum(startNode(r).c_acctbal)) AS s",
        "SELECT n_name AS n, round(sum(c_acctbal)) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    ),
    "unwound_nodes": (
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, collect(n) AS ns UNWIND ns AS m MATCH (m)<-[:CUST_NATION]-(c:Customer) RETURN r.r_name AS r, m.n_name AS n, count(c) AS k",
        "SELECT r_name AS r, n_name AS n, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2",
    ),
    "hops_as_values": (
        "MATCH (c:Customer)-[r:CUST_NATION|IN_REGION*2..2]->(g:Region) RETURN [x IN r | type(x)] AS t, g.r_name AS g, count(*) AS n",
        "SELECT ['CUST_NATION', 'IN_REGION'] AS t, r_name AS g, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 2",
    ),
    "random_and_time": ("WITH rand() AS r, randomUUID() AS u, timestamp() AS t RETURN 0 <= r AND r < 1 AS a, size(u) AS b, t > 1500000000000 AS c", "SELECT true AS a, 36::BIGINT AS b, true AS c"),
}

#: name: (statements in turn, query text on what they leave, SQL)
WRITES: dict[str, tuple[list[str], str, str]] = {
    "set_property_all": (["MATCH (c:Customer) SET c.c_acctbal = c.c_acctbal + 1"], "MATCH (c:Customer) RETURN round(sum(c.c_acctbal)) AS s", "SELECT round(sum(c_acctbal + 1)) AS s FROM customer"),
    "set_all_properties": (["MATCH (r:Region) SET r = {r_regionkey: r.r_regionkey, note: 'n'}"], "MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS name, r.note AS note", "SELECT r_regionkey AS k, NULL::VARCHAR AS name, 'n' AS note FROM region"),
    "set_merge_properties": (["MATCH (r:Region) SET r += {note: 'n'}"], "MATCH (r:Region) RETURN r.r_name AS name, r.note AS note", "SELECT r_name AS name, 'n' AS note FROM region"),
    "set_and_remove_labels": (["MATCH (n:Nation) SET n:Place:Land", "MATCH (n:Land) WHERE n.n_regionkey = 0 REMOVE n:Place"], "MATCH (p:Place) RETURN count(*) AS n", "SELECT count(*) AS n FROM nation WHERE n_regionkey <> 0"),
    "remove_property": (["MATCH (s:Supplier) WHERE s.s_acctbal < 0 REMOVE s.s_name"], "MATCH (s:Supplier) WHERE s.s_name IS NULL RETURN count(*) AS n", "SELECT count(*) AS n FROM supplier WHERE s_acctbal < 0"),
    "delete_relationships": (["MATCH (:Customer)-[p:PLACED]->(o:Order) WHERE o.o_orderstatus = 'F' DELETE p"], "MATCH (:Customer)-[p:PLACED]->() RETURN count(p) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F'"),
    "delete_nodes": (["MATCH (o:Order) DETACH DELETE o"], "MATCH (n) RETURN count(n) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS n"),
    "foreach_create": (["MATCH (r:Region) FOREACH (x IN range(1, 3) | CREATE (:Mark {v: x + r.r_regionkey}))"], "MATCH (m:Mark) RETURN m.v AS v, count(*) AS n", "SELECT (x + r_regionkey)::BIGINT AS v, count(*) AS n FROM region, (VALUES (1), (2), (3)) t(x) GROUP BY 1"),
    "merge_relationships": (["MATCH (n:Nation)-[:IN_REGION]->(r:Region) MERGE (r)-[:HAS]->(n)", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) MERGE (r)-[:HAS]->(n)"], "MATCH (r:Region)-[h:HAS]->(n) RETURN r.r_name AS r, count(h) AS n", "SELECT r_name AS r, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1"),
}


def _read(text: str):
    return lambda spark, sf_dir: tables_graph(spark, sf_dir).cypher(text)


def _write(statements: list[str], text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = tables_graph(spark, sf_dir)
        for x in statements:
            _, g = g.execute(x)
        return g.cypher(text)

    return run


def parallel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal rows are edges of their own: two of a part's supplies are never one."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    twice = parts.select(F.col("p_partkey").alias("a"), F.col("p_size").cast("long").alias("b"))
    sizes = twice.select(F.col("b").alias("k")).distinct()
    g = PropertyGraph(spark).with_nodes("Part", parts.select("p_partkey"), "p_partkey").with_nodes("Size", sizes, "k").with_rels("OF", twice.union(twice), ("Part", "a"), ("Size", "b"))
    return g.cypher("MATCH (a:Part)-[r:OF]->(b)<-[s:OF]-(c:Part) WHERE a.p_partkey = c.p_partkey RETURN count(*) AS n")


OTHERS = {"parallel_edges": (parallel_edges, "SELECT 2 * count(*) AS n FROM part")}


def queries() -> dict:
    return {n: _read(q) for n, (q, _) in READS.items()} | {n: _write(w, q) for n, (w, q, _) in WRITES.items()} | {n: f for n, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in READS.items()} | {n: s for n, (_, _, s) in WRITES.items()} | {n: s for n, (_, s) in OTHERS.items()}
