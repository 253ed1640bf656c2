"""Query language: value semantics, clauses and writes on small graphs."""

import math

import pytest
from pyspark.errors import PySparkException

from loomgraph.graph import PropertyGraph, tables_graph
from loomgraph.operators.ddl import ConstraintError
from loomgraph.plans.emit import CypherError
from loomgraph.plans.parser import CypherSyntaxError, parse


@pytest.fixture(scope="module")
def ports(spark):
    """A ring of three ports, one of whose ferries sails twice, a way out through a loop, and an island."""
    port = spark.createDataFrame([(1, "Aro", 30), (2, "Bel", 40), (3, "Cid", None), (4, "Dun", 20), (5, "Eld", 25), (6, "Fex", 60)], "pid int, name string, tons int")
    ferry = spark.createDataFrame([(1, 2, 5), (1, 2, 5), (2, 3, 6), (3, 1, 7), (3, 4, 8), (4, 4, 9), (1, 4, 20), (4, 6, 21)], "a int, b int, since int")
    return PropertyGraph(spark).with_nodes("Port", port, "pid").with_rels("FERRY", ferry, ("Port", "a"), ("Port", "b"), ["since"])


def rows(g, text, **params):
    return [tuple(r) for r in g.cypher(text, params).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("RETURN 7 / 2 AS a, -7 / 2 AS b, -7 % 3 AS c", (3, -3, -1)),
        ("RETURN 1.0 / 0 AS a, -1.0 / 0 AS b", (math.inf, -math.inf)),
        ("RETURN 1 = 1.0 AS a, 'a' = 1 AS b, null = null AS c", (True, False, None)),
        ("RETURN [1, 2] = [1, 2] AS a, [1, null] = [1, null] AS b, [1] = [1, 2] AS c", (True, None, False)),
        ("RETURN 1 < 2 < 3 AS a, 3 > 2 > 2 AS b", (True, False)),
        ("RETURN range(5, 1) AS a, range(0, -3) AS b, range(5, 1, -2) AS c", ([], [], [5, 3, 1])),
        ("RETURN [1, 2, 3][-1] AS a, [1, 2, 3][5] AS b, [1, 2, 3, 4][1..3] AS c, [1, 2, 3][..-1] AS d", (3, None, [2, 3], [1, 2])),
        ("RETURN 'abc' =~ 'b' AS a, 'abc' =~ '.b.' AS b", (False, True)),
        ("RETURN 'x' + 1 AS a, [1] + 2 AS b, [1] + [2] AS c", ("x1", [1, 2], [1, 2])),
        ("RETURN 2 IN [1, null] AS a, 1 IN [1, null] AS b, 3 IN [] AS c", (None, True, False)),
        ("RETURN toIntegerList(['2', '2.9', 'foo']) AS a", ([2, 2, None],)),
        ("RETURN all(x IN [true, null] WHERE x) AS a, none(x IN [] WHERE true) AS b, single(x IN [1, 1] WHERE x = 1) AS c", (None, True, False)),
        ("RETURN CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS a, CASE WHEN null THEN 1 ELSE 2 END AS b", ("b", 2)),
        ("RETURN reduce(s = '', x IN ['a', 'b'] | s + x) AS a", ("ab",)),
        ("RETURN {a: 1, b: 'x'}.b AS a, keys({a: 1, b: 2}) AS b", ("x", ["a", "b"])),
        ("RETURN ceil(1.2) AS a, sign(-3) AS b, round(2.5) AS c, haversin(0.0) AS d", (2.0, -1, 3.0, 0.0)),
        ("RETURN duration('P1Y2M3DT4H').months AS a, duration.inDays(date('2020-01-01'), date('2020-03-01')).days AS b", (14, 60)),
        ("RETURN date({year: 2020, ordinalDay: 60}).month AS a, date('2020-12-31').week AS b, date('bad') AS c", (2, 53, None)),
        ("RETURN left('abc', 2) AS a, substring('hello', 1, 3) AS b, split('a.b', '.') AS c, reverse([1, 2]) AS d", ("ab", "ell", ["a", "b"], [2, 1])),
        ("RETURN $p + 1 AS a", (3,)),
    ],
)
def test_expressions(spark, text, want):
    assert rows(PropertyGraph(spark), text, p=2) == [want]


def test_nan_is_not_equal(spark):
    assert rows(PropertyGraph(spark), "WITH 0.0 / 0 AS n RETURN n = n AS a, n <> n AS b, isNaN(n) AS c") == [(False, True, True)]


def test_errors(spark, ports):
    for text in ("RETURN 1 / 0", "RETURN 1 % 0", "RETURN left('a', -1)", "RETURN toInteger(9223372036854775808.0)"):
        with pytest.raises(PySparkException):
            rows(ports, text)
    for text in ("RETURN x", "MATCH (a) RETURN a.name LIMIT -1", "RETURN nosuch(1)", "RETURN 1 AS a, 2 AS a"):
        with pytest.raises(CypherError):
            rows(ports, text)
    for text in ("", "MATCH (a RETURN a", "RETURN", "RETURN 1 2", "MATCH (a)-[r->(b) RETURN a"):
        with pytest.raises(CypherSyntaxError):
            parse(text)


def test_directions_and_loops(ports):
    assert rows(ports, "MATCH (a:Port {name: 'Dun'})-[r]-(b) RETURN b.name AS b ORDER BY b") == [("Aro",), ("Cid",), ("Dun",), ("Fex",)]
    assert rows(ports, "MATCH (a {name: 'Dun'})<-[r:FERRY]-(b) RETURN count(*) AS n") == [(3,)]


def test_uniqueness_is_per_match(ports):
    assert rows(ports, "MATCH (a {name: 'Dun'})-[r]->(b)-[s]->(c) RETURN count(*) AS n") == [(1,)]
    assert rows(ports, "MATCH (a {name: 'Dun'})-[r]->(b) MATCH (b)-[s]->(c) RETURN count(*) AS n") == [(2,)]


def test_equal_parallel_edges_stay_apart(ports):
    assert rows(ports, "MATCH (a {name: 'Aro'})-[r]->(b {name: 'Bel'})<-[s]-(c) RETURN count(*) AS n") == [(2,)]
    _, g = ports.execute("MATCH (a {name: 'Aro'})-[r]->({name: 'Bel'}) DELETE r")
    assert g.counters["relationships_deleted"] == 2


def test_variable_length(ports):
    got = rows(ports, "MATCH (a {name: 'Bel'})-[r*1..3]->(b) RETURN b.name AS b, size(r) AS n ORDER BY n, b")
    assert got == [("Cid", 1), ("Aro", 2), ("Dun", 2), ("Bel", 3), ("Bel", 3), ("Dun", 3), ("Dun", 3), ("Fex", 3)]
    assert rows(ports, "MATCH (a {name: 'Dun'})-[*]->(b) RETURN count(*) AS n") == [(3,)]
    assert rows(ports, "MATCH (a {name: 'Fex'})-[*0..1]->(b) RETURN b.name AS b") == [("Fex",)]
    for props in ("{since: 5}", "$m"):
        assert rows(ports, f"MATCH (a)-[*1..2 {props}]->(b) RETURN b.name AS b", m={"since": 5}) == [("Bel",), ("Bel",)]


def test_shortest_paths(ports):
    assert rows(ports, "MATCH p = shortestPath((a {name: 'Bel'})-[*]->(b {name: 'Fex'})) RETURN length(p) AS l") == [(3,)]
    assert rows(ports, "MATCH p = allShortestPaths((a {name: 'Aro'})-[*]->(b {name: 'Cid'})) RETURN count(p) AS n, max(length(p)) AS l") == [(2, 2)]
    assert rows(ports, "MATCH p = shortestPath((a {name: 'Bel'})-[* {since: 6}]->(b {name: 'Fex'})) RETURN length(p) AS l") == []
    assert rows(ports, "MATCH p = shortestPath((a {name: 'Bel'})-[* {since: 6}]->(b)) WHERE a.name <> b.name RETURN b.name AS b") == [("Cid",)]


def test_optional_and_subqueries(ports):
    assert rows(ports, "MATCH (a:Port) OPTIONAL MATCH (a)-[r:FERRY]->(b) WHERE r.since > 7 RETURN a.name AS a, count(b) AS n ORDER BY a") == [("Aro", 1), ("Bel", 0), ("Cid", 1), ("Dun", 2), ("Eld", 0), ("Fex", 0)]
    assert rows(ports, "MATCH (a:Port) WHERE NOT EXISTS { (a)-->() } RETURN a.name AS a ORDER BY a") == [("Eld",), ("Fex",)]
    assert rows(ports, "MATCH (a {name: 'Aro'}) RETURN COUNT { (a)-->() } AS n, size([ (a)-->(b) WHERE b.tons > 30 | b.name ]) AS k") == [(3, 2)]


def test_order_and_nulls(ports):
    assert [r[0] for r in rows(ports, "MATCH (a:Port) RETURN a.tons AS g ORDER BY g")] == [20, 25, 30, 40, 60, None]
    assert [r[0] for r in rows(ports, "MATCH (a:Port) RETURN a.name AS n ORDER BY a.tons DESC SKIP 1 LIMIT 2")] == ["Fex", "Bel"]


def test_aggregates(ports):
    assert rows(ports, "MATCH (a:Port) RETURN count(a.tons) AS c, sum(a.tons) AS s, avg(a.tons) AS m, min(a.name) AS l, percentileDisc(a.tons, 0.5) AS d, size(collect(a.tons)) AS k") == [(5, 175, 35.0, "Aro", 30, 5)]
    assert rows(ports, "MATCH (a:Port) WHERE a.tons > 99 RETURN sum(a.tons) AS s, collect(a.name) AS c") == [(0, [])]
    got = rows(ports, "UNWIND [1, 1, 3] AS x RETURN stdev(DISTINCT x) AS a, stdevp(DISTINCT x) AS b")[0]
    assert got == pytest.approx((math.sqrt(2), 1.0))
    assert rows(ports, "UNWIND [1, 1, 1, 9] AS x RETURN percentileCont(DISTINCT x, 0.5) AS a, percentileDisc(DISTINCT x, 0.6) AS b") == [(5.0, 9)]


def test_writes_make_versions(spark, ports):
    _, g = ports.execute("MATCH (a {name: 'Aro'}) CREATE (a)-[:LIKES {w: 1}]->(:Thing:Big {name: 'T'}) SET a.tons = a.tons + 1")
    assert rows(g, "MATCH (a:Port)-[r:LIKES]->(t:Big) RETURN a.tons AS a, r.w AS w, labels(t) AS l") == [(31, 1, ["Thing", "Big"])]
    assert g.counters["nodes_created"] == 1
    assert rows(ports, "MATCH (a {name: 'Aro'}) RETURN a.tons AS a") == [(30,)]
    _, h = g.execute("UNWIND ['Aro', 'Zed', 'Zed'] AS n MERGE (p:Port {name: n}) ON CREATE SET p.fresh = true ON MATCH SET p.old = true")
    assert rows(h, "MATCH (p:Port) WHERE p.fresh OR p.old RETURN p.name AS n, p.fresh AS f ORDER BY n") == [("Aro", None), ("Zed", True)]
    with pytest.raises(CypherError):
        h.execute("MATCH (a {name: 'Bel'}) DELETE a")
    _, k = h.execute("MATCH (a {name: 'Bel'}) DETACH DELETE a")
    assert rows(k, "MATCH (a:Port)-[r:FERRY]->(b) RETURN count(r) AS n") == [(5,)]
    _, m = k.execute("MATCH (t:Big) REMOVE t:Big, t.name")
    assert rows(m, "MATCH (t:Thing) RETURN labels(t) AS l, t.name AS n") == [(["Thing"], None)]


def test_schema_statements(spark, ports):
    _, g = ports.execute("CREATE CONSTRAINT u FOR (p:Port) REQUIRE p.name IS UNIQUE")
    with pytest.raises(ConstraintError):
        g.execute("CREATE (:Port {name: 'Aro'})")
    with pytest.raises(ConstraintError):
        g.execute("CREATE CONSTRAINT n FOR (p:Port) REQUIRE p.tons IS NOT NULL")
    _, g = g.execute("CREATE INDEX i FOR (p:Port) ON (p.tons)")
    assert [tuple(r) for r in g.cypher("SHOW INDEXES").collect()] == [("i", "HASH", "Port", "tons")]
    assert rows(g, "CALL db.constraints() YIELD name RETURN name") == [("u",)]
    _, g = g.execute("DROP INDEX i")
    assert g.indexes == {}


def test_explain_shows_what_reaches_the_files(spark):
    g = tables_graph(spark, "/root/testdata/sf0.001")
    plan = "\n".join(r[0] for r in g.cypher("EXPLAIN MATCH (c:Customer) WHERE c.c_acctbal > 100 RETURN c.c_name AS n").collect())
    assert "GreaterThan(c_acctbal,100" in plan.replace(".0", "") and "c_mktsegment" not in plan


def test_union_and_foreach(spark, ports):
    assert rows(ports, "RETURN 1 AS x UNION RETURN 1 AS x UNION ALL RETURN 1 AS x") == [(1,), (1,)]
    _, g = ports.execute("FOREACH (x IN [1, 2] | CREATE (:N {v: x}))")
    assert rows(g, "MATCH (n:N) RETURN sum(n.v) AS s") == [(3,)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MATCH p = (a:Port {pid: 2})-[:FERRY]->()-[:FERRY]->(b:Port {pid: 4}) RETURN [n IN nodes(p) | n.name] AS l, [r IN relationships(p) | r.since] AS s", [(["Bel", "Cid", "Dun"], [6, 8])]),
        ("MATCH p = (a:Port {pid: 5})-[:FERRY*0..1]->(b) RETURN [n IN nodes(p) | n.tons] AS l, [r IN relationships(p) | r.since] AS s", [([25], [])]),
        ("MATCH (a {pid: 2})-[r:FERRY*2..2]->(b {pid: 1}) RETURN [x IN r | x.since] AS s, size(r) AS n", [([6, 7], 2)]),
        ("MATCH (a)-[r:FERRY*2..2]->(b {pid: 6}) WHERE a.pid = 3 RETURN [x IN r | x.since] AS s", [([8, 21],)]),
        ("MATCH ()-[r:FERRY {since: 21}]->() RETURN startNode(r).name AS a, endNode(r).tons AS b, labels(startNode(r)) AS l, id(startNode(r)) = id(endNode(r)) AS e", [("Dun", 60, ["Port"], False)]),
        ("MATCH (a)-[r:FERRY]->(b) WHERE startNode(r) = endNode(r) RETURN a.name AS n", [("Dun",)]),
        ("MATCH p = (a {pid: 4})-[:FERRY]->(b {pid: 6}), (x:Port) WHERE x IN nodes(p) RETURN x.name AS n ORDER BY n", [("Dun",), ("Fex",)]),
        ("MATCH p = (a {pid: 2})-[:FERRY]->(b {pid: 3}) UNWIND nodes(p) AS n RETURN n.name AS n ORDER BY n", [("Bel",), ("Cid",)]),
        ("MATCH p = (a {pid: 2})-[:FERRY]->(b {pid: 3}) UNWIND nodes(p) AS n MATCH (n)-[r:FERRY]->(m) RETURN n.name AS n, m.name AS m, r.since AS s ORDER BY s", [("Bel", "Cid", 6), ("Cid", "Aro", 7), ("Cid", "Dun", 8)]),
        ("MATCH (a {pid: 2})-[:FERRY]->(b) WITH collect(b) AS bs UNWIND bs AS b MATCH (b)-[:FERRY]->(x) RETURN b.name AS b, x.pid AS x ORDER BY x", [("Cid", 1), ("Cid", 4)]),
        ("MATCH (a {pid: 5}) WITH collect(a) AS l UNWIND l AS a OPTIONAL MATCH (a)-[r]->(x) RETURN a.name AS a, x.name AS x", [("Eld", None)]),
        ("MATCH (a {pid: 2})-[r:FERRY]->() WITH collect(r) AS rs UNWIND rs AS r MATCH (x)-[r]->(y) RETURN x.name AS x, y.name AS y, type(r) AS t", [("Bel", "Cid", "FERRY")]),
        ("MATCH p = (a {pid: 2})-[:FERRY]->()-[:FERRY]->(b {pid: 4}) RETURN all(n IN nodes(p) WHERE n.pid > 1) AS a, reduce(s = 0, r IN relationships(p) | s + r.since) AS s, size(nodes(p)) AS n", [(True, 14, 3)]),
        ("MATCH p = (a {pid: 4})-[:FERRY {since: 21}]->(b) RETURN [n IN nodes(p) WHERE n.tons > 30 | n.absent] AS l", [([None],)]),
    ],
)
def test_entities_as_values(ports, text, want):
    assert rows(ports, text) == want


def test_property_of_an_end_inside_a_comprehension_is_refused(ports):
    with pytest.raises(CypherError):
        ports.cypher("MATCH p = (a {pid: 2})-[:FERRY]->(b) RETURN [r IN relationships(p) | startNode(r).name] AS l")
