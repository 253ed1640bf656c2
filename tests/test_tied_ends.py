"""WHERE sets ends of a pattern equal: the join is on what is equal, and the rows are those of the plain pattern."""

from loomgraph.graph import PropertyGraph


def test_equal_ends_narrow_the_join(spark):
    parts = spark.createDataFrame([(k, k % 2, "x" if k % 3 else None) for k in range(12)], "k long, size long, s string")
    g = PropertyGraph(spark).with_nodes("Part", parts, "k").with_nodes("Size", parts.select("size").distinct(), "size").with_rels("OF", parts.union(parts), ("Part", "k"), ("Size", "size"))
    whole = "MATCH (a:Part)-[r:OF]->(b)<-[s:OF]-(c:Part) WHERE {} RETURN count(*) AS n"
    tied = g.cypher(whole.format("a.k = c.k"))
    assert tied.first()["n"] == 24
    joins = [x for x in tied._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert any(".k#" in x and x.count("=") > 1 for x in joins)
    for cond, alike in (("c.s = a.s", lambda x, y: x[2] is not None and x[2] == y[2]), ("a.k = c.k AND a.s = c.s", lambda x, y: x[0] == y[0] and x[2] is not None), ("a.k = c.size", lambda x, y: x[0] == y[1])):
        rows = [r for r in parts.union(parts).collect()]
        assert g.cypher(whole.format(cond)).first()["n"] == sum(i != j and x[1] == y[1] and alike(x, y) for i, x in enumerate(rows) for j, y in enumerate(rows))
    assert g.cypher("MATCH (a:Part)-[r:OF]->(b)<-[s:OF]-(c:Part {k: 3}) WHERE a.k = c.k RETURN a.k AS k, c.size AS s").collect() == [(3, 1)] * 2


def test_pairs_of_hops_are_counted_by_their_node(spark):
    people = spark.createDataFrame([(k,) for k in range(6)], "k long")
    knows = spark.createDataFrame([(0, 1), (0, 1), (2, 1), (3, 1), (1, 1), (4, 5), (9, 1)], "a long, b long")
    g = PropertyGraph(spark).with_nodes("P", people, "k").with_nodes("Q", people, "k").with_rels("K", knows, ("P", "a"), ("P", "b")).with_rels("L", knows, ("P", "a"), ("Q", "b"))
    for text in ("(a:P)-[:K]->(b:P)<-[:K]-(c:P)", "(a:P)-[:K]->(b)<-[:K]-(c:P)", "(a)-[:K]->(b)<-[:K]-(c)", "(a)<-[:K]-(b)-[:K]->(c)", "(a:P)-[:K]-(b:P)-[:K]-(c:P)", "(a:P)-[:L]->(b:Q)<-[:L]-(c:P)", "(a:P)-[:K|L]->(b)<-[:L|K]-(c:P)", "(a:Q)-[:K]->(b)<-[:K]-(c:Q)"):
        fast = g.cypher(f"MATCH {text} RETURN count(*) AS n")
        plain = g.cypher(f"MATCH {text} WHERE 1 = 1 RETURN count(*) AS n")
        assert fast.collect() == plain.collect() and fast.schema == plain.schema, text
        assert fast._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 0
    for text in ("()-[:K]->()<-[:K]-()", "(a:P)-[:K]->(b:P)-[:K]->(c:P)", "(a:P)-[:K]->(b:P)<-[:K]-(a)", "(a:P)-[:K]->(b)<-[:L]-(c:P)", "(a:P)-[:K]->(b)<-[:K]-(c:Q)"):
        assert g.cypher(f"MATCH {text} RETURN count(*) AS n").collect() == g.cypher(f"MATCH {text} WHERE 1 = 1 RETURN count(*) AS n").collect(), text


def test_types_of_hops_need_no_lookup(spark):
    g = PropertyGraph(spark).with_nodes("P", spark.range(4).toDF("k"), "k").with_rels("K", spark.createDataFrame([(0, 1, 5), (1, 2, 7), (2, 3, 9)], "a long, b long, w long"), ("P", "a"), ("P", "b"), ["w"])
    types = g.cypher("MATCH (a:P)-[r:K*2..2]->(b:P) RETURN [x IN r | type(x)] AS t, any(x IN r WHERE id(x) IS NULL) AS n, count(*) AS k")
    assert [tuple(x) for x in types.collect()] == [(["K", "K"], False, 2)]
    assert "posexplode" not in types._jdf.queryExecution().optimizedPlan().toString()
    weights = g.cypher("MATCH (a:P)-[r:K*2..2]->(b:P) RETURN a.k AS k, [x IN r | x.w] AS w, [x IN r WHERE type(x) = 'K' | x.w + 1] AS v ORDER BY k")
    assert [tuple(x) for x in weights.collect()] == [(0, [5, 7], [6, 8]), (1, [7, 9], [8, 10])]
