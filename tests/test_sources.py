"""Round trips through each format, and the registered queries' contract."""

import __spark_entry__
from loomgraph import sources
from loomgraph.graph import PropertyGraph


def _graph(spark):
    n = spark.createDataFrame([(1, "a<b", 1.5), (2, 'q"', None)], "k int, name string, x double")
    return PropertyGraph(spark).with_nodes("P", n, "k").with_rels("R", spark.createDataFrame([(1, 2, 7)], "a int, b int, w int"), ("P", "a"), ("P", "b"), ["w"])


def test_snapshot(spark, tmp_path):
    g = _graph(spark)
    sources.write_snapshot(g, str(tmp_path / "s"))
    back = sources.read_snapshot(spark, str(tmp_path / "s"))
    q = "MATCH (a:P)-[r:R]->(b:P) RETURN a.name AS a, r.w AS w, b.x AS x"
    assert back.cypher(q).collect() == g.cypher(q).collect()


def test_text_formats(spark, tmp_path):
    g = _graph(spark)
    sources.write_jsonl(g, str(tmp_path / "j"))
    got = sources.read_jsonl(spark, str(tmp_path / "j"))
    assert {k: v.count() for k, v in got.items()} == {"nodes": 2, "edges": 1, "properties": 5}
    sources.write_graphml(g, str(tmp_path / "g"))
    xml = sources.read_graphml(spark, str(tmp_path / "g"))
    assert {r["data"]["node.name"] for r in xml["nodes"].collect()} == {"a<b", 'q"'} and xml["edges"].count() == 1
    e = spark.createDataFrame([("a", "b", 2.0), ("=x", "c", 1.0)], "src string, dst string, weight double")
    sources.write_edge_csv(e, str(tmp_path / "c"), sanitise=True)
    assert {r["src"] for r in sources.read_edge_csv(spark, str(tmp_path / "c")).collect()} == {"a", "'=x"}
    sources.write_dot(e, str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).count() == 4


def test_jsonl_keeps_edge_weights(spark, tmp_path):
    n = spark.createDataFrame([(1,), (2,)], "k int")
    g = PropertyGraph(spark).with_nodes("P", n, "k").with_rels("R", spark.createDataFrame([(1, 2, 2.5), (2, 1, None)], "a int, b int, weight double"), ("P", "a"), ("P", "b"), ["weight"])
    sources.write_jsonl(g, str(tmp_path / "j"))
    assert sorted(r["weight"] for r in sources.read_jsonl(spark, str(tmp_path / "j"))["edges"].collect()) == [1.0, 2.5]


def test_bulk_import(spark, tmp_path):
    (tmp_path / "n.csv").write_text("id,name\n1,A\n2,B\n")
    (tmp_path / "e.csv").write_text("src,dst,type,since\n1,2,KNOWS,2000\n2,1,LIKES,2001\n")
    g = sources.bulk_import(spark, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"), type_column="type")
    assert [tuple(r) for r in g.cypher("MATCH (a)-[r:LIKES]->(b) RETURN a.name AS a, r.since AS s, b.name AS b").collect()] == [("B", 2001, "A")]


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 5
