"""Readers and writers of graphs: CSV edge lists, JSON Lines, GraphML, DOT, Parquet snapshots and bulk import."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph, Rel


def read_edge_csv(spark: SparkSession, path: str, *, delimiter: str = ",", header: bool = False, weighted: bool | None = None, directed: bool = True, multigraph: bool = True, comment: str = "#") -> DataFrame:
    """src,dst[,weight] with comment lines; the weight is 1.0 where it is missing."""
    schema = "src string, dst string" + (", weight double" if weighted is not False else "")
    rows = spark.read.csv(path, schema=schema, sep=delimiter, header=header, comment=comment, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = rows.where("src is not null and dst is not null")
    if weighted is not False:
        rows = rows.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    if not directed:
        rows = rows.unionByName(rows.where("src <> dst").withColumns({"src": F.col("dst"), "dst": F.col("src")}))
    return rows if multigraph else rows.dropDuplicates(["src", "dst"])


def safe_cell(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a quote in front."""
    return F.when(c.cast("string").rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c.cast("string"))).otherwise(c.cast("string"))


def write_edge_csv(edges: DataFrame, path: str, *, delimiter: str = ",", header: bool = False, sanitise: bool = False) -> None:
    cols = [c for c in ("src", "dst", "weight") if c in edges.columns]
    edges.select(*[safe_cell(F.col(c)).alias(c) if sanitise and c != "weight" else F.col(c) for c in cols]).write.csv(path, sep=delimiter, header=header, mode="overwrite")


JSONL = "type string, id string, src string, dst string, weight double, label string, labels array<string>, key string, value string, kind string"


def read_jsonl(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Node, edge and property records; property values stay text beside their kind (see typed_value)."""
    rows = spark.read.json(path, schema=JSONL)
    return {
        "nodes": rows.where("type = 'node'").select("id", "labels"),
        "edges": rows.where("type = 'edge'").select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"), "label"),
        "properties": rows.where("type = 'property'").select("id", "key", "value", "kind"),
    }


def typed_value(kind: str, value: Column) -> Column:
    return value.try_cast({"string": "string", "int64": "bigint", "float64": "double", "bool": "boolean", "time": "timestamp", "bytes": "binary"}[kind])


def write_jsonl(graph: PropertyGraph, path: str) -> None:
    out = None
    for labels, df in graph.nodes.items():
        own = F.col("_labels") if "_labels" in df.columns else F.array(F.lit(labels))
        parts = [F.to_json(F.struct(F.lit("node").alias("type"), F.col("id").cast("string").alias("id"), own.alias("labels")))]
        for f in df.schema:
            if f.name not in ("id", "_labels"):
                kind = {"long": "int64", "integer": "int64", "double": "float64", "float": "float64", "boolean": "bool", "timestamp": "time", "timestamp_ntz": "time", "date": "time"}.get(f.dataType.typeName(), "string")
                record = F.to_json(F.struct(F.lit("property").alias("type"), F.col("id").cast("string").alias("id"), F.lit(f.name).alias("key"), F.col(f.name).cast("string").alias("value"), F.lit(kind).alias("kind")))
                parts.append(F.when(F.col(f.name).isNotNull(), record))
        rows = df.select(F.explode(F.array_compact(F.array(*parts))).alias("value"))
        out = rows if out is None else out.union(rows)
    for kind, r in graph.rels.items():
        rows = r.df.select(F.to_json(F.struct(F.lit("edge").alias("type"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), *([F.col("weight").cast("double").alias("weight")] if "weight" in r.df.columns else []), F.lit(kind).alias("label"))).alias("value"))
        out = rows if out is None else out.union(rows)
    out.write.mode("overwrite").text(path)


def read_graphml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nodes and edges with their data elements as a map of key to text, and the key declarations."""
    data = "data array<struct<_key:string,_VALUE:string>>"
    pick = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(d["_key"], d["_VALUE"]))).alias("data")
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return {
        "nodes": read("node", f"_id string, {data}").select(F.col("_id").alias("id"), pick),
        "edges": read("edge", f"_source string, _target string, {data}").select(F.col("_source").alias("src"), F.col("_target").alias("dst"), pick),
        "keys": read("key", "_id string, `_attr.name` string, `_attr.type` string, _for string").select(F.col("_id").alias("id"), F.col("`_attr.name`").alias("name"), F.col("`_attr.type`").alias("type"), F.col("_for").alias("for")),
    }


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def write_graphml(graph: PropertyGraph, path: str, *, props: bool = True) -> None:
    """One part file: rows are ordered into sections, header and footer included."""
    spark = graph.spark
    kinds: dict[tuple[str, str], str] = {}
    body = None
    for tag, tables in (("node", list(graph.nodes.values())), ("edge", [r.df for r in graph.rels.values()])):
        for df in tables:
            cells = []
            for f in df.schema if props else ():
                if f.name not in ("id", "src", "dst", "_labels"):
                    kinds[tag, f.name] = {"long": "long", "integer": "long", "double": "double", "float": "double", "boolean": "boolean"}.get(f.dataType.typeName(), "string")
                    cells.append(F.when(F.col(f.name).isNotNull(), F.concat(F.lit(f"<data key={quoteattr(tag + '.' + f.name)}>"), _xml(F.col(f.name).cast("string")), F.lit("</data>"))).otherwise(""))
            head = F.concat(F.lit('<node id="n'), F.col("id").cast("string"), F.lit('">')) if tag == "node" else F.concat(F.lit('<edge source="n'), F.col("src").cast("string"), F.lit('" target="n'), F.col("dst").cast("string"), F.lit('">'))
            rows = df.select(F.lit(1 if tag == "node" else 2).alias("o"), F.concat(head, *cells, F.lit(f"</{tag}>")).alias("value"))
            body = rows if body is None else body.union(rows)
    keys = [f"<key id={quoteattr(t + '.' + n)} for={quoteattr(t)} attr.name={quoteattr(n)} attr.type={quoteattr(k)}/>" for (t, n), k in sorted(kinds.items())]
    edge = spark.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + "".join(keys) + '<graph edgedefault="directed">'), (3, "</graph></graphml>")], "o int, value string")
    edge.union(body).orderBy("o").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_dot(edges: DataFrame, path: str, *, name: str = "G", directed: bool = True) -> None:
    arrow = "->" if directed else "--"
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    weight = F.concat(F.lit(" [label="), F.col("weight").cast("string"), F.lit("]")) if "weight" in edges.columns else F.lit("")
    rows = edges.select(F.lit(1).alias("o"), F.concat(F.lit("  "), q("src"), F.lit(f" {arrow} "), q("dst"), weight, F.lit(";")).alias("value"))
    frame = edges.sparkSession.createDataFrame([(0, f"{'digraph' if directed else 'graph'} {json.dumps(name)} {{"), (2, "}")], "o int, value string")
    frame.union(rows).orderBy("o").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_snapshot(graph: PropertyGraph, path: str) -> None:
    """A Parquet folder per label and type (edges sorted by src within files) and a manifest read by Spark."""
    entries = []
    for label, df in graph.nodes.items():
        df.write.mode("overwrite").parquet(f"{path}/nodes/{label or '_'}")
        entries.append(("node", label, None, None))
    for kind, r in graph.rels.items():
        r.df.repartition("src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/rels/{kind}")
        entries.append(("rel", kind, r.src_label, r.dst_label))
    keys = json.dumps({"keys": graph.keys, "constraints": graph.constraints, "indexes": graph.indexes})
    rows = [(*e, None) for e in entries] + [("meta", "", None, None, keys)]
    graph.spark.createDataFrame(rows, "kind string, name string, src string, dst string, meta string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_snapshot(spark: SparkSession, path: str) -> PropertyGraph:
    g = PropertyGraph(spark)
    for r in spark.read.json(f"{path}/manifest", schema="kind string, name string, src string, dst string, meta string").collect():
        if r["kind"] == "node":
            g.nodes[r["name"] or ""] = spark.read.parquet(f"{path}/nodes/{r['name'] or '_'}")
        elif r["kind"] == "rel":
            g.rels[r["name"]] = Rel(spark.read.parquet(f"{path}/rels/{r['name']}"), r["src"], r["dst"])
        else:
            meta = json.loads(r["meta"])
            g.keys = {k: tuple(v) for k, v in meta["keys"].items()}
            g.constraints = {k: tuple(v) for k, v in meta["constraints"].items()}
            g.indexes = {k: tuple(v) for k, v in meta["indexes"].items()}
    return g


def bulk_import(spark: SparkSession, nodes: str, edges: str, *, key: str = "id", label: str = "Node", label_column: str | None = None, src: str = "src", dst: str = "dst", type_column: str | None = None, kind: str = "EDGE", infer: bool = True) -> PropertyGraph:
    """Node and edge CSV files with headers; labels and types from a column or a default."""
    n = spark.read.csv(nodes, header=True, inferSchema=infer)
    e = spark.read.csv(edges, header=True, inferSchema=infer)
    g = PropertyGraph(spark).with_nodes(label, n, key)
    if label_column:
        g.nodes[label] = g.nodes[label].withColumn("_labels", F.split(F.coalesce(F.col(label_column).cast("string"), F.lit(label)), "[;|:]"))
    props = [c for c in e.columns if c not in (src, dst, type_column)]
    kinds = [r[0] for r in e.select(type_column).distinct().collect()] if type_column else [kind]
    for k in kinds:
        rows = e.where(F.col(type_column) == k) if type_column else e
        g = g.with_rels(k, rows, (label, src), (label, dst), props)
    return g


__all__ = ["bulk_import", "escape", "read_edge_csv", "read_graphml", "read_jsonl", "read_snapshot", "safe_cell", "typed_value", "write_dot", "write_edge_csv", "write_graphml", "write_jsonl", "write_snapshot"]
