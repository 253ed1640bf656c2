"""Procedures for CALL: name to a function of the graph and constants that returns rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph
from loomgraph.operators.ddl import listing

PROCEDURES: dict[str, Callable[..., DataFrame]] = {}


def register_procedure(name: str, fn: Callable[..., DataFrame]) -> None:
    if name.lower() in PROCEDURES:
        raise ValueError(f"procedure {name} is registered already")
    PROCEDURES[name.lower()] = fn


def _names(graph: PropertyGraph, column: str, names) -> DataFrame:
    return graph.spark.createDataFrame([(n,) for n in sorted(set(names))], f"{column} string")


def _properties(graph: PropertyGraph):
    tables = [*graph.nodes.values(), *[r.df for r in graph.rels.values()]]
    return {c for df in tables for c in df.columns if c not in ("id", "src", "dst", "_labels")}


def _statistics(graph: PropertyGraph) -> DataFrame:
    out = None
    for kind, own in (("node", graph.nodes), ("relationship", {k: r.df for k, r in graph.rels.items()})):
        for name, df in sorted(own.items()):
            row = df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "count")
            out = row if out is None else out.union(row)
    return out


def _schema(graph: PropertyGraph) -> DataFrame:
    return graph.spark.createDataFrame([(r.src_label, k, r.dst_label) for k, r in sorted(graph.rels.items())], "source string, type string, target string")


register_procedure("db.labels", lambda g: _names(g, "label", g.nodes))
register_procedure("db.relationshipTypes", lambda g: _names(g, "relationshipType", g.rels))
register_procedure("db.propertyKeys", lambda g: _names(g, "propertyKey", _properties(g)))
register_procedure("db.indexes", lambda g: listing(g, "INDEX"))
register_procedure("db.constraints", lambda g: listing(g, "CONSTRAINT"))
register_procedure("db.schema.visualization", _schema)
register_procedure("db.stats.refresh", _statistics)
