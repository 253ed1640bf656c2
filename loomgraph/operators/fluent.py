"""Fluent pattern queries: match().vertex(...).out(...).collect()."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class PatternQuery:
    """Each step returns a new query over the set of node ids reached so far."""

    def __init__(self, graph, df: DataFrame | None = None):
        self.graph, self.df = graph, df

    def vertex(self, label: str | None = None, *, props: dict | None = None, ranges: dict | None = None) -> PatternQuery:
        """Keep nodes with the label, equal properties and property ranges (low, high), both ends included, None open."""
        names = {*(props or {}), *(ranges or {})}
        rows = self.graph.scan([label] if label else [], names)
        for k, v in (props or {}).items():
            rows = rows.where(F.col(f"`.{k}`") == v) if f".{k}" in rows.columns else rows.where("false")
        for k, (lo, hi) in (ranges or {}).items():
            if lo is not None:
                rows = rows.where(F.col(f"`.{k}`") >= lo)
            if hi is not None:
                rows = rows.where(F.col(f"`.{k}`") <= hi)
        ids = rows.select("id")
        return PatternQuery(self.graph, ids if self.df is None else self.df.join(ids, "id", "left_semi"))

    def _step(self, types: tuple, a: str, b: str) -> DataFrame:
        base = self.df if self.df is not None else self.graph.scan([], set()).select("id")
        return base.join(self.graph.edges(list(types), set()).select("src", "dst"), F.col("id") == F.col(a)).select(F.col(b).alias("n"))

    def out(self, *types: str) -> PatternQuery:
        return PatternQuery(self.graph, self._step(types, "src", "dst").select(F.col("n").alias("id")).distinct())

    def into(self, *types: str) -> PatternQuery:
        return PatternQuery(self.graph, self._step(types, "dst", "src").select(F.col("n").alias("id")).distinct())

    def both(self, *types: str) -> PatternQuery:
        rows = self._step(types, "src", "dst").union(self._step(types, "dst", "src"))
        return PatternQuery(self.graph, rows.select(F.col("n").alias("id")).distinct())

    def node_ids(self) -> DataFrame:
        return self.df

    def cardinality(self) -> int:
        return self.df.count()

    def collect(self, props: set[str] | None = None) -> DataFrame:
        """The reached nodes with their labels and properties."""
        rows = self.graph.scan([], props).join(self.df, "id", "left_semi")
        return rows.select(*[F.col(f"`{c}`").alias(c.lstrip("#.")) for c in rows.columns])
