"""Property graphs over DataFrames: one table per node label and per relationship type."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Room for the keys of one label.
LABEL_SHIFT = 1 << 48


def placed(df: DataFrame) -> bool:
    """Whether the rows are a file's as they are, so that each has a place there."""
    try:
        return bool(df.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:
        return False


@dataclass
class Rel:
    """Edges of one type: columns id, src, dst and properties; the labels of both ends where they are known."""

    df: DataFrame
    src_label: str | None = None
    dst_label: str | None = None


def widest(types: list[T.DataType]) -> T.DataType:
    """A type that holds a property of several tables: numbers widen, else text."""
    kinds = {t.simpleString() for t in types}
    if len(kinds) == 1:
        return types[0]
    if all(isinstance(t, T.NumericType) for t in types):
        return T.DoubleType() if any(isinstance(t, (T.FractionalType,)) for t in types) else T.LongType()
    return T.StringType()


@dataclass
class PropertyGraph:
    """An immutable graph version; writes return another one.

    nodes: label to table with a graph-wide bigint ``id`` and property columns; a table may hold a column ``_labels`` with
    all labels of each node, else its nodes have the one label.  rels: type to Rel.
    """

    spark: SparkSession
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    rels: dict[str, Rel] = field(default_factory=dict)
    keys: dict[str, tuple[str, int]] = field(default_factory=dict)
    constraints: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    indexes: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)

    # -- building
    def with_nodes(self, label: str, df: DataFrame, key: str) -> PropertyGraph:
        """Nodes by an integer key (or any other, by its hash); the key stays a property."""
        number = self.keys[label][1] if label in self.keys else len(self.keys)
        out = replace(self, nodes=dict(self.nodes), keys=dict(self.keys))
        out.keys[label] = (key, number)
        out.nodes[label] = df.select(out.node_id(label, F.col(key), df.schema[key].dataType).alias("id"), *[F.col(c) for c in df.columns if c != "id"])
        return out

    def node_id(self, label: str, key: Column, kind: T.DataType | None = None) -> Column:
        number = self.keys[label][1]
        if kind is not None and not isinstance(kind, T.IntegralType):
            key = F.pmod(F.xxhash64(key), F.lit(LABEL_SHIFT))
        return F.lit(number * LABEL_SHIFT) + key.cast("long")

    def with_rels(self, kind: str, df: DataFrame, src: tuple[str, str], dst: tuple[str, str], props: list[str] | None = None, key: str | None = None) -> PropertyGraph:
        """Edges from (label, column) to (label, column); ids come from ``key``, else from a row's place in its file, else from
        the row and its number among equal ones, so equal parallel edges stay apart."""
        if key:
            ident = F.xxhash64(F.lit(kind), F.col(key))
        elif placed(df):
            ident = F.xxhash64(F.lit(kind), F.col("_metadata.file_path"), F.col("_metadata.row_index"))
        else:
            own = [F.col(c) for c in df.columns]
            ident = F.xxhash64(F.lit(kind), *own, F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(1))))
        ends = [self.node_id(label, F.col(c), df.schema[c].dataType) for label, c in (src, dst)]
        rows = df.where(F.col(src[1]).isNotNull() & F.col(dst[1]).isNotNull()).select(ident.alias("id"), ends[0].alias("src"), ends[1].alias("dst"), *[F.col(c) for c in (props or [])])
        out = replace(self, rels=dict(self.rels))
        out.rels[kind] = Rel(rows, src[0], dst[0])
        return out

    # -- scans
    def labels(self) -> list[str]:
        return sorted(self.nodes)

    def scan(self, labels: list[str], props: set[str] | None) -> DataFrame:
        """Nodes that have all ``labels``: id, labels and the wanted properties (None: all)."""
        tables = []
        for owner, df in self.nodes.items():
            several = "_labels" in df.columns
            if not several and any(lab != owner for lab in labels):
                continue
            own = F.col("_labels") if several else F.array(F.lit(owner))
            rows = df
            for lab in labels if several else ():
                rows = rows.where(F.array_contains("_labels", lab))
            tables.append((rows, own))
        return self._together(tables, props, ["id"], "labels")

    def edges(self, types: list[str], props: set[str] | None) -> DataFrame:
        """Edges of the types (none: all): id, src, dst, type and the wanted properties."""
        return self._together([(r.df, F.lit(k)) for k, r in self.rels.items() if not types or k in types], props, ["id", "src", "dst"], "type")

    def _together(self, tables: list, props: set[str] | None, fixed: list[str], mark: str) -> DataFrame:
        kinds: dict[str, list] = {}
        for df, _ in tables:
            for f in df.schema:
                if f.name not in (*fixed, "_labels") and (props is None or f.name in props):
                    kinds.setdefault(f.name, []).append(f.dataType)
        out = None
        for df, m in tables:
            cols = [F.col(c) for c in fixed] + [m.alias("#" + mark)]
            for p, ts in sorted(kinds.items()):
                t = widest(ts)
                cols.append((F.col(p) if p in df.columns else F.lit(None)).cast(t).alias("." + p))
            rows = df.select(*cols)
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            kind = "array<string>" if mark == "labels" else "string"
            out = self.spark.createDataFrame([], ", ".join(f"{c} bigint" for c in fixed) + f", `#{mark}` {kind}")
        return out

    # -- queries
    def cypher(self, text: str, params: dict | None = None) -> DataFrame:
        """Rows of a read query; a write query's rows, the new version being its graph (see execute)."""
        return self.execute(text, params)[0]

    def execute(self, text: str, params: dict | None = None) -> tuple[DataFrame, PropertyGraph]:
        from loomgraph.plans.emit import run

        return run(self, text, params or {})

    def match(self):
        from loomgraph.operators.fluent import PatternQuery

        return PatternQuery(self)


def tables_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The relational tables as a graph."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    g = PropertyGraph(spark)
    for label, name, key in (("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Order", "orders", "o_orderkey")):
        g = g.with_nodes(label, t[name], key)
    g = g.with_rels("IN_REGION", t["nation"], ("Nation", "n_nationkey"), ("Region", "n_regionkey"), key="n_nationkey")
    g = g.with_rels("CUST_NATION", t["customer"], ("Customer", "c_custkey"), ("Nation", "c_nationkey"), key="c_custkey")
    g = g.with_rels("SUPP_NATION", t["supplier"], ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), key="s_suppkey")
    g = g.with_rels("PLACED", t["orders"], ("Customer", "o_custkey"), ("Order", "o_orderkey"), key="o_orderkey")
    # (l_orderkey, l_linenumber) is no key; whole rows are distinct.
    props = [c for c in t["lineitem"].columns if c not in ("l_orderkey", "l_partkey", "l_suppkey")]
    g = g.with_rels("CONTAINS", t["lineitem"], ("Order", "l_orderkey"), ("Part", "l_partkey"), props)
    g = g.with_rels("SUPPLIED_BY", t["lineitem"], ("Part", "l_partkey"), ("Supplier", "l_suppkey"), props)
    pairs = t["lineitem"].select("l_partkey", "l_suppkey").distinct()
    return g.with_rels("SUPPLIES", pairs, ("Supplier", "l_suppkey"), ("Part", "l_partkey"))
