"""Emission of parsed queries as DataFrame plans.

A frame holds one column per value variable, and for node and relationship variables the columns ``v#id`` (and labels,
type, ends) and ``v.prop`` for the properties the query uses, so that Catalyst prunes scans and pushes filters down.
Subqueries become joins on the outer variables they use; nothing runs per row.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import scalar as S
from loomgraph.graph import PropertyGraph
from loomgraph.iterate import cut
from loomgraph.plans import parser as P

AGGREGATES = frozenset("count sum avg min max collect stdev stdevp percentilecont percentiledisc".split())
#: Hops of an unbounded pattern, and rows of one of its levels.
MAX_HOPS, MAX_ROWS = 64, 100_000_000
#: Functions that give nodes or relationships.
ENTITY_CALLS = frozenset("startnode endnode nodes relationships rels".split())
_fresh = itertools.count()


class CypherError(ValueError):
    pass


def c(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Binding:
    kind: str  # node, rel, rels, value, path
    labels: list[str] = field(default_factory=list)
    parts: tuple = ()


@dataclass
class Frame:
    df: DataFrame
    vars: dict[str, Binding]

    def cols(self, var: str) -> list[str]:
        if self.vars[var].kind in ("value", "path"):
            return [var]
        return [x for x in self.df.columns if x.startswith((f"{var}#", f"{var}."))]

    def keys(self, var: str) -> list[str]:
        return [f"{var}#id"] if self.vars[var].kind in ("node", "rel") else self.cols(var)


def walk(e):
    """All tuples inside an expression, patterns and clauses included."""
    if isinstance(e, tuple):
        yield e
        for x in e:
            yield from walk(x)
    elif isinstance(e, list):
        for x in e:
            yield from walk(x)
    elif isinstance(e, dict):
        for x in e.values():
            yield from walk(x)
    elif hasattr(e, "__dataclass_fields__"):
        for f in e.__dataclass_fields__:
            yield from walk(getattr(e, f))


def variables(e) -> set[str]:
    out = {x[1] for x in walk(e) if len(x) == 2 and x[0] == "var" and isinstance(x[1], str)}
    stack = [e]
    while stack:
        x = stack.pop()
        if isinstance(x, (P.NodePattern, P.RelPattern)) and x.var:
            out.add(x.var)
        if hasattr(x, "__dataclass_fields__"):
            stack += [getattr(x, f) for f in x.__dataclass_fields__]
        elif isinstance(x, (tuple, list)):
            stack += list(x)
        elif isinstance(x, dict):
            stack += list(x.values())
    return out


def has_aggregate(e) -> bool:
    return any(x[0] == "call" and isinstance(x[1], str) and x[1].lower() in AGGREGATES for x in walk(e) if len(x) == 4)


def entity_call(e) -> bool:
    return isinstance(e, tuple) and len(e) == 4 and e[0] == "call" and e[1].lower() in ENTITY_CALLS


def by_identity(var: str, e) -> bool:
    """Whether an expression asks no more of a relationship than its type and identity."""
    if isinstance(e, tuple) and len(e) == 4 and e[0] == "call" and e[1].lower() in ("type", "id") and e[3] == [("var", var)]:
        return True
    if e == ("var", var):
        return False
    return all(by_identity(var, y) for y in (e.values() if isinstance(e, dict) else e)) if isinstance(e, (tuple, list, dict)) else not hasattr(e, "__dataclass_fields__")


def entity_kind(t: T.DataType) -> str | None:
    """Whether values of the type are nodes or relationships."""
    names = t.names if isinstance(t, T.StructType) else []
    return "node" if names[:2] == ["id", "labels"] else "rel" if names[:4] == ["id", "type", "start", "end"] else None


class Emitter:
    def __init__(self, graph: PropertyGraph, params: dict, query: P.Query):
        self.g, self.params, self.spark = graph, params, graph.spark
        self.local: dict[str, Column] = {}
        self.local_types: dict[str, T.DataType] = {}
        self.tied: list[tuple] = []
        props = {x[2] for x in walk(query) if len(x) == 3 and x[0] == "prop" and isinstance(x[2], str)}
        props |= {k for x in walk(query) if len(x) == 2 and x[0] == "map" and isinstance(x[1], dict) for k in x[1]}
        props |= {i[1] for x in walk(query) if len(x) == 3 and x[0] == "mapproj" for i in x[2] if i[0] == "own"}
        # Maps in parameters may be patterns' properties.
        mapped = {k for v in self.params.values() if isinstance(v, dict) for k in v}
        self.props = None if self._whole(query) else props | mapped

    def _whole(self, query) -> bool:
        """Whether an entity is used as a whole, so that all properties are needed."""
        entities, stack = set(), [query]
        while stack:
            x = stack.pop()
            if isinstance(x, (P.NodePattern, P.RelPattern)) and x.var:
                entities.add(x.var)
            if isinstance(x, (P.Create, P.Merge, P.SetClause, P.Remove, P.Delete)):
                return True
            if isinstance(x, P.Projection) and x.star:
                return True
            if isinstance(x, tuple) and x and x[0] in ("idx",):
                return True
            if isinstance(x, tuple) and x and x[0] in ("listcomp", "quant", "reduce"):
                entities.add(x[{"listcomp": 1, "quant": 2, "reduce": 3}[x[0]]])
            if isinstance(x, P.Unwind):
                entities.add(x.var)
            if hasattr(x, "__dataclass_fields__"):
                stack += [getattr(x, f) for f in x.__dataclass_fields__]
            elif isinstance(x, dict):
                stack += list(x.values())
            elif isinstance(x, (list, tuple)):
                stack += list(x)

        def bare(x) -> bool:
            if isinstance(x, tuple) and x:
                if x[0] == "var" and len(x) == 2:
                    return x[1] in entities
                if x[0] in ("prop", "labels") and x[1][0:1] == ("var",):
                    return any(bare(y) for y in x[2:] if isinstance(y, tuple))
                if x[0] == "mapproj":
                    return any(i[0] == "all" for i in x[2]) or any(bare(i[2]) for i in x[2] if i[0] == "key")
                if entity_call(x):
                    return True
                if x[0] == "prop" and entity_call(x[1]):
                    return False
                if x[0] == "call" and len(x) == 4 and x[1].lower() in ("id", "elementid", "labels", "type", "count", "length", "size") and all(y[0] == "var" or entity_call(y) for y in x[3]):
                    return False
                if x[0] == "bin" and x[1] in ("=", "<>", "IN") and all(y[0] == "var" or entity_call(y) for y in x[2:]):
                    return False
                if x[0] in ("listcomp", "quant", "reduce") and (entity_call(src := x[{"listcomp": 2, "quant": 3, "reduce": 4}[x[0]]]) or src[0] == "var"):
                    return x[0] == "listcomp" and x[4] is None or any(bare(y) for y in x[1:] if y is not src)
                if x[0] == "isnull":
                    return x[1][0] != "var" and bare(x[1])
                return any(bare(y) for y in x)
            if isinstance(x, list):
                return any(bare(y) for y in x)
            if isinstance(x, dict):
                return any(bare(y) for y in x.values())
            if isinstance(x, P.Unwind) and entity_call(x.expr):
                return False
            if isinstance(x, P.Projection):
                # Passing an entity on in WITH keeps its columns; only a RETURN of it needs them all.
                items = [e for e, _ in x.items if x.final or e[0] != "var"]
                return bare(items) or bare([e for e, _ in x.order if e[0] != "var"]) or (x.where is not None and bare(x.where))
            if hasattr(x, "__dataclass_fields__"):
                return any(bare(getattr(x, f)) for f in x.__dataclass_fields__)
            return False

        return bare(query)

    # -- clauses
    def start(self) -> Frame:
        return Frame(self.spark.range(1).select(F.lit(1).alias("#one")), {})

    def clauses(self, clauses: list, frame: Frame | None = None) -> Frame:
        if frame is None and (counted := self.pairs_counted(clauses)) is not None:
            return counted
        frame = frame or self.start()
        for x in clauses:
            if isinstance(x, P.Match):
                frame = self.optional(x, frame) if x.optional else self.match(x, frame)
            elif isinstance(x, P.Projection):
                frame = self.project(x, frame)
            elif isinstance(x, P.Unwind):
                frame, items = self.lifted(frame, x.expr, unwound=True)
                frame = Frame(frame.df.withColumn(x.var, F.explode(self.listed(items, frame))), frame.vars | {x.var: Binding("value")})
            elif isinstance(x, P.Call):
                frame = self.call(x, frame)
            else:
                from loomgraph.operators.writes import apply_write

                frame = apply_write(self, x, frame)
        return frame

    def pairs_counted(self, clauses: list) -> Frame | None:
        """count(*) of two alike hops that meet in a node, and nothing else asked: of k edges there, k * (k - 1) pairs."""
        if len(clauses) != 2 or not isinstance(clauses[0], P.Match) or not isinstance(clauses[1], P.Projection):
            return None
        m, p = clauses
        if m.optional or m.where or len(m.paths) != 1 or p.star or p.distinct or p.order or p.skip or p.limit or p.where:
            return None
        if any(e != ("call", "count", False, [("star",)]) for e, _ in p.items) or len({n for _, n in p.items}) < len(p.items):
            return None
        nodes, rels = m.paths[0].nodes, m.paths[0].rels
        if len(rels) != 2 or m.paths[0].var or m.paths[0].shortest or any(r.length is not None or r.props is not None for r in rels) or any(n.props is not None for n in nodes):
            return None
        if not nodes[0].var or not nodes[2].var or nodes[1].labels and not nodes[1].var:
            return None  # not all of these are looked up
        named = [x.var for x in (*nodes, *rels) if x.var]
        turned = {"out": "in", "in": "out", "both": "both"}[rels[0].direction]
        if len(set(named)) < len(named) or sorted(rels[0].types) != sorted(rels[1].types) or turned != rels[1].direction or sorted(nodes[0].labels) != sorted(nodes[2].labels):
            return None
        half = self.oriented(rels[1], False, False).select("#from", "#to")
        for n, end in ((nodes[2], "#to"), (nodes[1], "#from")):
            if n.var:  # as in arrive, such a node must be there
                half = half.join(self.g.scan(n.labels, set()).select(F.col("id").alias("#node")), c(end) == c("#node"), "left_semi")
        k = half.groupBy("#from").agg(F.count(F.lit(1)).alias("k"))
        n = k.agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1)), F.lit(0)).cast("long").alias("n"))
        return Frame(n.select(*[F.col("n").alias(name) for _, name in p.items]), {name: Binding("value") for _, name in p.items})

    def listed(self, x: Column, frame: Frame) -> Column:
        """What UNWIND goes over: null has no rows, a value that is no list has one."""
        t = self.dtype(frame, x)
        if isinstance(t, T.NullType):
            return F.lit(None).cast("array<string>")
        return x if isinstance(t, T.ArrayType) else F.when(x.isNotNull(), F.array(x))

    def match(self, m: P.Match, frame: Frame) -> Frame:
        edges: list[tuple[str, list[str], bool]] = []
        before, self.tied = self.tied, [x for x in self.conjuncts(m.where) if x[0] == "bin" and x[1] == "=" and all(y[0] == "prop" and y[1][0] == "var" for y in x[2:])]
        for path in m.paths:
            frame = self.path(path, frame, edges)
        self.tied = before
        return self.filter(frame, m.where) if m.where else frame

    def conjuncts(self, cond: tuple | None) -> list[tuple]:
        parts, stack = [], [cond] if cond else []
        while stack:
            x = stack.pop()
            if x[0] == "bin" and x[1] == "AND":
                stack += [x[3], x[2]]
            else:
                parts.append(x)
        return parts

    def keys_to(self, frame: Frame, var: str, rows: DataFrame) -> list[tuple[str, str]]:
        """Columns of the frame that WHERE sets equal to columns of a node about to be joined."""
        found = []
        for _, _, x, y in self.tied:
            for (_, (_, v), p), (_, (_, w), q) in ((x, y), (y, x)):
                have, new = f"{v}.{p}", f"{w}.{q}"
                if w == var and v in frame.vars and have in frame.df.columns and new in rows.columns:
                    t = frame.df.schema[have].dataType
                    if t == rows.schema[new].dataType and isinstance(t, (T.IntegralType, T.StringType)):
                        found.append((have, new))
        return found

    def filter(self, frame: Frame, cond: tuple) -> Frame:
        # top-level conjuncts one by one: existential ones become semi joins
        for x in self.conjuncts(cond):
            negated = x[0] == "un" and x[1] == "NOT"
            inner = x[2] if negated else x
            if inner[0] in ("pattern", "exists") and (inner[0] != "pattern" or not inner[1].shortest):
                frame = self.semi(frame, inner, "left_anti" if negated else "left_semi")
            else:
                frame, col = self.lifted(frame, x)
                frame = Frame(frame.df.where(col), frame.vars)
        return frame

    def scan(self, var: str, labels: list[str]) -> DataFrame:
        df = self.g.scan(labels, self.props)
        return df.select(*[c(x).alias(f"{var}#id" if x == "id" else f"{var}{x}") for x in df.columns])

    def anonymous(self, p) -> str:
        if not p.var:
            p.var = f"_{next(_fresh)}"
        return p.var

    def promoted(self, frame: Frame, var: str) -> Frame:
        """A variable whose value is a node or relationship becomes one that patterns may use."""
        if var not in frame.vars or frame.vars[var].kind != "value":
            return frame
        t = frame.df.schema[var].dataType
        kind = entity_kind(t)
        if kind is None:
            return frame
        fixed = {"id": "id", "labels": "labels"} if kind == "node" else {"id": "id", "type": "type", "src": "start", "dst": "end"}
        cols = {f"{var}#{k}": c(var)[n] for k, n in fixed.items()} | {f"{var}.{n}": c(var)[n] for n in t.names[len(fixed) :]}
        return Frame(frame.df.withColumns(cols), frame.vars | {var: Binding(kind)})

    def items(self, props: tuple | None) -> dict:
        """A pattern's properties as expressions, written out or from a parameter."""
        if props is None:
            return {}
        return props[1] if props[0] == "map" else {k: ("lit", v) for k, v in self.params[props[1]].items()}

    def with_props(self, frame: Frame, var: str, props: tuple | None) -> Frame:
        for k, v in self.items(props).items():
            frame = Frame(frame.df.where(self.equal(self.ex(("prop", ("var", var), k), frame), self.ex(v, frame), frame)), frame.vars)
        return frame

    def node(self, frame: Frame, n: P.NodePattern) -> Frame:
        """The node pattern joined to what is bound so far."""
        var = self.anonymous(n)
        if var in frame.vars:
            if frame.vars[var].kind != "node":
                raise CypherError(f"{var} is no node")
            for lab in n.labels:
                frame = Frame(frame.df.where(F.array_contains(c(f"{var}#labels"), lab)), frame.vars)
        else:
            rows = self.scan(var, n.labels)
            df = rows.withColumn("#one", F.lit(1)) if not frame.vars and frame.df.columns == ["#one"] else frame.df.crossJoin(rows)
            frame = Frame(df, frame.vars | {var: Binding("node", list(n.labels))})
        return self.with_props(frame, var, n.props)

    def path(self, p: P.PathPattern, frame: Frame, edges: list) -> Frame:
        for n in p.nodes:
            self.anonymous(n)
        for r in p.rels:
            self.anonymous(r)
        for x in (*p.nodes, *p.rels):
            frame = self.promoted(frame, x.var)
        if p.shortest:
            return self.shortest(p, frame)
        at = next((i for i, n in enumerate(p.nodes) if n.var in frame.vars), None)
        if at is None:  # the node that most narrows the scan leads
            at = max(range(len(p.nodes)), key=lambda i: (p.nodes[i].props is not None, len(p.nodes[i].labels), -i))
        frame = self.node(frame, p.nodes[at])
        for i in range(at, len(p.rels)):
            frame = self.expand(frame, p.nodes[i], p.rels[i], p.nodes[i + 1], False, edges)
        for i in range(at - 1, -1, -1):
            frame = self.expand(frame, p.nodes[i + 1], p.rels[i], p.nodes[i], True, edges)
        if p.var:
            frame = self.bind_path(frame, p)
        return frame

    def bind_path(self, frame: Frame, p: P.PathPattern) -> Frame:
        nodes, rels = F.array(c(f"{p.nodes[0].var}#id")), F.array().cast("array<struct<id:bigint,type:string,start:bigint,end:bigint>>")
        for r, n in zip(p.rels, p.nodes[1:], strict=True):
            if frame.vars[r.var].kind == "rels":
                hops, own = c(f"{r.var}#nodes"), c(f"{r.var}#rels")
                if frame.vars[r.var].parts == ("reversed",):
                    hops, own = F.concat(F.slice(F.reverse(hops), 2, F.greatest(F.size(hops) - 1, F.lit(0))), F.when(F.size(hops) > 0, F.array(c(f"{n.var}#id"))).otherwise(F.array().cast("array<bigint>"))), F.reverse(own)
                nodes, rels = F.concat(nodes, hops), F.concat(rels, own)
            else:
                nodes, rels = F.concat(nodes, F.array(c(f"{n.var}#id"))), F.concat(rels, F.array(self.rel_struct(r.var)))
        return Frame(frame.df.withColumn(p.var, F.struct(nodes.alias("nodes"), rels.alias("rels"))), frame.vars | {p.var: Binding("path")})

    def rel_struct(self, var: str) -> Column:
        return F.struct(c(f"{var}#id").alias("id"), c(f"{var}#type").alias("type"), c(f"{var}#src").alias("start"), c(f"{var}#dst").alias("end"))

    def oriented(self, r: P.RelPattern, backwards: bool, props: bool) -> DataFrame:
        """Edges as (#from, #to, id, type, src, dst, properties); a self-loop comes once whatever the direction."""
        known = self.props if props else set()
        e = self.g.edges(r.types, known if known is None else known | set(self.items(r.props)))
        direction = {"out": "in", "in": "out", "both": "both"}[r.direction] if backwards else r.direction
        out, back = e.withColumn("#from", F.col("src")).withColumn("#to", F.col("dst")), e.withColumn("#from", F.col("dst")).withColumn("#to", F.col("src"))
        return out if direction == "out" else back if direction == "in" else out.unionByName(back.where("src <> dst"))

    def expand(self, frame: Frame, a: P.NodePattern, r: P.RelPattern, b: P.NodePattern, backwards: bool, edges: list) -> Frame:
        if r.length is not None:
            return self.expand_many(frame, a, r, b, backwards, edges)
        e = self.oriented(r, backwards, True)
        names = {"id": f"{r.var}#id", "src": f"{r.var}#src", "dst": f"{r.var}#dst", "#type": f"{r.var}#type", "#from": "#from", "#to": "#to"}
        e = e.select(*[c(x).alias(names.get(x, f"{r.var}{x}")) for x in e.columns])
        if r.var in frame.vars:  # the relationship is bound: its ends decide
            e = e.select(c(f"{r.var}#id").alias("#bound"), "#from", "#to")
            df = frame.df.join(e, (c(f"{a.var}#id") == c("#from")) & (c(f"{r.var}#id") == c("#bound"))).drop("#bound")
        else:
            rows = None if b.var in frame.vars else self.scan(b.var, b.labels)
            keys = [] if rows is None else self.keys_to(frame, b.var, rows)
            on = c(f"{a.var}#id") == c("#from")
            if keys:  # the far node first, so that what WHERE sets equal narrows the join and not its rows
                e = e.join(rows, c("#to") == c(f"{b.var}#id"))
                for have, new in keys:
                    on &= c(have) == c(new)
            df = frame.df.join(e, on)
            if keys:
                frame = Frame(frame.df, frame.vars | {b.var: Binding("node", list(b.labels))})
                b = P.NodePattern(b.var, [], b.props)
        frame = Frame(df.drop("#from"), frame.vars | {r.var: frame.vars.get(r.var, Binding("rel", list(r.types)))})
        for other, types, many in edges:
            if not types or not r.types or set(types) & set(r.types):
                frame = Frame(frame.df.where(~F.array_contains(c(f"{other}#ids"), c(f"{r.var}#id")) if many else c(f"{other}#id") != c(f"{r.var}#id")), frame.vars)
        edges.append((r.var, r.types, False))
        frame = self.with_props(frame, r.var, r.props)
        return self.arrive(frame, b, r)

    def arrive(self, frame: Frame, b: P.NodePattern, r: P.RelPattern | None = None) -> Frame:
        if b.var in frame.vars:
            frame = Frame(frame.df.where(c(f"{b.var}#id") == c("#to")).drop("#to"), frame.vars)
            return self.node(frame, b)
        if b.var.startswith("_") and b.props is None and (not b.labels or r is not None and self._implied(r, b.labels)):
            # Nobody asks for more than the node's identity, and edges have no loose ends.
            df = frame.df.withColumn(f"{b.var}#id", c("#to")).withColumn(f"{b.var}#labels", F.array(*[F.lit(x) for x in b.labels]).cast("array<string>")).drop("#to")
            return Frame(df, frame.vars | {b.var: Binding("node", list(b.labels))})
        rows = self.scan(b.var, b.labels)
        df = frame.df.join(rows, c("#to") == c(f"{b.var}#id")).drop("#to")
        return self.with_props(Frame(df, frame.vars | {b.var: Binding("node", list(b.labels))}), b.var, b.props)

    def _implied(self, r: P.RelPattern, labels: list[str]) -> bool:
        """Whether every edge of the types ends, on both sides an anonymous node could be, at nodes of the one label."""
        if len(labels) != 1 or not r.types or r.direction == "both":
            return False
        return all(k in self.g.rels and labels[0] == self.g.rels[k].dst_label == self.g.rels[k].src_label for k in r.types)

    def expand_many(self, frame: Frame, a: P.NodePattern, r: P.RelPattern, b: P.NodePattern, backwards: bool, edges: list) -> Frame:
        """Trails: no edge twice, nodes may repeat.  A bounded pattern unrolls into joins; an unbounded one goes on level by level."""
        lo, hi = r.length
        e = self.oriented(r, backwards, r.props is not None)
        e = self.held(e, r)
        one = F.struct(F.col("id"), c("#type").alias("type"), F.col("src").alias("start"), F.col("dst").alias("end"))
        e = e.select("#from", F.col("#to").alias("#next"), F.col("id").alias("#e"), one.alias("#r"))
        empty = {"#ids": F.array().cast("array<bigint>"), "#rels": F.array().cast("array<struct<id:bigint,type:string,start:bigint,end:bigint>>"), "#nodes": F.array().cast("array<bigint>")}
        level = frame.df.withColumns({f"{r.var}{k}": v for k, v in empty.items()}).withColumn("#to", c(f"{a.var}#id"))
        found, k = [level] if lo == 0 else [], 0
        while hi is None or k < hi:
            grown = level.join(e, c("#to") == c("#from")).where(~F.array_contains(c(f"{r.var}#ids"), c("#e")))
            grown = grown.withColumns({f"{r.var}#ids": F.array_append(c(f"{r.var}#ids"), c("#e")), f"{r.var}#rels": F.array_append(c(f"{r.var}#rels"), c("#r")), f"{r.var}#nodes": F.array_append(c(f"{r.var}#nodes"), c("#next")), "#to": c("#next")})
            level = grown.drop("#from", "#next", "#e", "#r")
            k += 1
            if hi is None:
                level = cut(level)
                n = level.count()
                if n > MAX_ROWS:
                    raise CypherError(f"a variable-length pattern has more than {MAX_ROWS} trails of length {k}")
                if not n:
                    break
                if k >= MAX_HOPS:
                    raise CypherError(f"a variable-length pattern goes on beyond {MAX_HOPS} hops")
            if k >= lo:
                found.append(level)
        df = found[0] if found else level.where("false")
        for x in found[1:]:
            df = df.unionByName(x)
        for other, types, many in edges:
            if not types or not r.types or set(types) & set(r.types):
                df = df.where(~(F.arrays_overlap(c(f"{other}#ids"), c(f"{r.var}#ids")) if many else F.array_contains(c(f"{r.var}#ids"), c(f"{other}#id"))))
        edges.append((r.var, r.types, True))
        return self.arrive(Frame(df, frame.vars | {r.var: Binding("rels", parts=("reversed",) if backwards else ())}), b)

    def held(self, e: DataFrame, r: P.RelPattern) -> DataFrame:
        """Edges with the pattern's properties, which are constants where the pattern is more than one hop."""
        for k, v in self.items(r.props).items():
            e = e.where(c(f".{k}") == F.lit(self.value(v))) if f".{k}" in e.columns else e.where("false")
        return e

    def shortest(self, p: P.PathPattern, frame: Frame) -> Frame:
        """Level-synchronous search from all starting nodes at once; of equal paths one is the least by edge ids."""
        a, r, b = p.nodes[0], p.rels[0], p.nodes[1]
        frame = self.node(self.node(frame, a), b)
        lo, hi = r.length or (1, 1)
        pairs = cut(frame.df.select(c(f"{a.var}#id").alias("s"), c(f"{b.var}#id").alias("t")).distinct())
        one = F.struct(F.col("id"), c("#type").alias("type"), F.col("src").alias("start"), F.col("dst").alias("end"))
        e = self.held(self.oriented(r, False, r.props is not None), r).select("#from", F.col("#to").alias("next"), one.alias("e"))
        level = pairs.select("s", F.col("s").alias("at")).distinct().withColumn("rels", F.array().cast("array<struct<id:bigint,type:string,start:bigint,end:bigint>>")).withColumn("nodes", F.array("s"))
        seen = level.select("s", "at")
        found = level.join(pairs, (level["s"] == pairs["s"]) & (F.col("at") == F.col("t"))).select(level["s"].alias("s"), "t", "rels", "nodes") if lo == 0 else None
        k = 0
        while hi is None or k < hi:
            grown = level.join(e, F.col("at") == c("#from")).select("s", F.col("next").alias("at"), F.array_append("rels", F.col("e")).alias("rels"), F.array_append("nodes", F.col("next")).alias("nodes"))
            grown = grown.join(seen, ["s", "at"], "left_anti")
            if p.shortest == "one":
                grown = grown.groupBy("s", "at").agg(F.min(F.struct("rels", "nodes")).alias("m")).select("s", "at", "m.rels", "m.nodes")
            level = cut(grown)
            k += 1
            hit = level.join(pairs, (level["s"] == pairs["s"]) & (F.col("at") == F.col("t"))).select(level["s"].alias("s"), "t", "rels", "nodes")
            found = hit if found is None else found.unionByName(hit)
            seen = cut(seen.unionByName(level.select("s", "at").distinct()))
            if not level.limit(1).count():
                break
            if k >= MAX_HOPS and hi is None:
                raise CypherError(f"a shortest path goes on beyond {MAX_HOPS} hops")
        df = frame.df.join(found.withColumnRenamed("s", "#s").withColumnRenamed("t", "#t"), (c(f"{a.var}#id") == c("#s")) & (c(f"{b.var}#id") == c("#t"))).drop("#s", "#t")
        df = df.withColumn(f"{r.var}#rels", F.col("rels")).withColumn(f"{r.var}#ids", F.transform("rels", lambda x: x["id"])).withColumn(f"{r.var}#nodes", F.slice("nodes", F.lit(2), F.size("rels")))
        bound = {r.var: Binding("rels")}
        if p.var:
            df = df.withColumn(p.var, F.struct("nodes", "rels"))
            bound[p.var] = Binding("path")
        return Frame(df.drop("rels", "nodes"), frame.vars | bound)

    # -- subqueries as joins
    def outer(self, frame: Frame, used: set[str]) -> tuple[Frame, list[str], list[str]]:
        """Distinct values of the outer variables a subquery uses, the key columns, and the variables."""
        own = sorted(v for v in used if v in frame.vars)
        keys = [k for v in own for k in frame.keys(v)]
        cols = [x for v in own for x in frame.cols(v)]
        if not own:
            return self.start(), [], []
        df = frame.df.select(*map(c, cols)).dropDuplicates(keys)
        return Frame(df.withColumn("#one", F.lit(1)), {v: frame.vars[v] for v in own}), keys, own

    def joined(self, frame: Frame, inner: DataFrame, keys: list[str], how: str) -> DataFrame:
        if not keys:
            return frame.df.join(inner, F.lit(True), how)
        inner = inner.select(*[c(k).alias(f"#k{i}") for i, k in enumerate(keys)], *[c(x) for x in inner.columns if x not in keys])
        # Identities are null only behind an optional match, where the pattern has no match either way.
        on = None
        for i, k in enumerate(keys):
            one = c(k) == c(f"#k{i}") if k.endswith("#id") and how in ("left_semi", "left_anti") else c(k).eqNullSafe(c(f"#k{i}"))
            on = one if on is None else on & one
        out = frame.df.join(inner, on, how)
        return out if how in ("left_semi", "left_anti") else out.drop(*[f"#k{i}" for i in range(len(keys))])

    def inner(self, frame: Frame, e: tuple) -> tuple[Frame, list[str]]:
        clauses = [P.Match([e[1]])] if e[0] == "pattern" else e[1]
        start, keys, _ = self.outer(frame, variables(e))
        if clauses and isinstance(clauses[-1], P.Projection) and clauses[-1].final and not has_aggregate([x for x, _ in clauses[-1].items]):
            clauses = clauses[:-1]
        return self.clauses(clauses, start), keys

    def semi(self, frame: Frame, e: tuple, how: str) -> Frame:
        inside, keys = self.inner(frame, e)
        rows = inside.df.select(*map(c, keys)) if keys else inside.df.limit(1).select(F.lit(1).alias("#hit"))
        return Frame(self.joined(frame, rows, keys, how), frame.vars)

    def entities(self, frame: Frame, ids: Column, kind: str, many: bool) -> tuple[Frame, str]:
        """The frame with a column of the entities that ids name, in their order; distinct lists are looked up once."""
        name = f"#sub{next(_fresh)}"
        rows = self.g.scan([], self.props) if kind == "node" else self.g.edges([], self.props)
        fixed = {"id": "id", "#labels": "labels"} if kind == "node" else {"id": "id", "#type": "type", "src": "start", "dst": "end"}
        whole = F.struct(*[c(k).alias(n) for k, n in fixed.items()], *[c(x).alias(x[1:]) for x in rows.columns if x.startswith(".")])
        known = rows.select(F.col("id").alias("#eid"), whole.alias("#entity"))
        df = frame.df.withColumn("#ids", ids)
        if not many:
            return Frame(df.join(known, c("#ids") == c("#eid"), "left").withColumnRenamed("#entity", name).drop("#ids", "#eid"), frame.vars), name
        each = df.select("#ids").where(F.size("#ids") > 0).distinct().select("#ids", F.posexplode("#ids").alias("#pos", "#eid")).join(known, "#eid")
        lists = each.groupBy(c("#ids").alias("#key")).agg(F.sort_array(F.collect_list(F.struct("#pos", "#entity")))["#entity"].alias(name))
        none = F.when(c("#ids").isNotNull(), F.array().cast(lists.schema[name].dataType))
        df = df.join(lists, c("#ids") == c("#key"), "left").withColumn(name, F.coalesce(c(name), none))
        return Frame(df.drop("#ids", "#key"), frame.vars), name

    def entities_of(self, frame: Frame, e: tuple) -> tuple[Frame, str] | None:
        """What a call of nodes, relationships, startNode or endNode gives, if e is one over this frame."""
        if not entity_call(e) or len(e[3]) != 1 or self.local:
            return None
        what, arg = e[1].lower(), e[3][0]
        kind = frame.vars[arg[1]].kind if arg[0] == "var" and arg[1] in frame.vars else None
        if what in ("startnode", "endnode"):
            return self.entities(frame, self.variable_part(arg, "src" if what == "startnode" else "dst", frame), "node", False)
        if kind != "path":
            return None
        if what == "nodes":
            return self.entities(frame, c(arg[1])["nodes"], "node", True)
        return self.entities(frame, F.transform(c(arg[1])["rels"], lambda r: r["id"]), "rel", True)

    def lifted(self, frame: Frame, e: tuple, unwound: bool = False) -> tuple[Frame, Column]:
        """The expression over a frame to which the results of its subqueries, and entities it names, are joined."""

        def source(x):
            nonlocal frame
            if x[0] == "var" and x[1] in frame.vars and frame.vars[x[1]].kind == "rels":
                frame, name = self.entities(frame, F.transform(self.variable(x[1], frame), lambda r: r["id"]), "rel", True)
                return ("var", name)
            return lift(x)

        def lift(x):
            nonlocal frame
            if isinstance(x, tuple) and x and x[0] in ("pattern", "exists", "count", "patcomp") and not (x[0] == "count" and len(x) != 2):
                if x[0] == "call":
                    return x
                name = f"#sub{next(_fresh)}"
                if x[0] == "patcomp":
                    _, path, cond, body = x
                    start, keys, _ = self.outer(frame, variables(x))
                    inside = self.match(P.Match([path], cond), start)
                    inside, col = self.lifted(inside, body)
                    rows = inside.df.select(*map(c, keys), col.alias("#v")).groupBy(*map(c, keys)).agg(F.collect_list("#v").alias(name))
                    kind = rows.schema[name].dataType
                    frame = Frame(self.joined(frame, rows, keys, "left"), frame.vars)
                    frame = Frame(frame.df.withColumn(name, F.coalesce(c(name), F.array().cast(kind))), frame.vars)
                elif x[0] == "pattern" and x[1].shortest:
                    x[1].var = x[1].var or name + "p"
                    start, keys, _ = self.outer(frame, variables(x))
                    inside = self.shortest_in(x[1], start)
                    rows = inside.df.select(*map(c, keys), c(x[1].var).alias(name))
                    frame = Frame(self.joined(frame, rows, keys, "left"), frame.vars)
                else:
                    inside, keys = self.inner(frame, x)
                    rows = inside.df.groupBy(*map(c, keys)).agg(F.count(F.lit(1)).alias(name))
                    frame = Frame(self.joined(frame, rows, keys, "left"), frame.vars)
                    n = F.coalesce(c(name), F.lit(0).cast("long"))
                    frame = Frame(frame.df.withColumn(name, n if x[0] == "count" else n > 0), frame.vars)
                return ("var", name)
            if isinstance(x, tuple) and x and x[0] in ("listcomp", "quant", "reduce"):  # what follows the list sees its elements
                at = {"listcomp": 2, "quant": 3, "reduce": 4}[x[0]]
                first = (lift(x[2]),) if x[0] == "reduce" else x[2:at][:1]
                hops = x[at][0] == "var" and x[at][1] in frame.vars and frame.vars[x[at][1]].kind == "rels" and by_identity(x[at - 1], x[at + 1 :])
                return (*x[:2], *first, *x[2 + len(first) : at], x[at] if hops else source(x[at]), *x[at + 1 :])
            if isinstance(x, tuple) and len(x) == 4 and x[0] == "call" and x[1].lower() in ("size", "length", "id") and all(map(entity_call, x[3])):
                return x  # identities will do
            if (found := self.entities_of(frame, x)) is not None:
                frame = found[0]
                return ("var", found[1])
            return tuple(lift(y) for y in x) if isinstance(x, tuple) else [lift(y) for y in x] if isinstance(x, list) else {k: lift(v) for k, v in x.items()} if isinstance(x, dict) else x

        e = source(e) if e[0] == "var" and unwound else lift(e)
        return frame, self.ex(e, frame)

    def shortest_in(self, p: P.PathPattern, frame: Frame) -> Frame:
        for n in (*p.nodes, *p.rels):
            self.anonymous(n)
        return self.shortest(p, frame)

    def optional(self, m: P.Match, frame: Frame) -> Frame:
        if not frame.vars:
            inside = self.match(m, self.start())
            base, keys = self.spark.range(1).select(F.lit(1).alias("#one")), []
            frame = Frame(base, {})
        else:
            start, keys, _ = self.outer(frame, variables([m.paths, m.where]))
            inside = self.match(m, start)
        new = [v for v in inside.vars if v not in frame.vars]
        cols = [x for v in new for x in inside.cols(v)]
        rows = inside.df.select(*map(c, keys), *map(c, cols))
        return Frame(self.joined(frame, rows, keys, "left"), frame.vars | {v: inside.vars[v] for v in new})

    def call(self, x: P.Call, frame: Frame) -> Frame:
        from loomgraph.operators.procedures import PROCEDURES

        if x.name.lower() not in PROCEDURES:
            raise CypherError(f"unknown procedure {x.name}")
        rows = PROCEDURES[x.name.lower()](self.g, *[self.value(a) for a in x.args])
        pick = x.yields or [(n, n) for n in rows.columns]
        rows = rows.select(*[F.col(n).alias(a) for n, a in pick])
        df = rows.withColumn("#one", F.lit(1)) if not frame.vars else frame.df.crossJoin(rows)
        frame = Frame(df, frame.vars | {a: Binding("value") for _, a in pick})
        return self.filter(frame, x.where) if x.where else frame

    def value(self, e: tuple):
        """A constant of the query or a parameter."""
        if e[0] == "lit":
            return e[1]
        if e[0] == "param":
            return self.params[e[1]]
        if e[0] == "list":
            return [self.value(x) for x in e[1]]
        if e[0] == "map":
            return {k: self.value(v) for k, v in e[1].items()}
        if e[0] == "un":
            return -self.value(e[2])
        return self.spark.range(1).select(self.ex(e, self.start())).first()[0]

    def project(self, p: P.Projection, frame: Frame) -> Frame:
        items = list(p.items)
        if p.star:
            if not frame.vars and not items:
                raise CypherError("nothing to project")
            items = [(("var", v), v) for v in frame.vars if not v.startswith(("_", "#"))] + items
        names = [n for _, n in items]
        if len(set(names)) < len(names):
            raise CypherError("two columns have one name")
        grouped = any(has_aggregate(e) for e, _ in items)
        order = []
        if grouped:
            frame, values, bound = self.aggregate(items, frame)
        else:
            cols, bound, values = {}, {}, {}
            for e, name in items:
                if e[0] == "var" and e[1] in frame.vars and frame.vars[e[1]].kind in ("node", "rel", "rels"):
                    for x in frame.cols(e[1]):
                        cols["\0" + name + x[len(e[1]) :]] = c(x)
                    bound[name] = frame.vars[e[1]]
                else:
                    frame, col = self.lifted(frame, e)
                    cols["\0" + name] = col
                    bound[name] = frame.vars[e[1]] if e[0] == "var" and e[1] in frame.vars else Binding("value")
            # Both old and new columns stay until rows are ordered.
            df = frame.df.select("*", *[v.alias(k) for k, v in cols.items()])
            new = list(cols)
            if p.distinct:
                keys = [k for k in new if not any(k.startswith(("\0" + n + "#", "\0" + n + ".")) and not k == "\0" + n + "#id" for n, b in bound.items() if b.kind in ("node", "rel"))]
                df = df.select(*map(c, new)).dropDuplicates(keys)
            for e, down in p.order:
                match = next((n for x, n in items if x == e and bound[n].kind == "value"), None)
                if match is None and e[0] == "var" and e[1] in bound and bound[e[1]].kind == "value":
                    match = e[1]
                if match is not None:
                    col = c("\0" + match)
                elif p.distinct:
                    col = self.ex(e, Frame(df.select(*[c(k).alias(k[1:]) for k in new]), bound), rename="\0")
                else:
                    own = Frame(df, frame.vars)
                    alias = {n: b for n, b in bound.items() if n not in frame.vars}
                    if variables(e) & set(alias):
                        df = df.withColumns({k[1:]: c(k) for k in new if k[1:] not in df.columns})
                        own = Frame(df, frame.vars | alias)
                    col = self.ex(e, own)
                order.append(col.desc_nulls_first() if down else col.asc_nulls_last())
            df = self.tail(df, p, order).select(*[c(k).alias(k[1:]) for k in new])
            out = Frame(df if df.columns else df, bound)
            return self.filter(out, p.where) if p.where else out
        for e, down in p.order:
            match = next((n for x, n in items if x == e), None)
            col = self.ex(("var", match) if match and bound[match].kind == "value" else e, Frame(frame.df, bound))
            order.append(col.desc_nulls_first() if down else col.asc_nulls_last())
        out = Frame(self.tail(frame.df, p, order), bound)
        return self.filter(out, p.where) if p.where else out

    def tail(self, df: DataFrame, p: P.Projection, order: list[Column]) -> DataFrame:
        if order:
            df = df.orderBy(*order)
        for e, what in ((p.skip, "SKIP"), (p.limit, "LIMIT")):
            if e is not None:
                n = self.value(e)
                if not isinstance(n, int) or isinstance(n, bool) or n < 0:
                    raise CypherError(f"{what} needs an integer that is not negative")
                df = df.offset(n) if what == "SKIP" else df.limit(n)
        return df

    def aggregate(self, items: list, frame: Frame) -> tuple[Frame, dict, dict]:
        keys, aggs, bound, extra = [], [], {}, []
        for e, name in items:
            if has_aggregate(e):
                continue
            if e[0] == "var" and e[1] in frame.vars and frame.vars[e[1]].kind in ("node", "rel"):
                keys.append((name + "#id", c(f"{e[1]}#id")))  # the other columns depend on the identity
                extra += [(name + x[len(e[1]) :], c(x)) for x in frame.cols(e[1]) if x != f"{e[1]}#id"]
                bound[name] = frame.vars[e[1]]
            else:
                frame, col = self.lifted(frame, e)
                keys.append((name, col))
                bound[name] = frame.vars[e[1]] if e[0] == "var" and e[1] in frame.vars else Binding("value")
        for e, name in items:
            if has_aggregate(e):
                frame, col = self.lifted(frame, e)
                aggs.append(col.alias(name))
                bound[name] = Binding("value")
        df = frame.df.groupBy(*[col.alias(n) for n, col in keys]).agg(*aggs, *[F.first(col).alias(n) for n, col in extra])
        return Frame(df, frame.vars), {}, {n: bound[n] for _, n in items}

    # -- expressions
    def dtype(self, frame: Frame, col: Column) -> T.DataType:
        return frame.df.select(col.alias("x")).schema["x"].dataType if not self.local else self._dtype_local(frame, col)

    def _dtype_local(self, frame: Frame, col: Column) -> T.DataType:
        try:
            return frame.df.select(col.alias("x")).schema["x"].dataType
        except Exception:  # noqa: BLE001  a lambda's variable has no type outside of it
            return T.NullType()

    def ex(self, e: tuple, frame: Frame, rename: str = "") -> Column:
        kind = e[0]
        if kind == "lit":
            v = e[1]
            if isinstance(v, (list, tuple)):
                return F.array(*[self.ex(("lit", x), frame) for x in v])
            if isinstance(v, dict):
                return F.struct(*[self.ex(("lit", x), frame).alias(k) for k, x in v.items()])
            return F.lit(v).cast("long") if isinstance(v, int) and not isinstance(v, bool) else F.lit(v)
        if kind == "param":
            if e[1] not in self.params:
                raise CypherError(f"missing parameter ${e[1]}")
            return self.ex(("lit", self.params[e[1]]), frame)
        if kind == "var":
            return self.variable(e[1], frame, rename)
        if kind == "prop":
            return self.property(e, frame, rename)
        if kind == "call":
            return self.function(e, frame)
        if kind == "bin":
            return self.binary(e, frame)
        if kind == "un":
            x = self.ex(e[2], frame)
            return ~x if e[1] == "NOT" else -x
        if kind == "isnull":
            x = self.ex(("call", "id", False, [e[1]]), frame) if e[1][0] == "var" and e[1][1] in frame.vars and frame.vars[e[1][1]].kind in ("node", "rel") and e[1][1] not in self.local else self.ex(e[1], frame)
            return x.isNotNull() if e[2] else x.isNull()
        if kind == "list":
            return F.array(*[self.ex(x, frame) for x in e[1]])
        if kind == "map":
            return F.struct(*[self.ex(v, frame).alias(k) for k, v in e[1].items()]) if e[1] else F.struct()
        if kind == "idx":
            base = self.ex(e[1], frame)
            if e[2][0] == "lit" and isinstance(e[2][1], str):
                return self.property(("prop", e[1], e[2][1]), frame)
            i = self.ex(e[2], frame)
            return F.try_element_at(base, F.when(i < 0, i).otherwise(i + 1).cast("int"))
        if kind == "slice":
            base, n = self.ex(e[1], frame), F.size(self.ex(e[1], frame))
            a = F.lit(0) if e[2] is None else self.ex(e[2], frame)
            b = n if e[3] is None else self.ex(e[3], frame)
            a, b = (F.least(F.greatest(F.when(x < 0, x + n).otherwise(x), F.lit(0)), n).cast("int") for x in (a, b))
            return F.slice(base, a + 1, F.greatest(b - a, F.lit(0)))
        if kind == "case":
            out = None
            for w, t in e[2]:
                cond = self.ex(w, frame).cast("boolean") if e[1] is None else self.equal(self.ex(e[1], frame), self.ex(w, frame), frame)
                out = F.when(cond, self.ex(t, frame)) if out is None else out.when(cond, self.ex(t, frame))
            return out if e[3] is None else out.otherwise(self.ex(e[3], frame))
        if kind in ("listcomp", "quant"):
            src = self.ex(e[3] if kind == "quant" else e[2], frame)
            var, cond = (e[2], e[4]) if kind == "quant" else (e[1], e[3])
            if isinstance(t := self.dtype(frame, src), T.ArrayType):
                self.local_types[var] = t.elementType
            test = lambda x: self.inside({var: x}, cond, frame)
            if kind == "quant":
                if e[1] == "all":
                    return F.forall(src, test)
                if e[1] == "any":
                    return F.exists(src, test)
                if e[1] == "none":
                    return ~F.exists(src, test)
                yes, unknown = F.size(F.filter(src, test)), F.exists(src, lambda x: test(x).isNull())
                return F.when(yes > 1, False).when(unknown, None).otherwise(yes == 1)
            if cond is not None:
                src = F.filter(src, test)
            return src if e[4] is None else F.transform(src, lambda x: self.inside({var: x}, e[4], frame))
        if kind == "reduce":
            _, acc, first, var, src, body = e
            start, items = self.ex(first, frame), self.ex(src, frame)
            t = self.dtype(frame, start)
            if isinstance(t, T.IntegralType) and "double" in self.dtype(frame, items).simpleString():
                start = start.cast("double")
            kinds = self.dtype(frame, items)
            self.local_types |= {acc: t} | ({var: kinds.elementType} if isinstance(kinds, T.ArrayType) else {})
            return F.aggregate(items, start, lambda a, x: self.inside({acc: a, var: x}, body, frame))
        if kind == "labels":
            own = self.variable_part(e[1], "labels", frame)
            out = None
            for lab in e[2]:
                one = F.array_contains(own, lab)
                out = one if out is None else out & one
            return out
        if kind == "mapproj":
            fields = []
            for i in e[2]:
                if i[0] == "all":
                    fields += [c(x).alias(x.split(".", 1)[1]) for x in frame.cols(e[1][1]) if "." in x]
                else:
                    fields.append(self.ex(("prop", e[1], i[1]) if i[0] == "own" else ("var", i[1]) if i[0] == "var" else i[2], frame).alias(i[1]))
            return F.struct(*fields)
        if kind in ("pattern", "exists", "count", "patcomp"):
            raise CypherError("a subquery is not supported in this place")
        raise CypherError(f"unknown expression {kind}")

    def inside(self, local: dict[str, Column], e: tuple, frame: Frame) -> Column:
        was, self.local = self.local, self.local | local
        try:
            return self.ex(e, frame)
        finally:
            self.local = was

    def variable(self, v: str, frame: Frame, rename: str = "") -> Column:
        if v in self.local:
            return self.local[v]
        b = frame.vars.get(v)
        if b is None:
            if v.startswith("#sub"):
                return c(v)
            raise CypherError(f"unknown variable {v}")
        if b.kind == "node":
            props = [x for x in frame.cols(v) if "." in x]
            whole = [c(rename + x).alias(x.split(".", 1)[1]) for x in props]
            return F.when(c(f"{rename}{v}#id").isNotNull(), F.struct(c(f"{rename}{v}#id").alias("id"), c(f"{rename}{v}#labels").alias("labels"), *whole))
        if b.kind == "rel":
            props = [x for x in frame.cols(v) if "." in x]
            return F.when(c(f"{rename}{v}#id").isNotNull(), F.struct(*[c(f"{rename}{v}#{k}").alias(a) for k, a in (("id", "id"), ("type", "type"), ("src", "start"), ("dst", "end"))], *[c(rename + x).alias(x.split(".", 1)[1]) for x in props]))
        if b.kind == "rels":  # in the pattern's order, whichever end the search began at
            return F.reverse(c(f"{rename}{v}#rels")) if b.parts == ("reversed",) else c(f"{rename}{v}#rels")
        return c(rename + v)

    def variable_part(self, e: tuple, part: str, frame: Frame) -> Column:
        if e[0] == "var" and e[1] not in self.local and e[1] in frame.vars and frame.vars[e[1]].kind in ("node", "rel"):
            return c(f"{e[1]}#{part}")
        x = self.ex(e, frame)
        return x[{"src": "start", "dst": "end"}.get(part, part)]

    def property(self, e: tuple, frame: Frame, rename: str = "") -> Column:
        base, key = e[1], e[2]
        if base[0] == "var" and base[1] not in self.local and base[1] in frame.vars and frame.vars[base[1]].kind in ("node", "rel"):
            name = f"{base[1]}.{key}"
            return c(rename + name) if name in frame.df.columns else F.lit(None)
        x = self.ex(base, frame, rename)
        t = self.local_types.get(base[1], T.NullType()) if base[0] == "var" and base[1] in self.local else self.dtype(frame, x)
        if entity_call(base) and not isinstance(t, T.StructType):
            raise CypherError(f"a property of {base[1]}() is not supported in this place")
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) and key in S.ACCESSORS:
            return S.ACCESSORS[key](x).cast("long")
        if t.simpleString() == S.DURATION and key in S.DURATION_ACCESSORS:
            return S.DURATION_ACCESSORS[key](x).cast("long")
        if isinstance(t, T.StructType) and key not in t.names or t.simpleString() == "void" and not self.local:
            return F.lit(None)
        return x[key]

    def equal(self, a: Column, b: Column, frame: Frame) -> Column:
        ta, tb = self.dtype(frame, a), self.dtype(frame, b)
        if isinstance(ta, T.NullType) and not self.local or isinstance(tb, T.NullType) and not self.local:
            return F.lit(None).cast("boolean")
        if entity_kind(ta) and entity_kind(ta) == entity_kind(tb):
            return a["id"] == b["id"]
        if isinstance(ta, T.ArrayType) and isinstance(tb, T.ArrayType):
            parts = F.aggregate(F.zip_with(a, b, lambda x, y: x == y), F.lit(True), lambda s, x: s & x)
            return F.when(F.size(a) != F.size(b), False).otherwise(parts)
        floats = (T.DoubleType, T.FloatType)
        if isinstance(ta, floats) and isinstance(tb, floats):
            return (a == b) & ~F.isnan(a)
        if {isinstance(ta, floats), isinstance(tb, floats)} == {True, False} and isinstance(ta if isinstance(tb, floats) else tb, T.LongType):
            i, d = (b, a) if isinstance(ta, floats) else (a, b)
            # Beyond 2**53 a double stands for many integers; only the exact one is equal.
            return (i.cast("double") == d) & ((F.abs(d) < 2.0**53) | (i == d.try_cast("decimal(38,0)").try_cast("long")))
        kinds = [("n" if isinstance(t, T.NumericType) else t.typeName()) for t in (ta, tb)]
        if kinds[0] != kinds[1] and {"string", "n"} == set(kinds) or {"boolean"} < set(kinds):
            return F.when(a.isNotNull() & b.isNotNull(), False)
        return a == b

    def binary(self, e: tuple, frame: Frame) -> Column:
        op = e[1]
        if op in ("AND", "OR", "XOR"):
            a, b = self.ex(e[2], frame), self.ex(e[3], frame)
            return a & b if op == "AND" else a | b if op == "OR" else a != b
        if op in ("=", "<>") and all(x[0] == "var" and x[1] in frame.vars and frame.vars[x[1]].kind in ("node", "rel") and x[1] not in self.local for x in e[2:]):
            same = c(f"{e[2][1]}#id") == c(f"{e[3][1]}#id")
            return same if op == "=" else ~same
        a, b = self.ex(e[2], frame), self.ex(e[3], frame)
        if op in ("=", "<>"):
            same = self.equal(a, b, frame)
            return same if op == "=" else ~same
        if op in ("<", "<=", ">", ">="):
            ta, tb = self.dtype(frame, a), self.dtype(frame, b)
            if not isinstance(ta, T.NullType) and not isinstance(tb, T.NullType) and {isinstance(ta, T.NumericType), isinstance(tb, T.NumericType)} == {True, False}:
                return F.lit(None).cast("boolean")
            out = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
            if isinstance(ta, T.DoubleType) and isinstance(tb, T.DoubleType):  # comparing with NaN is false
                out = F.when(F.isnan(a) | F.isnan(b), False).otherwise(out)
            return out
        if op == "IN":
            if e[3][0] == "list":
                if not e[3][1]:
                    return F.lit(False)
                out = None
                for x in e[3][1]:
                    one = self.equal(a, self.ex(x, frame), frame)
                    out = one if out is None else out | one
                return out
            tb = self.dtype(frame, b)
            if isinstance(tb, T.ArrayType) and entity_kind(tb.elementType) and entity_kind(tb.elementType) == entity_kind(self.dtype(frame, a)):
                return F.array_contains(F.transform(b, lambda x: x["id"]), a["id"])
            return F.array_contains(b, a)
        if op in ("STARTS WITH", "ENDS WITH", "CONTAINS"):
            if not all(isinstance(self.dtype(frame, x), (T.StringType, T.NullType)) for x in (a, b)):
                return F.lit(None).cast("boolean")
            return {"STARTS WITH": F.startswith, "ENDS WITH": F.endswith, "CONTAINS": F.contains}[op](a, b)
        if op == "=~":
            if e[3][0] in ("lit", "param"):  # a pattern that is none matches nothing
                try:
                    self.spark._jvm.java.util.regex.Pattern.compile(str(self.value(e[3])))
                except (Py4JJavaError, IllegalArgumentException):
                    return F.lit(None).cast("boolean")
            return F.rlike(a, F.concat(F.lit("\\A(?:"), b, F.lit(")\\z")))
        if op == "+" and self.local:
            known = [self.local_types.get(x[1]) if x[0] == "var" and x[1] in self.local else T.StringType() if x[0] == "lit" and isinstance(x[1], str) else None for x in e[2:]]
            if any(isinstance(t, T.StringType) for t in known):
                return F.concat(a.cast("string"), b.cast("string"))
            if any(isinstance(t, T.ArrayType) for t in known):
                return F.concat(*[F.array(x) if t is not None and not isinstance(t, T.ArrayType) else x for x, t in zip((a, b), known, strict=True)])
        return self.arithmetic(op, a, b, frame)

    def arithmetic(self, op: str, a: Column, b: Column, frame: Frame) -> Column:
        ta, tb = self.dtype(frame, a), self.dtype(frame, b)
        whole = isinstance(ta, T.IntegralType) and isinstance(tb, T.IntegralType)
        if op in "+-":
            for x, tx, d, td in ((a, ta, b, tb), (b, tb, a, ta)):
                if td.simpleString() == S.DURATION and isinstance(tx, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                    return S.add_duration(x, tx, d, 1 if op == "+" else -1)
            if ta.simpleString() == tb.simpleString() == S.DURATION:
                return F.struct(*[(a[k] + b[k] if op == "+" else a[k] - b[k]).cast("int" if k == "nanos" else "long").alias(k) for k in ("months", "days", "seconds", "nanos")])
        if op == "+":
            if isinstance(ta, T.ArrayType) or isinstance(tb, T.ArrayType):
                return F.concat(a if isinstance(ta, T.ArrayType) else F.array(a), b if isinstance(tb, T.ArrayType) else F.array(b))
            if isinstance(ta, T.StringType) or isinstance(tb, T.StringType):
                return F.concat(a.cast("string"), b.cast("string"))
            return a + b
        if op == "-":
            return a - b
        if op == "*":
            return a * b
        if op == "^":
            return F.pow(a.cast("double"), b.cast("double"))
        if op == "%":
            return F.when(b == 0, F.raise_error(F.lit("modulo by zero")).cast("long")).otherwise(a % F.when(b != 0, b)) if whole else a % F.when(b != 0, b)
        if whole:
            return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("long")).otherwise(F.when(b != 0, F.call_function("div", a, F.when(b != 0, b))))
        a, b = a.cast("double"), b.cast("double")
        none = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
        return F.when(b == 0, none).otherwise(a / F.when(b != 0, b))

    def function(self, e: tuple, frame: Frame) -> Column:
        name, distinct, args = e[1].lower(), e[2], e[3]
        if name in AGGREGATES:
            return self.aggregate_function(name, distinct, args, frame)
        first = args[0] if args else None
        entity = first is not None and first[0] == "var" and first[1] in frame.vars and first[1] not in self.local and frame.vars[first[1]].kind
        if name == "id" and entity_call(first):
            return self.ex(first, frame)
        if name == "id":
            return self.variable_part(first, "id", frame)
        if name == "elementid":
            return self.variable_part(first, "id", frame).cast("string")
        if name in ("labels", "type"):
            return self.variable_part(first, name, frame)
        if name in ("startnode", "endnode"):
            return self.variable_part(first, "src" if name == "startnode" else "dst", frame)
        if name in ("keys", "properties") and entity in ("node", "rel"):
            props = [x for x in frame.cols(first[1]) if "." in x]
            if name == "properties":
                return F.struct(*[c(x).alias(x.split(".", 1)[1]) for x in props])
            return F.array_compact(F.array(*[F.when(c(x).isNotNull(), F.lit(x.split(".", 1)[1])) for x in props]))
        if name == "keys":
            t = self.dtype(frame, self.ex(first, frame))
            return F.array(*[F.lit(n) for n in t.names]) if isinstance(t, T.StructType) else F.map_keys(self.ex(first, frame))
        if name in ("nodes", "relationships", "rels", "length") and entity == "path":
            x = c(first[1])
            return x["nodes"] if name == "nodes" else F.size(x["rels"]).cast("long") if name == "length" else x["rels"]
        if name == "exists":
            return self.ex(first, frame).isNotNull()
        if name in ("date", "datetime", "localdatetime", "time", "localtime", "duration"):
            return self.temporal(name, first, frame)
        if "." in name:
            kind, what = name.split(".", 1)
            if what == "truncate":
                return S.truncate(kind, self.value(first), self.ex(args[1], frame))
            if kind == "duration":
                return S.between(self.ex(args[0], frame), self.ex(args[1], frame), {"between": "", "inmonths": "months", "indays": "days", "inseconds": "seconds"}[what])
        cols = [self.ex(a, frame) for a in args]
        if name in ("length", "size"):
            return (F.length(cols[0]) if isinstance(self.dtype(frame, cols[0]), T.StringType) else F.when(cols[0].isNotNull(), F.size(cols[0]))).cast("long")
        if name == "isempty":
            return (F.length(cols[0]) if isinstance(self.dtype(frame, cols[0]), T.StringType) else F.size(cols[0])) == 0
        if name == "reverse":
            return F.reverse(cols[0])
        convert = {"tointeger": S.to_integer, "tofloat": lambda x, t: x.try_cast("double"), "tostring": S.to_string, "str": S.to_string, "toboolean": S.to_boolean}
        if name in convert:
            return convert[name](cols[0], self.dtype(frame, cols[0]))
        if name in ("tointegerlist", "tofloatlist", "tostringlist", "tobooleanlist"):
            t = self.dtype(frame, cols[0]).elementType
            return F.transform(cols[0], lambda x: convert[name[:-4]](x, t))
        if name in S.SIMPLE:
            if name == "abs" or name not in ("round",):
                return S.SIMPLE[name](*cols)
            return S.SIMPLE[name](cols[0], *([F.lit(self.value(args[1]))] if len(args) > 1 else []))
        if name in self.spark_udfs():
            return F.call_function(name, *cols)
        raise CypherError(f"unknown function {e[1]}")

    def spark_udfs(self) -> set[str]:
        return {n.lower() for n in getattr(self.g, "functions", ())} | getattr(type(self.g), "registered", set())

    def temporal(self, name: str, arg: tuple | None, frame: Frame) -> Column:
        if name == "duration":
            if arg[0] == "map":
                return S.make_duration({k: self.ex(v, frame) for k, v in arg[1].items()})
            return S.parse_duration(self.ex(arg, frame))
        kind = {"date": "date", "datetime": "timestamp", "localdatetime": "timestamp_ntz", "time": "time(6)", "localtime": "time(6)"}[name]
        if arg is None:
            return (F.current_date() if name == "date" else F.current_timestamp()).cast(kind)
        if arg[0] == "map":
            f = {k: self.ex(v, frame) for k, v in arg[1].items()}
            sec = (f.get("second", F.lit(0)) + f.get("millisecond", F.lit(0)) / 1000 + f.get("microsecond", F.lit(0)) / 1000000 + f.get("nanosecond", F.lit(0)) / 1000000000).cast("decimal(16,6)")
            clock = [f.get(k, F.lit(0)).cast("int") for k in ("hour", "minute")]
            if kind.startswith("time("):
                return F.make_time(*clock, sec)
            day = S.make_date(f)
            if name == "date":
                return day
            return F.make_timestamp_ntz(F.year(day), F.month(day), F.day(day), *clock, sec).cast(kind)
        return self.ex(arg, frame).try_cast(kind)

    def aggregate_function(self, name: str, distinct: bool, args: list, frame: Frame) -> Column:
        if args and args[0] == ("star",):
            return F.count(F.lit(1))
        entity = args[0][0] == "var" and args[0][1] in frame.vars and frame.vars[args[0][1]].kind in ("node", "rel")
        x = c(f"{args[0][1]}#id") if entity and name == "count" else self.ex(args[0], frame)
        if any(has_aggregate(a) for a in args):
            raise CypherError("an aggregate inside an aggregate")
        if name == "count":
            return F.count_distinct(x) if distinct else F.count(x)
        t = self.dtype(frame, x)
        if name == "sum":
            return F.coalesce(F.sum_distinct(x) if distinct else F.sum(x), F.lit(0))
        if name == "avg":
            return F.call_function("avg", x) if not distinct else F.sum_distinct(x).cast("double") / F.when(F.count_distinct(x) > 0, F.count_distinct(x))
        if name in ("min", "max"):
            return (F.min if name == "min" else F.max)(x)
        if name == "collect":
            return F.collect_set(x) if distinct else F.collect_list(x)
        if name in ("stdev", "stdevp"):
            if distinct:
                own = F.collect_set(x.cast("double"))
                mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, y: s + y) / F.size(v)
                square = F.aggregate(own, F.lit(0.0), lambda s, y: s + (y - mean(own)) * (y - mean(own)))
                return F.when(F.size(own) > 1, F.sqrt(square / (F.size(own) - int(name == "stdev")))).otherwise(F.lit(0.0))
            return (F.stddev_samp if name == "stdev" else F.stddev_pop)(x)
        p = self.value(args[1])
        if isinstance(p, bool) or not isinstance(p, (int, float)) or not 0 <= p <= 1:
            raise CypherError("a percentile must be between 0 and 1")
        if name == "percentilecont" and distinct:
            own = F.array_sort(F.collect_set(x.cast("double")))
            at = F.lit(float(p)) * (F.size(own) - 1)
            low, high = (F.try_element_at(own, F.greatest(y, F.lit(0)).cast("int") + 1) for y in (F.floor(at), F.ceil(at)))
            return low + (high - low) * (at - F.floor(at))
        if name == "percentilecont":
            return F.percentile(x.cast("double"), F.lit(float(p)))
        ranked = F.array_sort((F.collect_set if distinct else F.collect_list)(x))
        n = F.size(ranked)
        return F.try_element_at(ranked, F.least(F.greatest(F.ceil(F.lit(float(p)) * n), F.lit(1)), F.greatest(n, F.lit(1))).cast("int")).cast(t)


def finish(frame: Frame, emitter: Emitter) -> DataFrame:
    return frame.df.select(*[emitter.variable(v, frame).alias(v) for v in frame.vars])


def run(graph: PropertyGraph, text: str, params: dict) -> tuple[DataFrame, PropertyGraph]:
    from loomgraph.operators.ddl import is_ddl, run_ddl

    if is_ddl(text):
        return run_ddl(graph, text)
    query = P.parse(text)
    if query.mode:
        inner = text.strip()[len(query.mode) :]
        df, _ = run(graph, inner, params)
        return graph.spark.createDataFrame([(x,) for x in df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n")], "plan string"), graph
    out, now = None, replace(graph, counters={})
    columns: list[str] = []
    for i, part in enumerate(query.parts):
        em = Emitter(now, params, P.Query([part]))
        frame = em.clauses(part)
        now = em.g
        last = part[-1]
        df = finish(frame, em) if isinstance(last, (P.Projection, P.Call)) else graph.spark.createDataFrame([], "done boolean")
        if out is None:
            out, columns = df, df.columns
        else:
            if df.columns != columns:
                raise CypherError("members of a UNION need the same columns")
            out = out.union(df) if query.union_all[i - 1] else out.union(df).distinct()
    return out, now
