"""Write clauses: each makes a new graph version by unions, anti-joins and joins on ids; the old version stays as it is."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Rel, widest
from loomgraph.iterate import cut
from loomgraph.operators.ddl import check
from loomgraph.plans import parser as P
from loomgraph.plans.emit import Binding, CypherError, Emitter, Frame, c, variables


def fresh_id() -> Column:
    """Random ids behind all keyed ones; they are fixed by the checkpoint that follows."""
    return F.xxhash64(F.uuid()).bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 61))


def _count(em: Emitter, what: str, n: int) -> None:
    em.g = replace(em.g, counters=em.g.counters | {what: em.g.counters.get(what, 0) + n})


def _append(old: DataFrame | None, new: DataFrame) -> DataFrame:
    if old is None:
        return new
    for name in set(old.columns) & set(new.columns):
        if old.schema[name].dataType.simpleString() == new.schema[name].dataType.simpleString():
            continue
        t = widest([old.schema[name].dataType, new.schema[name].dataType]) if new.schema[name].dataType.typeName() != "void" else old.schema[name].dataType
        old, new = old.withColumn(name, F.col(name).cast(t)), new.withColumn(name, F.col(name).cast(t))
    return old.unionByName(new, allowMissingColumns=True)


def _add_nodes(em: Emitter, labels: list[str], rows: DataFrame) -> None:
    owner = labels[0] if labels else ""
    old = em.g.nodes.get(owner)
    if labels != [owner] or old is not None and "_labels" in old.columns:
        rows = rows.withColumn("_labels", F.array(*map(F.lit, labels)).cast("array<string>"))
        if old is not None and "_labels" not in old.columns:
            old = old.withColumn("_labels", F.array(F.lit(owner)))
    em.g = replace(em.g, nodes=em.g.nodes | {owner: _append(old, rows)})
    _count(em, "nodes_created", rows.count())
    for kind, label, prop in em.g.constraints.values():
        if label in labels:
            check(em.g, label, prop, kind)


def _props(em: Emitter, frame: Frame, props: tuple | None) -> dict[str, Column]:
    if props is None:
        return {}
    items = props[1] if props[0] == "map" else {k: ("lit", v) for k, v in em.params[props[1]].items()}
    return {k: em.ex(v, frame) for k, v in items.items()}


def create(em: Emitter, path: P.PathPattern, frame: Frame) -> Frame:
    new, df, made = [], frame.df, dict(frame.vars)
    for x in (*path.nodes, *path.rels):
        em.anonymous(x)
    for n in path.nodes:
        if n.var in made:
            continue
        props = _props(em, frame, n.props)
        df = df.withColumns({f"{n.var}#id": fresh_id(), f"{n.var}#labels": F.array(*map(F.lit, n.labels)).cast("array<string>")} | {f"{n.var}.{k}": v for k, v in props.items()})
        made[n.var] = Binding("node", list(n.labels))
        new.append((n, list(props)))
    rels = []
    for i, r in enumerate(path.rels):
        if len(r.types) != 1 or r.direction == "both":
            raise CypherError("a created relationship needs one type and a direction")
        a, b = path.nodes[i], path.nodes[i + 1]
        if r.direction == "in":
            a, b = b, a
        props = _props(em, frame, r.props)
        df = df.withColumns({f"{r.var}#id": fresh_id(), f"{r.var}#type": F.lit(r.types[0]), f"{r.var}#src": c(f"{a.var}#id"), f"{r.var}#dst": c(f"{b.var}#id")} | {f"{r.var}.{k}": v for k, v in props.items()})
        made[r.var] = Binding("rel", list(r.types))
        rels.append((r, list(props)))
    df = cut(df)
    for n, props in new:
        _add_nodes(em, n.labels, df.select(c(f"{n.var}#id").alias("id"), *[c(f"{n.var}.{k}").alias(k) for k in props]))
    for r, props in rels:
        rows = df.select(c(f"{r.var}#id").alias("id"), c(f"{r.var}#src").alias("src"), c(f"{r.var}#dst").alias("dst"), *[c(f"{r.var}.{k}").alias(k) for k in props])
        old = em.g.rels.get(r.types[0])
        em.g = replace(em.g, rels=em.g.rels | {r.types[0]: Rel(_append(old.df if old else None, rows))})
        _count(em, "relationships_created", rows.count())
    return Frame(df, made)


def _tables(em: Emitter, var: str, frame: Frame):
    """(kind, name, table) of every table that could hold the variable's entity."""
    if frame.vars[var].kind == "node":
        return [("node", k, df) for k, df in em.g.nodes.items()]
    return [("rel", k, r.df) for k, r in em.g.rels.items() if not frame.vars[var].labels or k in frame.vars[var].labels]


def _store(em: Emitter, kind: str, name: str, df: DataFrame) -> None:
    if kind == "node":
        em.g = replace(em.g, nodes=em.g.nodes | {name: df})
    else:
        em.g = replace(em.g, rels=em.g.rels | {name: replace(em.g.rels[name], df=df)})


def set_items(em: Emitter, items: list, frame: Frame) -> Frame:
    for item in items:
        kind, var = item[0], item[1]
        ident = c(f"{var}#id")
        if kind == "labels":
            _labels(em, var, frame, lambda own, labs=item[2]: F.array_union(own, F.array(*map(F.lit, labs))))
            frame = Frame(frame.df.withColumn(f"{var}#labels", F.array_union(c(f"{var}#labels"), F.array(*map(F.lit, item[2])))), frame.vars)
            continue
        if kind == "prop":
            values = {item[2]: em.ex(item[3], frame)}
        elif item[2][0] == "var" and item[2][1] in frame.vars and frame.vars[item[2][1]].kind in ("node", "rel"):
            values = {x.split(".", 1)[1]: c(x) for x in frame.cols(item[2][1]) if "." in x}
        else:
            values = _props(em, frame, item[2] if item[2][0] in ("map", "param") else ("map", {}))
        changes = cut(frame.df.where(ident.isNotNull()).select(ident.alias("#id"), *[v.alias(f"#v{i}") for i, v in enumerate(values.values())]).groupBy("#id").agg(*[F.last(f"#v{i}").alias(f"#v{i}") for i in range(len(values))], F.lit(True).alias("#hit")))
        for where, name, df in _tables(em, var, frame):
            if not df.join(changes, F.col("id") == c("#id"), "left_semi").limit(1).count():
                continue
            hit = df.join(changes, F.col("id") == c("#id"), "left")
            cols = [F.col(x) for x in ("id", "src", "dst", "_labels") if x in df.columns]
            for x in [y for y in df.columns if y not in ("id", "src", "dst", "_labels")] + [y for y in values if y not in df.columns]:
                old = F.col(x) if x in df.columns else F.lit(None)
                if x in values:
                    new = c(f"#v{list(values).index(x)}")
                    if x in df.columns and changes.schema[f"#v{list(values).index(x)}"].dataType.typeName() != "void":
                        t = widest([df.schema[x].dataType, changes.schema[f"#v{list(values).index(x)}"].dataType])
                        old, new = old.cast(t), new.cast(t)
                    cols.append(F.when(c("#hit"), new).otherwise(old).alias(x))
                elif kind == "replace":
                    cols.append(F.when(c("#hit"), F.lit(None)).otherwise(old).alias(x))
                else:
                    cols.append(old.alias(x))
            _store(em, where, name, hit.select(*cols))
        _count(em, "properties_set", changes.count() * len(values))
        gone = {x: F.lit(None) for x in frame.cols(var) if "." in x} if kind == "replace" else {}
        frame = Frame(frame.df.withColumns(gone | {f"{var}.{k}": v for k, v in values.items()}), frame.vars)
        for ck, label, prop in em.g.constraints.values():
            check(em.g, label, prop, ck)
    return frame


def _labels(em: Emitter, var: str, frame: Frame, change) -> None:
    ids = cut(frame.df.select(c(f"{var}#id").alias("#id")).distinct())
    for where, name, df in _tables(em, var, frame):
        own = F.col("_labels") if "_labels" in df.columns else F.array(F.lit(name))
        hit = df.join(ids.withColumn("#hit", F.lit(True)), F.col("id") == c("#id"), "left")
        _store(em, where, name, hit.withColumn("_labels", F.when(c("#hit"), change(own)).otherwise(own)).drop("#id", "#hit"))


def delete(em: Emitter, d: P.Delete, frame: Frame) -> Frame:
    for e in d.exprs:
        if e[0] != "var" or e[1] not in frame.vars:
            raise CypherError("only variables can be deleted")
        ids = cut(frame.df.select(c(f"{e[1]}#id").alias("#id")).where(c("#id").isNotNull()).distinct())
        n = ids.count()
        if frame.vars[e[1]].kind == "rel":
            for where, name, df in _tables(em, e[1], frame):
                _store(em, where, name, df.join(ids, F.col("id") == c("#id"), "left_anti"))
            _count(em, "relationships_deleted", n)
            continue
        for name, r in list(em.g.rels.items()):
            if d.detach:
                rest = r.df.join(ids, F.col("src") == c("#id"), "left_anti").join(ids, F.col("dst") == c("#id"), "left_anti")
                _store(em, "rel", name, rest)
            elif r.df.join(ids, F.col("src") == c("#id"), "left_semi").limit(1).count() or r.df.join(ids, F.col("dst") == c("#id"), "left_semi").limit(1).count():
                raise CypherError(f"a node with {name} relationships can't be deleted without DETACH")
        for where, name, df in _tables(em, e[1], frame):
            _store(em, where, name, df.join(ids, F.col("id") == c("#id"), "left_anti"))
        _count(em, "nodes_deleted", n)
    return frame


def merge(em: Emitter, m: P.Merge, frame: Frame) -> Frame:
    frame = Frame(cut(frame.df.withColumn("#row", F.xxhash64(F.uuid()))), frame.vars)
    for x in (*m.path.nodes, *m.path.rels):
        em.anonymous(x)
    matched = em.match(P.Match([m.path]), frame)
    matched = Frame(cut(matched.df), matched.vars)
    rest = cut(frame.df.join(matched.df.select("#row").distinct(), "#row", "left_anti"))
    if rest.limit(1).count():
        # Equal patterns in several rows are created once.
        keyed = Frame(rest, frame.vars)
        bound = [v for v in sorted(variables(m.path)) if v in frame.vars]
        keys = [c(k) for v in bound for k in frame.keys(v)]
        keys += [v for x in (*m.path.nodes, *m.path.rels) for v in _props(em, keyed, x.props).values()]
        rest = cut(rest.withColumn("#key", F.xxhash64(F.lit(0), *keys)))
        made = create(em, m.path, Frame(rest.dropDuplicates(["#key"]), frame.vars))
        if m.on_create:
            made = set_items(em, m.on_create, made)
        new = [x for v in made.vars if v not in frame.vars for x in made.cols(v)]
        created = rest.join(made.df.select("#key", *map(c, new)), "#key").drop("#key")
    else:
        created, made = None, matched
    if m.on_match and matched.df.limit(1).count():
        matched = set_items(em, m.on_match, matched)
    out = matched.df if created is None else matched.df.unionByName(created, allowMissingColumns=True)
    return Frame(out.drop("#row"), matched.vars | made.vars)


def apply_write(em: Emitter, x, frame: Frame) -> Frame:
    if isinstance(x, P.Create):
        for p in x.paths:
            frame = create(em, p, frame)
        return frame
    if isinstance(x, P.Merge):
        return merge(em, x, frame)
    if isinstance(x, P.SetClause):
        return set_items(em, x.items, frame)
    if isinstance(x, P.Remove):
        for item in x.items:
            if item[0] == "prop":
                frame = set_items(em, [("prop", item[1], item[2], ("lit", None))], frame)
            else:
                _labels(em, item[1], frame, lambda own, labs=item[2]: F.array_except(own, F.array(*map(F.lit, labs))))
        return frame
    if isinstance(x, P.Delete):
        return delete(em, x, frame)
    if isinstance(x, P.Foreach):
        inner = Frame(frame.df.withColumn(x.var, F.explode(em.ex(x.expr, frame))), frame.vars | {x.var: Binding("value")})
        for y in x.body:
            inner = apply_write(em, y, inner)
        return frame
    raise CypherError(f"unknown clause {type(x).__name__}")
