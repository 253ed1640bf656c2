"""Exact top-k inner products by pivot-table elimination.

Vectors are made integers, floor(256 * x).  A table holds each vector's distances to a set of pivots; by the triangle
inequality the largest difference of two vectors' entries is a lower bound of their distance, and so an upper bound of
their inner product, (|q|^2 + |x|^2 - d^2) / 2.  A query takes candidates in the order of that bound, best first, and
stops when its k-th score exceeds the next bound: the answer is exact.

Candidates lie in blocks of near vectors (by nearest pivot).  Each query first visits the blocks of its own pivot; the
score it has then rules out, by the blocks' ranges of pivot distances, most of the others before anything is moved.
Queries and candidates meet by block and by share of the queries; a task holds one block.

Defined results: vectors that are null, empty, or hold null or non-finite components, and rows with a null id, take no
part; only vectors of the query's length are its candidates; rows that repeat a query's id are one query (the vector
that is smallest as bytes), and none of them is its own candidate; equal scores go to the smaller id; a score beyond a
long is set to its end of the range; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.iterate import cut

PIVOTS, SAMPLE, MAX_DIMS = 24, 2000, 64
#: Rows of a block, at least; blocks grow beyond MAX_BLOCKS of them, so the table of blocks has a size bound.
BLOCK_ROWS, MAX_BLOCKS, QUERY_SHARE = 4096, 32_768, 16_384
CHUNK = 256
LONG = (1 << 63) - 1


def integers(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, v): v holds the int64 components; rows that take no part are left out."""
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))

    def run(batches):
        for b in batches:
            ids, dims, out = [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                values = x.values
                if len(values) and not values.null_count:
                    v = values.to_numpy(zero_copy_only=False)
                    if np.isfinite(v).all():
                        ids.append(i)
                        dims.append(len(v))
                        out.append(np.clip(np.floor(256.0 * v), -float(1 << 62), float(1 << 62)).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "v"])

    return rows.mapInArrow(run, "vec_id bigint, dim int, v binary")


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Farthest-first traversal from the vector nearest the mean."""
    x = sample.astype(np.float64)
    at = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    chosen, gap = [at], ((x - x[at]) ** 2).sum(axis=1)
    while len(chosen) < min(most, len(x)):
        at = int(gap.argmax())
        if gap[at] == 0:
            break
        chosen.append(at)
        gap = np.minimum(gap, ((x - x[at]) ** 2).sum(axis=1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def _matrix(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.int64).reshape(len(packed), -1)


def _small(v: np.ndarray) -> bool:
    """Whether inner products of such components are exact in double precision."""
    return float(np.abs(v).max(initial=0)) ** 2 * v.shape[1] < 2.0**52


def search_block(q_ids: list, q: np.ndarray, floor: list, ids: np.ndarray, v: np.ndarray, table: np.ndarray, pivots: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best in the block; floor: scores below it are of no use."""
    out: list[tuple[int, int, int]] = []
    exact = _small(v) and _small(q)
    x = v.astype(np.float64)
    norms = (x * x).sum(axis=1)
    for i, (qid, own) in enumerate(zip(q_ids, q, strict=True)):
        usable = ids != qid
        if not exact:
            scores = [(sum(int(a) * int(b) for a, b in zip(own, c, strict=True)), int(j)) for c, j in zip(v[usable], ids[usable], strict=True)]
            out += [(qid, j, max(-LONG - 1, min(LONG, s))) for s, j in sorted(scores, key=lambda t: (-t[0], t[1]))[:k]]
            continue
        y = own.astype(np.float64)
        far = np.abs(table - distances(y[None, :], pivots)).max(axis=1) if len(pivots) else np.zeros(len(x))
        bound = (norms + (y * y).sum() - np.maximum(far * (1 - 1e-9) - 1e-6, 0) ** 2) / 2 + 1
        bound[~usable] = -np.inf
        least = -np.inf if floor[i] is None else float(floor[i])
        order = np.flatnonzero(usable & (bound >= least))
        order = order[np.argsort(-bound[order], kind="stable")]
        best_s, best_i = np.empty(0), np.empty(0, np.int64)
        for at in range(0, len(order), CHUNK):
            if bound[order[at]] < (best_s[k - 1] if len(best_s) >= k else least):
                break
            some = order[at : at + CHUNK]
            s, j = np.concatenate([best_s, x[some] @ y]), np.concatenate([best_i, ids[some]])
            top = np.lexsort((j, -s))[:k]
            best_s, best_i = s[top], j[top]
        out += [(qid, int(j), int(s)) for s, j in zip(best_s, best_i, strict=True) if s >= least]
    return out


def top_k(df: DataFrame, queries: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``queries`` (over vec_id) holds, against all others."""
    spark = df.sparkSession
    rows = cut(integers(df, id_col, vector_col))
    dims = [r["dim"] for r in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MAX_DIMS).collect()]
    pivots = {}
    for d in dims:  # a bounded sample for each of the commonest lengths; others do without pivots
        sample = [bytes(r["v"]) for r in rows.where(F.col("dim") == d).orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").collect()]
        v = _matrix(sample)
        pivots[d] = choose_pivots(v) if _small(v) else np.empty((0, d))
    shared = spark.sparkContext.broadcast(pivots)

    def near(batches):
        for b in batches:
            out = []
            for d, v in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                p = shared.value.get(d)
                out.append(int(distances(np.frombuffer(v.as_py(), np.int64).astype(np.float64)[None, :], p)[0].argmin()) if p is not None and len(p) else 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, "cell"])

    placed = cut(rows.mapInArrow(near, "vec_id bigint, dim int, v binary, cell int"))
    cells = placed.groupBy("dim", "cell").count()
    total = placed.count()
    size = max(BLOCK_ROWS, -(-total // MAX_BLOCKS))
    cells = cells.select("dim", "cell", F.ceil(F.col("count") / size).cast("int").alias("blocks"))
    blocked = cut(placed.join(cells, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int")).drop("blocks"))

    def ranges(batches):
        """Of the rows of each block in this task: ranges of pivot distances and of the norm."""
        held: dict = {}
        for b in batches:
            for d, v, cell, block in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                x = np.frombuffer(v, np.int64).astype(np.float64)
                p = shared.value.get(d)
                t = distances(x[None, :], p)[0] if p is not None and len(p) else np.empty(0)
                n = float(x @ x)
                lo, hi, m = held.get((d, cell, block), (t, t, n))
                held[(d, cell, block)] = (np.minimum(lo, t), np.maximum(hi, t), max(m, n))
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in keys], pa.int32()) for i in range(3)] + [pa.array([held[x][i].tolist() for x in keys], pa.list_(pa.float64())) for i in range(2)] + [pa.array([held[x][2] for x in keys], pa.float64())], names=["dim", "cell", "block", "lo", "hi", "norm"])

    parts = blocked.select("dim", "v", "cell", "block").mapInArrow(ranges, "dim int, cell int, block int, lo array<double>, hi array<double>, norm double")
    width = F.posexplode_outer(F.arrays_zip("lo", "hi"))
    merged = parts.select("dim", "cell", "block", "norm", width).groupBy("dim", "cell", "block", "pos").agg(F.min("col.lo").alias("lo"), F.max("col.hi").alias("hi"), F.max("norm").alias("norm"))
    blocks: dict = {}
    for r in merged.collect():  # (MAX_BLOCKS + cells) * PIVOTS rows at most
        own = blocks.setdefault((r["dim"], r["cell"], r["block"]), [r["norm"], {}])
        if r["pos"] is not None:
            own[1][r["pos"]] = (r["lo"], r["hi"])
    by_dim: dict = {}
    for (d, cell, block), (norm, lohi) in sorted(blocks.items()):
        by_dim.setdefault(d, []).append((cell, block, norm, [lohi[p][0] for p in sorted(lohi)], [lohi[p][1] for p in sorted(lohi)]))
    table = {d: (np.array([r[0] for r in x]), np.array([r[1] for r in x]), np.array([r[2] for r in x]), np.array([r[3] for r in x]), np.array([r[4] for r in x])) for d, x in by_dim.items()}
    all_blocks = spark.sparkContext.broadcast(table)

    asked = blocked.where(queries).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "cell")).alias("one")).select("vec_id", "one.*")
    shares = max(1, -(-asked.count() // QUERY_SHARE))
    asked = asked.withColumn("share", F.pmod(F.xxhash64("vec_id"), F.lit(shares)).cast("int"))

    def route(own: bool):
        """Rows for the blocks a query visits: those of its own cell, or any others that its score does not rule out."""

        def run(batches):
            for b in batches:
                out = []
                for qid, v, d, cell, share, floor in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                    cs, bs, norms, lo, hi = all_blocks.value[d]
                    hit = cs == cell
                    if not own:
                        hit = ~hit
                        p = shared.value.get(d)
                        y = np.frombuffer(v, np.int64).astype(np.float64)
                        if floor is not None and p is not None and len(p):
                            t = distances(y[None, :], p)[0]
                            far = np.maximum(np.maximum(lo - t, t - hi).max(axis=1) * (1 - 1e-9) - 1e-6, 0)
                            hit &= (norms + y @ y - far**2) / 2 + 1 >= floor
                    out += [(d, int(cs[i]), int(bs[i]), share, 1, qid, v, floor) for i in np.flatnonzero(hit)]
                cols = list(zip(*out, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        return run

    names = ["dim", "cell", "block", "share", "kind", "vec_id", "v", "floor"]
    kinds = [pa.int32()] * 5 + [pa.int64(), pa.binary(), pa.int64()]
    types = "dim int, cell int, block int, share int, kind int, vec_id bigint, v binary, floor bigint"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def visit(routed: DataFrame) -> DataFrame:
        wanted = routed.select("dim", "cell", "block", "share").distinct()
        held = blocked.join(wanted, ["dim", "cell", "block"]).select("dim", "cell", "block", "share", F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("long").alias("floor"))
        both = held.unionByName(routed).repartition(tasks, "dim", "cell", "block", "share").sortWithinPartitions("dim", "cell", "block", "share", "kind")

        def run(batches):
            key, ids, packed, block = None, [], [], None
            for b in batches:
                cols = [b.column(i).to_pylist() for i in range(8)]
                out, waiting = [], []

                def flush():
                    nonlocal block
                    if waiting and ids:
                        if block is None:
                            v = _matrix(packed)
                            p = shared.value.get(v.shape[1], np.empty((0, v.shape[1])))
                            block = (np.array(ids), v, distances(v.astype(np.float64), p), p)
                        out.extend(search_block([w[0] for w in waiting], _matrix([w[1] for w in waiting]), [w[2] for w in waiting], *block, k))
                    waiting.clear()

                for *own, kind, vid, v, floor in zip(*cols, strict=True):
                    if own != key:
                        flush()
                        key, ids, packed, block = own, [], [], None
                    if kind:
                        waiting.append((vid, v, floor))
                    else:
                        ids.append(vid)
                        packed.append(v)
                flush()
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

        return both.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = visit(asked.withColumn("floor", F.lit(None).cast("long")).select("vec_id", "v", "dim", "cell", "share", "floor").mapInArrow(route(True), types))
    first = cut(first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    rest = visit(asked.join(floors, "vec_id", "left").select("vec_id", "v", "dim", "cell", "share", "floor").mapInArrow(route(False), types))
    both = first.drop("rank").unionByName(rest)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
