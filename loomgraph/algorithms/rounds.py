"""Rounds over packed edges: each block holds the edges into a range of nodes, in the shared checkpoint folder, and only
vectors of a value a node pass through the driver from round to round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.iterate import cut


class Rounds:
    """edges: src, dst and weight; ids: all nodes in order, which vectors follow."""

    def __init__(self, edges: DataFrame, nodes: DataFrame):
        if not all(isinstance(edges.schema[x].dataType, T.IntegralType) for x in ("src", "dst")):
            raise TypeError("src and dst must be integers")
        self.spark = edges.sparkSession
        self.ids = np.sort(nodes.select(F.col("id").cast("long")).toArrow().column(0).to_numpy())
        shared = self.spark.sparkContext.broadcast(self.ids)

        def pack(batches):
            own = [b for b in batches if b.num_rows]
            if not own:
                return
            src, dst, weight = (np.concatenate([b.column(i).to_numpy() for b in own]) for i in range(3))
            own.clear()
            order = np.argsort(dst, kind="stable")
            head, tail = (np.searchsorted(shared.value, x[order]).astype(np.int32) for x in (dst, src))
            starts = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (head[starts], starts, tail, weight[order])], names=["heads", "starts", "tails", "weights"])

        rows = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double"))
        self.blocks = cut(cut(rows).repartitionByRange(self.spark.sparkContext.defaultParallelism, "dst").mapInArrow(pack, "heads binary, starts binary, tails binary, weights binary"))
        shared.destroy()

    def step(self, kernel, *vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, values) that kernel(heads, starts, tails, weights, *vectors) gives for the blocks."""
        shared = self.spark.sparkContext.broadcast(vectors)

        def run(batches):
            for b in batches:
                for r in b.to_pylist():
                    nodes, values = kernel(np.frombuffer(r["heads"], np.int32), np.frombuffer(r["starts"], np.int64), np.frombuffer(r["tails"], np.int32), np.frombuffer(r["weights"], np.float64), *shared.value)
                    yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(nodes, np.int32).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(values, np.float64).tobytes()], pa.binary())], names=["n", "v"])

        got = self.blocks.mapInArrow(run, "n binary, v binary").toArrow().to_pydict()
        shared.destroy()
        return np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(x, np.int32) for x in got["n"]]]), np.concatenate([np.zeros(0), *[np.frombuffer(x) for x in got["v"]]])

    def frame(self, name: str, values: np.ndarray) -> DataFrame:
        return self.spark.createDataFrame(pa.table({"id": self.ids, name: values}))


def times(heads, starts, tails, weights, x):
    return heads, np.add.reduceat(x[tails] * weights, starts)


def h_index(heads, starts, tails, weights, guess, moved):
    """For each node of the block: the largest h of which h neighbours have a guess of h or more, again until none of the
    block's nodes moves.  Only nodes with a neighbour that moved are looked at."""
    guess, moved, first = guess.copy(), moved.copy(), guess[heads]
    ends = np.r_[starts[1:], len(tails)]
    while True:
        stale = np.flatnonzero(np.logical_or.reduceat(moved[tails], starts))
        moved[:] = False
        if not len(stale):
            break
        own, n = heads[stale], (ends - starts)[stale]
        at = np.cumsum(n) - n
        segment = np.repeat(np.arange(len(own)), n)
        rank = np.arange(len(segment)) - at[segment]
        most = int(guess[own].max())
        key = segment * (most + 1) + (most - np.minimum(guess[tails[rank + starts[stale][segment]]], most).astype(np.int64))
        key.sort()
        found = np.maximum.reduceat(np.minimum(most - (key - segment * (most + 1)), rank + 1), at)
        moved[own] = found < guess[own]
        guess[own] = np.minimum(guess[own], found)
    fell = guess[heads] < first
    return heads[fell], guess[heads[fell]]


def freed(heads, starts, tails, weights, level):
    """Levels of nodes all of whose predecessors have one (not -1), those of this block included as they get theirs."""
    lacking = level[heads] < 0
    if not lacking.any():
        return heads[:0], np.zeros(0)
    ends = np.r_[starts[1:], len(tails)]
    n = (ends - starts)[lacking]
    own, segment = heads[lacking], np.repeat(np.arange(lacking.sum()), n)
    e = np.arange(len(segment)) + np.repeat(starts[lacking] - (np.cumsum(n) - n), n)
    tail = tails[e]
    known = level[tail]
    high = np.maximum.reduceat(known, np.cumsum(n) - n) + 1
    waits = np.bincount(segment[known < 0], minlength=len(own))
    place = np.searchsorted(own, tail)
    inside = (known < 0) & (place < len(own))
    inside[inside] = own[place[inside]] == tail[inside]
    a, b = place[inside], segment[inside]
    order = np.argsort(a, kind="stable")
    b = b[order]
    at = np.r_[0, np.cumsum(np.bincount(a, minlength=len(own)))]
    done, ready = np.zeros(len(own), bool), np.flatnonzero(waits == 0)
    while len(ready):
        done[ready] = True
        k = at[ready + 1] - at[ready]
        to = b[np.arange(k.sum()) + np.repeat(at[ready] - (np.cumsum(k) - k), k)]
        np.maximum.at(high, to, np.repeat(high[ready], k) + 1)
        np.subtract.at(waits, to, 1)
        to = np.unique(to)
        ready = to[waits[to] == 0]
    return own[done], high[done]
