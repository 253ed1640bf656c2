"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of normalised words.  Runs of MIN_MATCH words that a text shares with an item
(found by rolling Karp-Rabin hashes in the item's hash table) are the seeds; seeds that follow each other on a diagonal
grow into maximal matches.  The longest match whose words are still free on both sides is marked as a tile, again and
again; a longer match that is partly taken counts with what is left of it.  An item is leaked where tiles cover at
least ``threshold`` of its words, in whatever order its passages appear.

The benchmark is read in blocks of bounded size, each of which is broadcast by itself; texts are never shuffled, so a
passage in a third of all texts costs no task more than another.

Defined results: null and short texts match nothing; items with fewer than MIN_MATCH words, or a null id or text, take
no part; items or texts that repeat are each judged; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import as_bytes

MIN_MATCH, THRESHOLD = 5, 0.5
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 16 << 20
PUNCTUATION = bytes.maketrans(bytes(c for c in range(33, 127) if not chr(c).isalnum()), b" " * 32)
BASE = np.uint64(0x9E3779B97F4A7C15)


def normal_words(raw: bytes) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return raw.lower().translate(PUNCTUATION).split()


def rolling(tokens: list[bytes], known: dict[bytes, int], m: int) -> np.ndarray:
    """Karp-Rabin hash of every run of m words, modulo 2**64."""
    if len(known) > 500_000:
        known.clear()
    for w in tokens:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter((known[w] for w in tokens), np.uint64, len(tokens))
    n = len(h) - m + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = h[:n].copy()
    for k in range(1, m):
        total = total * BASE + h[k : k + n]
    return total


class Index:
    """Seeds of one block of items."""

    def __init__(self, items: list[tuple], m: int):
        self.m, self.ids, self.sizes = m, [], []
        known: dict[bytes, int] = {}
        hashes, owner, place = [], [], []
        for item, raw in items:
            tokens = normal_words(raw)
            r = rolling(tokens, known, m)
            if len(r):
                hashes.append(r)
                owner.append(np.full(len(r), len(self.ids), np.int32))
                place.append(np.arange(len(r), dtype=np.int32))
                self.ids.append(item)
                self.sizes.append(len(tokens))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owner = np.concatenate(owner)[order] if hashes else np.empty(0, np.int32)
        self.place = np.concatenate(place)[order] if hashes else np.empty(0, np.int32)

    def seeds(self, r: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Per item, (position in the text, position in the item) of shared runs."""
        lo, hi = np.searchsorted(self.hashes, r, "left"), np.searchsorted(self.hashes, r, "right")
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at in np.flatnonzero(hi > lo).tolist():
            for k in range(lo[at], hi[at]):
                out[int(self.owner[k])].append((at, int(self.place[k])))
        return out


def tiles(seeds: list[tuple[int, int]], m: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (text position, item position, length) of the marked matches, longest first."""
    by_diagonal: dict[int, list[int]] = defaultdict(list)
    for at, place in seeds:
        by_diagonal[at - place].append(at)
    heap: list[tuple[int, int, int]] = []
    for d, ats in by_diagonal.items():
        ats.sort()
        first = prev = ats[0]
        for at in [*ats[1:], None]:
            if at is None or at != prev + 1:
                heap.append((-(prev - first + m), first, first - d))
                first = at
            prev = at
    heapq.heapify(heap)
    text_taken: set[int] = set()
    item_taken: set[int] = set()
    out = []
    while heap:
        n, at, place = heapq.heappop(heap)
        n = -n
        free = [at + k not in text_taken and place + k not in item_taken for k in range(n)]
        if all(free):
            text_taken.update(range(at, at + n))
            item_taken.update(range(place, place + n))
            out.append((at, place, n))
            continue
        k = 0
        while k < n:
            if free[k]:
                first = k
                while k < n and free[k]:
                    k += 1
                if k - first >= m:
                    heapq.heappush(heap, (-(k - first), at + first, place + first))
            k += 1
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, min_match: int = MIN_MATCH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per text and leaked item: id, item, covered and item_words, coverage, longest tile, spans (word position, length)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias(id_col), as_bytes(F.col(text_col)).alias("raw__"))
    schema = rows.select(id_col).schema
    kind = benchmark.schema[item_col].dataType
    types = f"`{id_col}` {schema[id_col].dataType.simpleString()}, `{item_col}` {kind.simpleString()}, covered bigint, item_words bigint, coverage double, longest bigint, spans array<struct<at: bigint, n: bigint>>"

    def search(shared):
        def run(batches):
            index, known = shared.value, {}
            m = index.m
            for b in batches:
                out = []
                for i in range(b.num_rows):
                    r = rolling(normal_words(b.column(1)[i].as_py()), known, m)
                    for item, own in index.seeds(r).items():
                        if m * len({p for _, p in own}) < threshold * index.sizes[item]:
                            continue  # each seed covers m words of the item at most
                        t = tiles(own, m)
                        covered = sum(n for _, _, n in t)
                        if covered >= threshold * index.sizes[item]:
                            out.append((b.column(0)[i].as_py(), index.ids[item], covered, index.sizes[item], covered / index.sizes[item], t[0][2], [{"at": a, "n": n} for a, _, n in sorted(t)]))
                columns = list(zip(*out, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        return run

    from pyspark.sql.pandas.types import to_arrow_schema

    found = spark.createDataFrame([], types)
    target = to_arrow_schema(found.schema)
    block, size = [], 0
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col), as_bytes(F.col(item_text)))
    for item, raw in items.toLocalIterator():
        block.append((item, bytes(raw)))
        size += len(raw)
        if size >= BLOCK_BYTES:
            found = found.union(rows.mapInArrow(search(spark.sparkContext.broadcast(Index(block, min_match))), types))
            block, size = [], 0
    if block:
        found = found.union(rows.mapInArrow(search(spark.sparkContext.broadcast(Index(block, min_match))), types))
    return found
