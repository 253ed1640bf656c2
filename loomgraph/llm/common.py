"""What several corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.iterate import checkpoint_dir

#: A word is a run of anything but these six ASCII white-space bytes; bytes.split() follows the same rule.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def as_bytes(text: Column) -> Column:
    """The text's UTF-8 bytes; a null text is empty."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def encoded(raws: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, word number of each token, number of tokens of each text) of UTF-8 texts, A-Z lower-cased."""
    raw = np.frombuffer(b" ".join(raws).lower() + b" ", np.uint8)
    space = SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    begin, size = edge[::2], np.diff(edge)[::2]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    plain = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~space])]).dictionary_encode()
    return plain.dictionary, plain.indices.to_numpy(), np.diff(np.searchsorted(begin, np.cumsum([len(r) + 1 for r in raws])), prepend=0)


def tokenized(raws: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """As ``encoded``, with the distinct words as a list."""
    types, ids, counts = encoded(raws)
    return types.to_pylist(), ids, counts


def release() -> None:
    """Give freed memory back: a worker shares its executor's memory with a JVM and other workers."""
    pa.default_memory_pool().release_unused()
    _libc().malloc_trim(0)


@functools.cache
def _libc():
    return ctypes.CDLL(None)


def pieces(batches, column: int, most: int = 4 << 20):
    """(batch of neighbouring rows, their texts), about ``most`` bytes of texts at a time."""
    for b in batches:
        texts = b.column(column if column >= 0 else b.num_columns + column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
            yield b.slice(first, last - first), texts.slice(first, last - first).to_pylist()
            first = last
            release()


def portions(raws: list[bytes], most: int = 4 << 20):
    """(first, last) of texts, about ``most`` bytes at a time."""
    first, size = 0, 0
    for i, raw in enumerate(raws):
        size += len(raw)
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(raws):
        yield first, len(raws)


def words(raw: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased (bytes.lower touches ASCII only)."""
    return raw.lower().split()


def saved(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the checkpoint folder: lineage ends there, and every executor reads it."""
    path = f"{checkpoint_dir(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.saved_path = path
    return out


def drop_saved(df: DataFrame) -> None:
    """Delete a table that ``saved`` wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A full collection waits until so many times what the last one took has passed.
REST = 20
_collected = {"ended": float("-inf"), "took": 0.0}


def let_go(spark: SparkSession) -> None:
    """Have the driver find plans, broadcasts and shuffles that nothing refers to: their memory and files go too.

    Where little was done since the last time, the next call sees to it: full pauses that follow one another make the
    driver's collector (G1, beyond a thirteenth of the time) enlarge its heap towards the limit.
    """
    release()
    began = time.monotonic()
    if began - _collected["ended"] >= REST * _collected["took"]:
        spark._jvm.System.gc()
        _collected.update(ended=time.monotonic(), took=time.monotonic() - began)


def done_with(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` wrote, and let go of what made them."""
    for df in tables:
        drop_saved(df)
    let_go(tables[0].sparkSession)


def pack_table(values: np.ndarray, blocks: int) -> list[tuple[int, bytes]]:
    """A flat table as (block number, compressed block) pairs; blocks of zeros are left out."""
    return [(i, zlib.compress(b.tobytes(), 1)) for i, b in enumerate(values.reshape(blocks, -1)) if b.any()]


def merged_table(parts: DataFrame, size: int, blocks: int, dtype: str = "uint32", how: str = "add") -> np.ndarray:
    """Sum (or bitwise or) of packed tables of a fixed size, by block; the driver gets one table.

    parts: columns block int, data binary.  Blocks are summed in the tasks they are dealt to, a block at a time in
    memory, first in sixteen shares, so that no task reads what grows with the number of tasks alone.
    """
    width = size // blocks

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(zlib.decompress(data.as_py()), dtype)
                if i not in held:
                    held[i] = v.copy()
                elif how == "add":
                    held[i] += v
                else:
                    held[i] |= v
        for i, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(v.tobytes(), 1)], pa.binary())], names=["block", "data"])

    parts = parts.select(F.col("block").cast("int").alias("block"), "data")
    shares = parts.repartition(12, "block", F.pmod(F.xxhash64("data"), F.lit(16))).mapInArrow(run, "block int, data binary")
    out = np.zeros((blocks, width), dtype)
    for r in shares.repartition(6, "block").mapInArrow(run, "block int, data binary").collect():
        out[r["block"]] = np.frombuffer(zlib.decompress(bytes(r["data"])), dtype)
    release()
    return out.reshape(-1)
