"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text: one trained on ordinary text, and one that adds the segments
that recur in toxic text far more often than in ordinary text (by log-likelihood ratio).  Both have the ordinary
segments at the same offsets, so the difference of a window's two compressed lengths measures toxic matches alone.
Each window, one word or a piece of a long one, is compressed with both behind a primer that both dictionaries hold;
the primer pays for the block's headers, without which zstandard stores short windows as they are.  A text's counts of
windows beyond several length differences go through a logistic calibration to a score in [0, 1].

Defined results: a null or wordless text has no windows and gets the calibrated score of none; labels repeated for an
id count once, as toxic if any says so; null labels teach nothing; with no labelled text of both classes every score
is 0.0; repeated documents are scored alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import as_bytes, pieces, release, words

LEVEL, PIECE = 9, 64
LEAST, MOST, BURST, SHARE = 4, 12, 4, 0.1
ORDINARY_BYTES, TOXIC_BYTES = 2048, 4096
#: Any bytes that text does not hold.
PRIMER = bytes(range(1, 9)) + bytes(range(14, 32)) + b"\x7f" + bytes(range(128, 133))
#: Bounds of the training sample: labelled documents of each class, and bytes taken from a long one (in slices).
MAX_TOXIC, MAX_ORDINARY, SLICE, SLICES = 1500, 4000, 4096, 8
#: About so many windows of ordinary text, at even steps, are given to zstandard's training.
SAMPLES = 40_000
#: Length differences from which a window counts.
CUTS = (1, 2, 3, 4, 5, 6)
#: Differences of this many distinct windows are kept at hand.
MEMO = 400_000


def windows(raw: bytes) -> list[bytes]:
    own = words(raw)
    if own and len(max(own, key=len)) > PIECE:
        own = [w[i : i + PIECE] for w in own for i in range(0, len(w), PIECE)]
    return own


def _starts(raw: bytes, among=None) -> Counter:
    """Occurrences, up to BURST, of word beginnings of LEAST to MOST bytes."""
    starts = (w[:k] for w in words(raw) for k in range(LEAST, min(len(w), MOST) + 1))
    found = Counter(starts if among is None else (s for s in starts if s in among))
    return Counter({w: min(c, BURST) for w, c in found.items()})


def contrast(toxic: list[bytes], ordinary: list[bytes], share: float = SHARE) -> list[bytes]:
    """Word beginnings whose log-likelihood ratio for toxic text is near the largest one, weakest first; none starts another."""
    seen, totals = [Counter(), Counter()], [1, 1]
    for c, texts in enumerate((toxic, ordinary)):
        for t in sorted(set(texts)):
            seen[c].update(_starts(t, seen[0] if c else None))
            totals[c] += len(words(t))
        if not c:  # what is rare in toxic text can't be chosen and needs no count in ordinary text
            seen[0] = Counter({w: n for w, n in seen[0].items() if n >= 3})
    n1, n0 = totals
    gain = {}
    for w, a in seen[0].items():
        b, e1 = seen[1][w], (a + seen[1][w]) * n1 / (n1 + n0)
        if a >= 3 and a > 2 * e1:
            gain[w] = 2 * (a * math.log(a / e1) + (b * math.log(b / ((a + b) * n0 / (n1 + n0))) if b else 0))
    most = max(gain.values(), default=0)
    chosen: list[bytes] = []
    for w in sorted((w for w in gain if gain[w] >= share * most), key=lambda w: (-gain[w], -len(w), w)):
        if not any(w.startswith(c) or c.startswith(w) for c in chosen):
            chosen.append(w)
    return chosen[::-1]


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary, of equal length."""
    step = max(1, sum(len(windows(t)) for t in ordinary) // SAMPLES)
    samples = [b"\n " + w + b"\n " for w in islice((w for t in ordinary for w in windows(t)), 0, None, step)]
    try:
        plain = zstd.train_dictionary(ORDINARY_BYTES, samples).as_bytes()[-ORDINARY_BYTES + 512 :]
    except zstd.ZstdError:  # too few samples to train on: the samples themselves are the dictionary
        plain = b"".join(samples)[-ORDINARY_BYTES:]
    extra = b"".join(b"\n " + w for w in contrast(toxic, ordinary))[-TOXIC_BYTES:]
    return b"\0" * len(extra) + plain + PRIMER, extra + plain + PRIMER


class Compressors:
    def __init__(self, plain: bytes, toxic: bytes):
        settings = zstd.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.by = [zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=settings).compress for d in (plain, toxic)]
        self.known: dict[bytes, int] = {}

    def difference(self, window: bytes) -> int:
        framed = PRIMER + b"\n " + window + b"\n "
        if len(self.known) >= MEMO:
            self.known.clear()
        d = self.known[window] = len(self.by[0](framed)) - len(self.by[1](framed))
        return d

    def features(self, raw: bytes) -> list[float]:
        """Numbers of windows from each cut on, the largest difference, shares, the mean difference and the length."""
        get, find = self.known.get, self.difference
        d = np.array([find(w) if (x := get(w)) is None else x for w in windows(raw)], np.int64)
        n = max(1, len(d))
        over = [int((d >= c).sum()) for c in CUTS]
        return [*(math.log1p(x) for x in over), min(12, d.max(initial=0)) / 12, over[3] / n, d.sum() / n, math.log1p(len(d))]


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
    return w


def least_hashes(known: DataFrame, most: dict[int, int]) -> list:
    """The rows (id__, y__, h__) of least h__ of each class y__, as many as ``most`` says; h__ is spread over all longs.

    Only rows below a bound that about a quarter more than these pass are sent to the driver, whatever the number of tasks.
    """
    sizes = {r["y__"]: r["count"] for r in known.groupBy("y__").count().collect()}
    bounds = {y: min((1 << 63) - 1, int((most[y] + most[y] // 4 + 100) / n * (1 << 64)) - (1 << 63)) for y, n in sizes.items()}
    below = F.lit(False)
    for y, bound in bounds.items():
        below |= (F.col("y__") == y) & (F.col("h__") <= F.lit(bound).cast("long"))
    found = known.where(below).collect()
    picked = []
    for y, k in most.items():
        own = sorted((r for r in found if r["y__"] == y), key=lambda r: r["h__"])
        if len(own) < min(k, sizes.get(y, 0)):  # the hashes lie otherwise than expected
            own = known.where(F.col("y__") == y).orderBy("h__").limit(k).collect()
        picked += own[:k]
    return picked


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict | None:
    """Learn from a bounded sample of labelled rows for which ``learn`` (over the labels' id column) holds."""
    spark = docs.sparkSession
    known = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id__")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y__"))
    known = known.withColumn("h__", F.xxhash64(F.col("id__").cast("string"), F.lit("sample")))
    picked = least_hashes(known, {1: MAX_TOXIC, 0: MAX_ORDINARY})
    if len({r["y__"] for r in picked}) < 2:
        return None
    ids = spark.createDataFrame([(r["id__"], r["y__"]) for r in picked], known.select("id__", "y__").schema)
    raw = as_bytes(F.col(text_col))
    span, key = F.length(raw) - SLICE + 1, F.xxhash64(F.col(id_col).cast("string"))
    slices = F.concat(*[F.substring(raw, (F.pmod(F.xxhash64(key, F.lit(i)), F.greatest(span, F.lit(1))) + 1).cast("int"), F.lit(SLICE)) for i in range(SLICES)])
    sample = docs.join(F.broadcast(ids), docs[id_col] == F.col("id__")).select("id__", "y__", F.when(F.length(raw) > SLICE * SLICES, slices).otherwise(raw).alias("raw__"))
    rows = sorted({(r["id__"], r["y__"], bytes(r["raw__"])) for r in sample.collect()})
    y = np.array([r[1] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    plain, toxic = train_dictionaries([r[2] for r in rows if r[1]], [r[2] for r in rows if not r[1]])
    own = Compressors(plain, toxic)
    model = {"plain": plain, "toxic": toxic, "weights": calibrate(np.array([own.features(r[2]) for r in rows]), y)}
    del rows, own
    release()
    return model


def score(docs: DataFrame, model: dict | None, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with score and predicted (1 from 0.5 on) for every row; whole texts are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, as_bytes(F.col(text_col)).alias("raw__"))
    schema = rows.drop("raw__").schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        m = shared.value
        own = m and Compressors(m["plain"], m["toxic"])
        for b, raw in pieces(batches, -1):
            x = np.zeros((b.num_rows, len(CUTS) + 4))
            if m:
                for i in range(b.num_rows):
                    x[i] = own.features(raw[i])
            p = 1 / (1 + np.exp(-np.clip(x @ m["weights"][:-1] + m["weights"][-1], -30, 30))) if m else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*b.schema.names[:-1], "score", "predicted"])

    return rows.mapInArrow(run, schema)
