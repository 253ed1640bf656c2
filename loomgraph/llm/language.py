"""Language identification by a small byte convolutional network.

Filters of several widths slide over fixed-length byte windows, each filter keeps its largest response (max
pooling), and a softmax layer turns the pooled responses into language probabilities.  The network is trained
with numpy on a bounded, documented sample of labelled windows and then applied to every window of every text.

Defined results: a text that is null or holds no letter gets ``und`` with score 1.0; with no labelled row to learn
from every text gets ``und``; repeated rows are scored alike and each kept; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import as_bytes, pieces, release

WINDOW = 64
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Bounds of the training sample: labelled documents per language, windows drawn from each, and languages.
DOCS_PER_LANG, WINDOWS_PER_DOC, MAX_LANGS = 1500, 8, 256
CHUNK = 2048


def _pooled(windows: np.ndarray, filters: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Largest response of each filter in each window, and where it is."""
    best, where = [], []
    for w, table in zip(WIDTHS, filters, strict=True):
        n = windows.shape[1] - w + 1
        out = table[0][windows[:, :n]]
        for k in range(1, w):
            out = out + table[k][windows[:, k : k + n]]
        where.append(out.argmax(axis=1))
        best.append(np.take_along_axis(out, where[-1][:, None, :], axis=1)[:, 0, :])
    return best, where


def train(windows: np.ndarray, labels: np.ndarray, n_langs: int, epochs: int = 6, batch: int = 256, rate: float = 0.01, seed: int = 7) -> dict:
    """Fit filters and softmax by Adam; windows: (n, WINDOW) uint8, labels: (n,) class numbers."""
    rng = np.random.default_rng(seed)
    par = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    par += [np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n_langs)).astype(np.float32), np.zeros(n_langs, np.float32)]
    m, v = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            x, y = windows[order[at : at + batch]], labels[order[at : at + batch]]
            best, where = _pooled(x, par[: len(WIDTHS)])
            pre = np.concatenate(best, axis=1) + par[-3]
            hidden = np.maximum(pre, 0)
            z = hidden @ par[-2] + par[-1]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ par[-2].T) * (pre > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                g, part = np.zeros_like(par[i]), back[:, i * FILTERS : (i + 1) * FILTERS]
                rows, cols = np.arange(len(y))[:, None], np.arange(FILTERS)[None, :]
                for k in range(w):
                    np.add.at(g[k], (x[rows, where[i] + k], np.broadcast_to(cols, where[i].shape)), part)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                par[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return {"filters": par[: len(WIDTHS)], "bias": par[-3], "out": par[-2], "out_bias": par[-1]}


def _pair_tables(model: dict) -> list[list[tuple[int, np.ndarray]]]:
    """For each width, (offset, table) over byte pairs, or over single bytes for an odd last one: fewer lookups."""
    tables = []
    for w, f in zip(WIDTHS, model["filters"], strict=True):
        own = [(k, (f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, FILTERS)) for k in range(0, w - 1, 2)]
        tables.append(own + ([(w - 1, f[w - 1])] if w % 2 else []))
    return tables


def window_probabilities(windows: np.ndarray, model: dict, tables=None) -> np.ndarray:
    tables = tables or _pair_tables(model)
    pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
    best = []
    for w, own in zip(WIDTHS, tables, strict=True):
        n, out = WINDOW - w + 1, None
        for k, t in own:
            part = np.take(t, (pairs if len(t) > 256 else windows)[:, k : k + n], axis=0)
            out = part if out is None else np.add(out, part, out=out)
        best.append(out.max(axis=1))
    z = np.maximum(np.concatenate(best, axis=1) + model["bias"], 0) @ model["out"] + model["out_bias"]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def document_probabilities(texts: list[bytes], model: dict, tables=None) -> np.ndarray:
    """Mean of the window probabilities of each whole text; windows are cut every WINDOW bytes, the last is zero-padded."""
    n_langs = len(model["out_bias"])
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
    total = np.zeros((len(texts), n_langs))
    ends = np.cumsum(counts)
    first = 0
    while first < len(texts):  # texts of about 64 MB at a time
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 1_000_000)))
        flat = np.frombuffer(b"".join(t.ljust(int(c) * WINDOW, b"\0") for t, c in zip(texts[first:last], counts[first:last], strict=True)), np.uint8).reshape(-1, WINDOW)
        owner = np.repeat(np.arange(first, last), counts[first:last])
        for at in range(0, len(flat), CHUNK):
            p = window_probabilities(flat[at : at + CHUNK], model, tables)
            for c in range(n_langs):
                total[:, c] += np.bincount(owner[at : at + CHUNK], weights=p[:, c], minlength=len(texts))
        first = last
    return total / counts[:, None]


def fit(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """Train on windows drawn from all over the labelled texts where ``learn`` holds.

    The sample is bounded: about DOCS_PER_LANG documents per language, by hash of the id, WINDOWS_PER_DOC windows each.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    sizes = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return None
    langs = sorted(r["lang"] for r in sizes)
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit("sample"))
    share = F.coalesce(*[F.when(F.col(lang_col) == r["lang"], F.lit(min(1.0, DOCS_PER_LANG / r["count"]))) for r in sizes], F.lit(0.0))
    raw = as_bytes(F.col(text_col))
    span = F.greatest(F.lit(1), F.length(raw) - WINDOW + 1)
    cut = [F.substring(raw, (F.pmod(F.xxhash64(key, F.lit(i)), span) + 1).cast("int"), F.lit(WINDOW)) for i in range(WINDOWS_PER_DOC)]
    picked = rows.where((F.pmod(key, F.lit(1_000_003)) / 1_000_003.0) < share).select(key.alias("key"), F.col(lang_col).cast("string").alias("lang"), F.array(*cut).alias("cut"))
    sample = sorted(picked.orderBy("key").limit(2 * DOCS_PER_LANG * len(langs)).collect(), key=lambda r: (r["key"], r["lang"], r["cut"]))
    x = np.frombuffer(b"".join(bytes(c).ljust(WINDOW, b"\0") for r in sample for c in r["cut"]), np.uint8).reshape(-1, WINDOW)
    y = np.repeat([langs.index(r["lang"]) for r in sample], WINDOWS_PER_DOC)
    del sample
    model = train(x, y, len(langs)) | {"langs": langs}
    release()
    return model


def identify(docs: DataFrame, model: dict | None, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred and score for every row; whole texts are read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*keep, F.when(letters, as_bytes(F.col(text_col))).alias("raw__"))
    schema = rows.drop("raw__").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        net = shared.value
        tables = net and _pair_tables(net)
        for b, raw in pieces(batches, -1):
            has = [i for i, t in enumerate(raw) if t] if net else []
            lang, score = ["und"] * len(raw), np.ones(len(raw))
            if has:
                p = document_probabilities([raw[i] for i in has], net, tables)
                top = p.argmax(axis=1)
                for i, c in zip(has, top, strict=True):
                    lang[i] = net["langs"][c]
                score[has] = np.minimum(p[np.arange(len(has)), top], 1.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], names=[*b.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
