"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent a between 0 (uniform) and 1 (as they are) and normalised.  The exponent
is found by bisection: the largest that reaches a target entropy, and then no smaller than the smallest that repeats no
source more often than a limit.  Weights become token budgets; a source's budget is spent in passes, each of which goes
through the source's blocks of texts in an order of its own.  The last pass takes whole blocks while the budget lasts
and of the next one texts in their order, so a source misses its budget by less than one text.

Blocks are hash buckets whose number follows the source's size, and running sums go over blocks (and over the texts of
one block), so a source with a third of all texts is no task of its own.

Defined results: a null source is a source like others; null and wordless texts have no tokens and go along in whole
blocks; a source without tokens gets no rows; rows that repeat an id are texts of their own; empty tables give none.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import WORD

BLOCK_DOCS, MAX_SOURCES = 256, 1_000_000


def weights(tokens: dict, exponent: float) -> dict:
    """p**exponent, normalised, over sources that have tokens."""
    total = sum(tokens.values())
    raised = {s: math.exp(exponent * math.log(t / total)) for s, t in tokens.items() if t}
    whole = sum(raised[s] for s in sorted(raised, key=repr))
    return {s: x / whole for s, x in raised.items()}


def entropy(w: dict) -> float:
    return -sum(x * math.log(x) for x in w.values() if x)


def budget_for(tokens: dict, w: dict, budget: float | None) -> float:
    """The given budget, or the least that holds every source whole."""
    return float(budget) if budget is not None else max(tokens[s] / x for s, x in w.items())


def repeats(tokens: dict, w: dict, budget: float | None) -> float:
    total = budget_for(tokens, w, budget)
    return max(x * total / tokens[s] for s, x in w.items())


def bisect(holds, rounds: int = 60) -> float:
    """Smallest exponent in [0, 1] from which ``holds`` is true, which is monotone; 1.0 if it never is."""
    lo, hi = 0.0, 1.0
    if holds(lo):
        return lo
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if holds(mid) else (mid, hi)
    return hi


def exponent_for(tokens: dict, *, target_entropy: float | None, max_repeats: float | None, budget: float | None) -> float:
    """target_entropy: in nats, met from above as far as the sources allow; max_repeats: passes over a source."""
    a = 0.0 if target_entropy is None else bisect(lambda x: entropy(weights(tokens, x)) <= target_entropy)
    if max_repeats is not None:
        a = max(a, bisect(lambda x: repeats(tokens, weights(tokens, x), budget) <= max_repeats * (1 + 1e-12)))
    return a


def mix(docs: DataFrame, *, target_entropy: float | None = None, max_repeats: float | None = 2.0, budget: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (id and source by default) with n_tokens, pass, block_order and doc_order: the order of reading.

    A row stands for one reading of a text; texts of a source that is repeated come once per pass.
    """
    spark = docs.sparkSession
    keep = keep or [id_col, source_col]
    rows = docs.select(*[F.col(c) for c in keep], F.col(source_col).alias("src__"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("h__"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    sizes = rows.groupBy("src__").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = {r["src__"]: r["tokens"] for r in sizes}
    plan = []
    if sum(tokens.values()):
        w = weights(tokens, exponent_for(tokens, target_entropy=target_entropy, max_repeats=max_repeats, budget=budget))
        total = budget_for(tokens, w, budget)
        for r in sizes:
            if r["tokens"]:
                own = round(w[r["src__"]] * total)
                plan.append((r["src__"], own // r["tokens"], own % r["tokens"], -(-r["docs"] // BLOCK_DOCS)))
    kind = rows.schema["src__"].dataType.simpleString()
    # At most MAX_SOURCES rows of four numbers.
    planned = F.broadcast(spark.createDataFrame(plan, f"src__ {kind}, whole__ bigint, rest__ bigint, blocks__ bigint"))
    same = lambda a, b: a["src__"].eqNullSafe(b["src__"])
    dealt = rows.join(planned, same(rows, planned)).drop(planned["src__"]).withColumn("block__", F.pmod("h__", F.col("blocks__")))
    order = lambda p: F.xxhash64(F.col("src__"), p, F.col("block__"), F.lit(seed))
    blocks = dealt.groupBy("src__", "block__", "whole__", "rest__").agg(F.sum("n_tokens").alias("n"))
    last = blocks.withColumn("before__", F.coalesce(F.sum("n").over(Window.partitionBy("src__").orderBy(order(F.col("whole__")), "block__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = last.where(F.col("before__") < F.col("rest__")).select("src__", "block__", "before__", (F.col("before__") + F.col("n") <= F.col("rest__")).alias("entire__"))
    marked = dealt.join(last.withColumnRenamed("src__", "s__").withColumnRenamed("block__", "b__"), F.col("src__").eqNullSafe(F.col("s__")) & (F.col("block__") == F.col("b__")), "left")
    out = [*keep, "n_tokens"]
    shown = lambda df, p: df.select(*out, p.cast("int").alias("pass"), order(p).alias("block_order"), F.xxhash64("h__", p).alias("doc_order"))
    times = F.when(F.col("entire__"), F.col("whole__") + 1).otherwise(F.col("whole__"))
    read = marked.withColumn("p__", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<bigint>"))))
    part = marked.where(~F.col("entire__")).withColumn("sum__", F.sum("n_tokens").over(Window.partitionBy("src__", "block__").orderBy(F.xxhash64("h__", F.col("whole__")), "h__").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    part = part.where(F.col("before__") + F.col("sum__") <= F.col("rest__"))
    return shown(read, F.col("p__")).unionByName(shown(part, F.col("whole__")))
