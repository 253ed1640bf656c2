"""Lineage cuts and distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where the session names none, as in tests."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            import tempfile

            named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there: no executor's loss can undo it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, component) for every id in ``edges`` (columns src, dst); component is the smallest id reachable.

    Alternating large-star and small-star steps: each links an id's neighbours to their minimum, so the edges become
    stars in a logarithmic number of rounds.  Minima are taken map-side first; no neighbourhood is ever collected.
    Every exchange of a plan keeps a thread, its stack and its part of the plan in the driver for a minute, so no round
    runs only to see that nothing changes.
    """
    now = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    alone = edges.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component"))
    for _ in range(max_rounds):
        if are_stars(now):
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(small)
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).union(alone).groupBy("id").agg(F.min("component").alias("component"))


def are_stars(edges: DataFrame) -> bool:
    """Whether every u of distinct edges (u, v) with u > v has one v, which is no u itself: v is its component then."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("k")).union(edges.select(F.col("v").alias("id"), F.lit(0).alias("k")))
    uses = ends.groupBy("id").agg(F.sum("k").alias("k"), F.min("k").alias("least"))
    return not uses.where("k > 1 or k = 1 and least = 0").agg(F.count(F.lit(1))).first()[0]
