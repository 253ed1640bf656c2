"""Corpus pipeline: language, toxicity, near duplicates, decontamination, mixing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.iterate import checkpoint_dir, cut
from loomgraph.llm import decontaminate, jaccard, language, mixing, toxicity
from loomgraph.llm.common import remainder, table

#: A document whose language is less sure than this is rejected.
LEAST_SURE = 0.4


#: What stands for a row where stages remove rows: null ids last, and a repeated id apart by its text.
KEY = "key__"


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with a key that only rows of the same id and text share."""
    return docs.withColumn(KEY, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose key isn't among keys."""
    gone = keys.select(F.col(KEY).alias("gone__")).distinct()
    return docs.join(gone, F.col(KEY) == F.col("gone__"), "left_anti")


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the network knows and is sure of; texts without letters go."""
    model = language.fit(docs, F.coalesce(remainder(F.col("doc_id"), 4) != 2, F.lit(False)))
    judged = language.identify(docs, model, keep=docs.columns)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE)).select(*docs.columns)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.coalesce(remainder(F.col("doc_id"), 5) != 0, F.lit(False)))
    return toxicity.score(docs, model, keep=docs.columns).where("predicted = 0").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each group of near duplicates (five words, similarity 0.8); rows without words stay."""
    own = _keyed(docs)
    groups = cut(jaccard.classes(own, n=5, num=4, den=5, id_col=KEY))
    least = _without(own, groups.where("id <> component_id").select(F.col("id").alias(KEY)))
    # Rows that share id and text: one of them, the least by all columns.
    twice = groups.where("n_shingles > 0").groupBy("id").count().where("count > 1").select(F.col("id").alias(KEY))
    equals = least.join(twice.select(F.col(KEY).alias("twice__")), F.col(KEY) == F.col("twice__"), "left_semi")
    one = equals.groupBy(KEY).agg(F.min(F.struct(*docs.columns)).alias("row__"))
    return _without(least, twice).select(*docs.columns).union(one.select("row__.*"))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    own = _keyed(docs)
    return _without(own, decontaminate.leaks(own, table(spark, sf_dir, "benchmark"), id_col=KEY)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Readings of the documents by source weights; every source is read whole at least once."""
    return mixing.mix(docs, max_repeats=2.0, keep=docs.columns)


STAGES = [("language", by_language), ("toxicity", by_toxicity), ("near_duplicates", one_of_each_group), ("decontamination", without_leaks), ("mixing", mixed)]

#: The first two stages apply trained models, which SQL can't express; tests hold near duplicates and leaks against brute force, and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
