"""What toxicity's learning asks of the driver."""

import tracemalloc

from pyspark.sql import functions as F

from loomgraph.llm import toxicity


def results(spark) -> dict[int, int]:
    """Bytes that the tasks of each stage so far sent to the driver."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return {s.stageId(): s.resultSize() for s in (stages.apply(i) for i in range(stages.size()))}


def test_labels_sent_to_the_driver_do_not_grow_with_tasks(spark):
    n, held = 200_000, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    docs = spark.createDataFrame([(1, "quiet words"), (10, "loud words")], "doc_id long, text string")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        before = results(spark)
        toxicity.fit(docs, labels, F.lit(True))
        sent = sum(v for k, v in results(spark).items() if k not in before)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sent < 800_000


def test_sample_is_that_of_least_hashes(spark):
    known = spark.range(20_000).select(F.col("id").alias("id__"), (F.col("id") % 7 == 0).cast("int").alias("y__"), F.xxhash64(F.col("id").cast("string"), F.lit("sample")).alias("h__"))
    for rows, most in ((known, {1: 300, 0: 500}), (known, {1: 5000, 0: 17_000}), (known.withColumn("h__", F.abs("h__")), {1: 300, 0: 500}), (known.where("y__ = 0"), {1: 5, 0: 5}), (known.limit(0), {1: 5, 0: 5})):
        want = [r for y, k in most.items() for r in rows.where(F.col("y__") == y).orderBy("h__").limit(k).collect()]
        assert toxicity.least_hashes(rows, most) == want


def test_training_windows_are_not_held_at_once():
    ordinary = [" ".join(f"w{i * j % 997}" for j in range(1000)).encode() for i in range(500)]
    tracemalloc.start()
    try:
        toxicity.train_dictionaries([], ordinary)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 12_000_000
