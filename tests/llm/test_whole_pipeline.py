"""Stages on rows whose ids are null or repeat."""

import random

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n=60):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def stage(spark, tmp_path, f, rows, items=()):
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return sorted((tuple(r)[:2] for r in f(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()), key=str)


def test_near_duplicates_keep_one_of_each_group(spark, tmp_path):
    rng = random.Random(2)
    a, b, c, d = (prose(rng) for _ in range(4))
    texts = [(1, a), (1, a), (2, b), (2, c), (None, a + " x"), (None, d), (None, d), (None, d + " x"), (3, c + " x"), (4, ""), (4, ""), (None, None)]
    got = stage(spark, tmp_path, corpus_pipeline.one_of_each_group, [(i, t, "en", "s", 0) for i, t in texts])
    ds = [t for i, t in got if i is None and t]
    assert len(ds) == 1 and ds[0] in (d, d + " x")
    assert [x for x in got if x != (None, ds[0])] == sorted([(1, a), (2, b), (2, c), (4, ""), (4, ""), (None, None)], key=str)


def test_one_leak_removes_no_clean_namesake(spark, tmp_path):
    rng = random.Random(3)
    item = prose(rng, 40)
    leaked = [(None, item + " " + prose(rng, 5)), (7, prose(rng, 9) + " " + item), (8, item), (8, item)]
    clean = [(None, prose(rng)), (7, prose(rng)), (9, prose(rng)), (None, None)]
    got = stage(spark, tmp_path, corpus_pipeline.without_leaks, [(i, t, "en", "s", 0) for i, t in leaked + clean], [(1, item)])
    assert got == sorted(clean, key=str)
