"""One query per corpus operator, over whole tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import chat, decontaminate, html, jaccard, language, lm, mixing, topk, toxicity, urls
from loomgraph.llm.common import remainder, table

#: The rules op3 applies: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), max_repeats=2.0)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = remainder(F.col("doc_id"), 5)
    return lm.score(table(spark, sf_dir, "documents"), F.coalesce(rest != 1, F.lit(False)), rest == 1)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules, keep=["page_id"])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))), model, keep=["doc_id", "held_out"])


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, remainder(F.col("doc_id"), 4) != 2)
    return language.identify(docs.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))), model, keep=["doc_id", "held_out"])


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(table(spark, sf_dir, "conversations"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), n=3, num=90, den=100).withColumnRenamed("id", "doc_id")


def op10_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_jaccard with each document's number of links."""
    return jaccard.classes(table(spark, sf_dir, "documents"), n=3, num=90, den=100, links=True).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_mixing, op2_lm_score, op3_url_rules, op4_toxicity, op5_language, op6_top_k, op7_chat, op8_html, op9_decontamination, op10_jaccard, op10_jaccard_links, pipeline)
    return {f.__name__: f for f in own}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES = {
    "op3_url_rules": rf"""
WITH rules(rhost, rpath, v) AS (VALUES {_RULES}),
behind AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, regexp_extract(r, '^[^?#]*') AS r FROM behind),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/]*'), '{_UPPER}', '{_LOWER}') AS host, CASE WHEN strpos(r, '/') > 0 THEN substr(r, strpos(r, '/')) ELSE '' END AS path FROM cut),
fits AS (
  SELECT page_id, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, v DESC) AS k
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1""",
    "op6_top_k": """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM x q JOIN x c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op10_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id WHERE 10 * least(p.n, q.n) >= 9 * greatest(p.n, q.n)
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
reach(root, node) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.root, l.y FROM reach r JOIN links l ON l.x = r.node)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, (SELECT min(r.node) FROM reach r WHERE r.root = n.doc_id) AS component_id FROM n""",
}
ORACLES["op10_jaccard_links"] = ORACLES["op10_jaccard"].removesuffix(" FROM n") + ", (SELECT count(*) FROM links l WHERE l.x = n.doc_id) AS n_links FROM n"


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
