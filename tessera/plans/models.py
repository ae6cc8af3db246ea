"""Queries through providers, with their stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexical, providers
from . import retrieval as R
from .common import SQL_TOKENS, table

REFUSAL = "Je ne sais pas."


def provider_rerank(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("asked"))
    hits = R._found(spark, d, R.POOL).select("item_id", "doc_id", F.col("rank").alias("was")).join(docs, "doc_id").join(items, "item_id")
    out = providers.scored(hits, providers.OverlapScorer(), F.col("asked"), F.col("text"), "rerank_score")
    return lexical.top_k(out, "item_id", "was", R.TOP, "rerank_score").select("item_id", "rank", "doc_id", "rerank_score", "was")


RERANK_SQL = f"""WITH {R.SQL_HITS},
d AS (SELECT doc_id, list_distinct({SQL_TOKENS.format("left(text, 1500)")}) AS dw FROM documents), q AS (SELECT item_id, list_distinct({SQL_TOKENS.format("text")}) AS qw FROM benchmark),
s AS (SELECT item_id, doc_id, rank AS was, round(len(list_intersect(qw, dw)) / len(qw), 6) AS rerank_score FROM pool JOIN d USING (doc_id) JOIN q USING (item_id))
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, was) AS rank, doc_id, rerank_score, was FROM s) WHERE rank <= {R.TOP}"""


def grounded_answers(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items answered from their best three documents over a score; without one the refusal is given. Status and citations follow from the text."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    hits = R._found(spark, d, 3).filter("score >= 40").join(docs, "doc_id")
    context = hits.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("context"))
    x = table(spark, d, "benchmark").select("item_id", "text").join(context, "item_id", "left").withColumn("context", F.coalesce("context", F.array().cast("array<string>")))
    prompt = F.to_json(F.struct(F.col("text").alias("question"), "context", F.lit(REFUSAL).alias("refusal")))
    out = providers.completed(x, prompt, providers.Extractive())
    status = F.when(F.col("answer").contains(REFUSAL), "refused").when(F.col("answer").rlike(r"\[S\d+\]"), "answered").otherwise("ungrounded")
    return out.select("item_id", "answer", status.alias("status"), F.size("context").alias("n_sources"))


ANSWERS_SQL = f"""WITH {R.SQL_HITS}, h AS (SELECT item_id, count(*) AS n, arg_min(text, rank) AS best FROM hits JOIN documents USING (doc_id) WHERE rank <= 3 AND score >= 40 GROUP BY ALL),
a AS (SELECT item_id, coalesce(n, 0)::INT AS n_sources, trim(string_split(coalesce(best, ''), '.')[1]) AS s FROM benchmark LEFT JOIN h USING (item_id))
SELECT item_id, CASE WHEN s = '' THEN '{REFUSAL}' ELSE s || '. [S1]' END AS answer, CASE WHEN s = '' THEN 'refused' ELSE 'answered' END AS status, n_sources FROM a"""


def provider_embedding(spark: SparkSession, d: str) -> DataFrame:
    e = providers.embedded(table(spark, d, "benchmark"), "item_id", F.col("text"), providers.HashEmbedder())
    return e.select("item_id", F.posexplode("embedding").alias("bucket", "n")).filter("n > 0").select("item_id", "bucket", F.col("n").cast("long").alias("n"))


def judged_answers(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts as a judge would send them, as text around JSON: parsed by schema, out-of-range scores refused, broken ones told as such."""
    x = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    raw = F.when(F.col("doc_id") % 9 == 0, F.lit("sorry, no verdict")).otherwise(
        F.concat(F.lit("```json\n"), F.to_json(F.struct(F.when(F.col("quality") == 1, "correct").otherwise("incorrect").alias("verdict"), ((F.col("doc_id") % 14) / 10).alias("completeness"))), F.lit("\n```"))
    )
    j = providers.structured(raw, "verdict string, completeness double")
    ok = j["completeness"].between(0, 1)
    return x.select(F.when(ok, j["verdict"]).otherwise("invalid").alias("verdict"), F.when(ok, j["completeness"]).alias("c")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("completeness"))


JUDGE_SQL = """WITH x AS (SELECT CASE WHEN doc_id % 9 = 0 OR doc_id % 14 > 10 THEN 'invalid' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS verdict, (doc_id % 14)::DOUBLE / 10 AS c FROM labels)
SELECT verdict, count(*) AS n, round(avg(CASE WHEN verdict <> 'invalid' THEN c END), 6) AS completeness FROM x GROUP BY verdict"""

QUERIES = {
    "provider_rerank": (provider_rerank, RERANK_SQL),
    "grounded_answers": (grounded_answers, ANSWERS_SQL),
    "provider_embedding": (provider_embedding, R._buckets("item_id", "benchmark")),
    "judged_answers": (judged_answers, JUDGE_SQL),
}
