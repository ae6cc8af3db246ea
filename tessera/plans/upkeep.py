"""Queries on keeping an index: diffs, upserts, profiles, caches, samples, round trips, cleaning and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cleaning, features
from ..operators.index import Table, diff
from ..sources import files
from ..streaming import threads
from .common import table
from .texts import STATUS_SQL


def _old(spark: SparkSession, d: str) -> DataFrame:
    """What an index holds: documents whose id is no multiple of 7, some with another hash, and some that are gone from the source."""
    docs = table(spark, d, "documents")
    old = docs.filter("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit("stale")).otherwise(F.sha2("text", 256)).alias("hash"))
    return old.unionByName(table(spark, d, "benchmark").select((-F.col("item_id") - 1).alias("doc_id"), F.sha2("text", 256).alias("hash")))


def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    return diff(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash")), _old(spark, d), "doc_id", "hash")


DIFF_SQL = """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS action FROM documents UNION ALL SELECT -item_id - 1, 'pruned' FROM benchmark"""


def upsert_delete(spark: SparkSession, d: str) -> DataFrame:
    """A table of documents, changed rows put in, others deleted; its state at the end."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    t = Table(spark, files.scratch(spark, "upsert"), "doc_id", 8)
    t.create(docs)
    new = docs.filter("doc_id % 3 = 0").withColumn("source", F.concat("source", F.lit("-new")))
    t.upsert(new.unionByName(docs.filter("doc_id % 10 = 1").withColumn("doc_id", -F.col("doc_id") - 1)), delete=docs.filter("doc_id % 4 = 1").select("doc_id"))
    return t.read().select("doc_id", "lang", "source")


UPSERT_SQL = """SELECT doc_id, lang, source || CASE WHEN doc_id % 3 = 0 THEN '-new' ELSE '' END AS source FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 <> 1 UNION ALL SELECT -doc_id - 1, lang, source FROM documents WHERE doc_id % 10 = 1"""


def profile_selection(spark: SparkSession, d: str) -> DataFrame:
    """How each document gets its profile: unchanged by hash, from a partner's facts, from a model, or by heuristics."""
    x = table(spark, d, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("now")).join(_old(spark, d), "doc_id", "left")
    how = F.when(F.col("now") == F.col("hash"), "unchanged").when(F.col("source") == "src3", "partner").when(F.col("lang") == "fr", "llm").otherwise("heuristic")
    return x.select("doc_id", how.alias("outcome"))


PROFILE_SQL = """SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN 'unchanged' WHEN source = 'src3' THEN 'partner' WHEN lang = 'fr' THEN 'llm' ELSE 'heuristic' END AS outcome FROM documents"""


def cache_join(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts are looked up once in a content-addressed cache, misses computed once, results given to every copy; hits and misses by language."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text", files.cache_key("embedding", "hashed", F.col("text")).alias("key"))
    cache = docs.filter("doc_id % 2 = 0").groupBy("key").agg(F.first(F.length("text")).alias("value"))
    need = docs.groupBy("key").agg(F.first("text").alias("text")).join(cache, "key", "left_anti")
    value = cache.withColumn("hit", F.lit(True)).unionByName(need.select("key", F.length("text").alias("value"), F.lit(False).alias("hit")))
    x = docs.join(value, "key")
    return x.groupBy("lang").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.sum("value").alias("total"))


CACHE_SQL = """WITH c AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0) SELECT lang, count(*) FILTER (text IN (SELECT text FROM c)) AS hits, count(*) FILTER (text NOT IN (SELECT text FROM c)) AS misses, sum(length(text))::BIGINT AS total FROM documents GROUP BY lang"""


def silver_sample(spark: SparkSession, d: str) -> DataFrame:
    """A fixed sample by hash order: question, expected document, keywords and reference of each, and out-of-scope questions."""
    x = table(spark, d, "documents").withColumn("o", F.md5(F.concat(F.lit("42-"), F.col("doc_id").cast("string")))).orderBy("o", "doc_id").limit(25)
    key = F.array_join(F.slice(F.array_distinct(F.filter(T.tokens(F.col("text")), lambda w: F.length(w) > 5)), 1, 3), ",")
    q = x.select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id"), key.alias("keywords"), F.left("text", F.lit(60)).alias("reference"))
    out = spark.range(1, 7).select(F.concat(F.lit("out"), F.col("id").cast("string")).alias("id"), F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("keywords"), F.lit("").alias("reference"))
    return q.unionByName(out)


SAMPLE_SQL = r"""WITH x AS (SELECT * FROM documents ORDER BY md5('42-' || doc_id), doc_id LIMIT 25), w AS (SELECT doc_id, text, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda v: length(v) > 5) AS w FROM x)
SELECT 'q' || doc_id AS id, doc_id, coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda v: {'i': list_position(w, v), 'v': v}))[1:3], lambda s: s.v), ','), '') AS keywords, left(text, 60) AS reference FROM w
UNION ALL SELECT 'out' || i, NULL, '', '' FROM range(1, 7) AS r(i)"""


def csv_jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """All documents through an export CSV and through JSON lines, with what comes back."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    at = files.scratch(spark, "roundtrip")
    files.write_export(docs, f"{at}/csv")
    docs.drop("source").write.mode("overwrite").json(f"{at}/jsonl")
    schema = "doc_id long, lang string, source string, text string"
    a = files.read_export(spark, f"{at}/csv", schema).select(F.lit("csv").alias("form"), "doc_id", "lang", "source", F.md5("text").alias("text_md5"))
    b = files.read_jsonl(spark, f"{at}/jsonl", schema, {"source": F.lit("unknown")}).select(F.lit("jsonl").alias("form"), "doc_id", "lang", "source", F.md5("text").alias("text_md5"))
    return a.unionByName(b)


ROUNDTRIP_SQL = """SELECT 'csv' AS form, doc_id, lang, source, md5(text) AS text_md5 FROM documents UNION ALL SELECT 'jsonl', doc_id, lang, 'unknown', md5(text) FROM documents"""


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a block of front matter (some without, some with a byte order mark), split again."""
    block = F.concat(F.lit('---\ndoc_id: "'), F.col("doc_id").cast("string"), F.lit('"\ntags: ['), "lang", F.lit(", "), "source", F.lit("]\n---\n"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.concat(block, "text")).otherwise(F.concat(F.lit("﻿"), block, "text"))
    fields, body = files.split_front_matter(F.col("raw"))
    x = table(spark, d, "documents").select(F.col("doc_id").alias("id"), raw.alias("raw"))
    return x.select("id", fields["doc_id"].alias("doc_id"), F.array_join(files.as_list(F.coalesce(fields["tags"], F.lit(""))), "+").alias("tags"), F.md5(body).alias("body_md5"))


FRONT_SQL = """SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN doc_id::VARCHAR END AS doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang || '+' || source ELSE '' END AS tags, md5(text) AS body_md5 FROM documents"""


def heuristic_profile(spark: SparkSession, d: str) -> DataFrame:
    """Type by ordered rules, audiences, tasks and a summary of three sentences."""
    t = F.col("text")
    kind = F.when(t.rlike("(?i)license"), "legal").when(t.contains("|"), "table").when(t.rlike(r"[#$%&]{3}"), "noise").when(F.length(t) > 4000, "guide").otherwise("article")
    audience = F.filter(F.array(F.when(t.contains("@"), "contact"), F.when(F.length(t) > 2000, "expert"), F.lit("all")), lambda x: x.isNotNull())
    summary = F.left(F.array_join(F.slice(T.sentences(t), 1, 3), " "), F.lit(450))
    return table(spark, d, "documents").select("doc_id", kind.alias("doc_type"), F.array_join(F.slice(F.array_distinct(audience), 1, 3), ",").alias("audiences"), F.md5(summary).alias("summary_md5"))


HEURISTIC_SQL = r"""WITH s AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 25 AND NOT regexp_matches(x, '^[#|]')) AS s FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license') THEN 'legal' WHEN contains(text, '|') THEN 'table' WHEN regexp_matches(text, '[#$%&]{3}') THEN 'noise' WHEN length(text) > 4000 THEN 'guide' ELSE 'article' END AS doc_type,
concat_ws(',', CASE WHEN contains(text, '@') THEN 'contact' END, CASE WHEN length(text) > 2000 THEN 'expert' END, 'all') AS audiences, md5(left(coalesce(array_to_string(s[1:3], ' '), ''), 450)) AS summary_md5 FROM s"""


def heuristic_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Kind of a page or document: hint, then status codes, code, links, parameters; overrides last; the forced value wins over the model's, that over the hint."""
    p = table(spark, d, "pages").select("page_id", F.col("html").alias("text"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    hint = F.when(F.col("page_id") % 5 == 0, F.lit("hinted"))
    model = F.nullif(F.when(F.col("page_id") % 3 == 0, F.lit("model")).otherwise(F.lit("")), F.lit(""))
    base = F.coalesce(hint, F.when(F.size(features.status_codes(F.col("text"))) > 0, "errors").when(F.col("text").contains("<code"), "code").when(F.col("text").contains("href="), "links").otherwise("text"))
    forced = F.when(F.lower("title").startswith("the"), F.lit("forced"))
    return p.select("page_id", F.coalesce(forced, model, base).alias("kind"))


ENRICHMENT_SQL = """WITH p AS (SELECT page_id, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages), s AS (SELECT id FROM (STATUS) WHERE kind = 'page' AND n_codes > 0)
SELECT page_id, CASE WHEN lower(title) LIKE 'the%' THEN 'forced' WHEN page_id % 3 = 0 THEN 'model' WHEN page_id % 5 = 0 THEN 'hinted' WHEN page_id IN (SELECT id FROM s) THEN 'errors' WHEN contains(html, '<code') THEN 'code' WHEN contains(html, 'href=') THEN 'links' ELSE 'text' END AS kind FROM p"""


def partner_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of partner sheets made of each document's fields."""
    sheet = F.concat(
        F.lit("# Partner\nCode apporteur : "), F.upper("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit("\nLettre d'autorisation : "), F.when(F.col("doc_id") % 2 == 0, "oui").otherwise("non"),
        F.lit("\n## Produits agrégés\n- "), "lang", F.lit("\n- "), F.left("source", F.lit(3)), F.lit("\n## Flux\nPrix moyen transmis : "), F.when(F.col("doc_id") % 3 == 0, "oui").otherwise("non"), F.lit("\nFréquence "), F.when(F.col("doc_id") % 5 == 0, "Mensuelle").otherwise("libre"),
    )
    x = table(spark, d, "documents").select("doc_id", sheet.alias("s"))
    f = cleaning.partner_facts(F.col("s"))
    return x.select("doc_id", f["code"].alias("code"), f["letter"].alias("letter"), f["average_price"].alias("average_price"), f["frequency"].alias("frequency"), F.array_join(f["products"], ",").alias("products"))


PARTNER_SQL = """SELECT doc_id, upper(source) || '-' || doc_id AS code, doc_id % 2 = 0 AS letter, doc_id % 3 = 0 AS average_price, CASE WHEN doc_id % 5 = 0 THEN 'mensuelle' END AS frequency, lang || ',' || left(source, 3) AS products FROM documents"""


def stream_thread_state(spark: SparkSession, d: str) -> DataFrame:
    at = threads.thread_checkpoint(threads.event_stream(spark, d), "threads")
    return threads.stored_state(spark, at).select("user_id", "n", F.round("total", 4).alias("total"))


def state_store_read(spark: SparkSession, d: str) -> DataFrame:
    """The checkpoint of the thread state: the last reset of every user, and how many of the events after it a late reset could still take back."""
    at = threads.thread_checkpoint(threads.event_stream(spark, d), "history")
    kept = threads.open_events(spark, at).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_open"))
    return threads.stored_state(spark, at).join(kept, "user_id", "left").select("user_id", "last_reset", "n", F.coalesce("n_open", F.lit(0)).alias("n_open"))


THREAD_SQL = """WITH l AS (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS last FROM events GROUP BY ALL)
SELECT user_id, count(*) FILTER (event_id > coalesce(last, -1)) AS n, round(coalesce(sum(value) FILTER (event_id > coalesce(last, -1)), 0), 4) AS total FROM events JOIN l USING (user_id) GROUP BY user_id"""


STATE_SQL = """SELECT user_id, max(event_id) FILTER (event_type = 'error') AS last_reset, count(*) FILTER (event_id > coalesce(last, -1)) AS n, count(*) FILTER (event_id > coalesce(last, -1)) AS n_open
FROM events JOIN (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS last FROM events GROUP BY ALL) USING (user_id) GROUP BY user_id"""


def stream_first_token(spark: SparkSession, d: str) -> DataFrame:
    """From every view to the user's next click within two hours."""
    return threads.first_token(threads.event_stream(spark, d), "view", "click", "first-token", "2 hours")


FIRST_SQL = """SELECT s.event_id AS start_id, s.user_id, min(epoch_us(t.ts) - epoch_us(s.ts)) // 1000 AS ms FROM events s LEFT JOIN events t ON t.user_id = s.user_id AND t.event_type = 'click' AND t.ts BETWEEN s.ts AND s.ts + INTERVAL 2 HOUR
WHERE s.event_type = 'view' GROUP BY ALL"""


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return threads.drained(threads.event_stream(spark, d), threads.sessions, "sessions")


SESSION_SQL = """WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR AS gap FROM events), s AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS seconds FROM s GROUP BY user_id, s"""


def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return threads.run_once(threads.daily_counts(threads.event_stream(spark, d)), "daily", "complete")


DAILY_SQL = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return threads.run_once(threads.first_seen(threads.event_stream(spark, d)), "dedup", "append")


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    s = threads.event_stream(spark, d).select("user_id", "event_id", "event_type", "value")
    return threads.ingest(s, "user_id", "event_id", "ingest")


INGEST_SQL = "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"

QUERIES = {
    "incremental_diff": (incremental_diff, DIFF_SQL),
    "upsert_delete": (upsert_delete, UPSERT_SQL),
    "profile_selection": (profile_selection, PROFILE_SQL),
    "cache_join": (cache_join, CACHE_SQL),
    "silver_sample": (silver_sample, SAMPLE_SQL),
    "csv_jsonl_roundtrip": (csv_jsonl_roundtrip, ROUNDTRIP_SQL),
    "front_matter": (front_matter, FRONT_SQL),
    "heuristic_profile": (heuristic_profile, HEURISTIC_SQL),
    "heuristic_enrichment": (heuristic_enrichment, ENRICHMENT_SQL.replace("STATUS", STATUS_SQL)),
    "partner_facts": (partner_facts, PARTNER_SQL),
    "stream_thread_state": (stream_thread_state, THREAD_SQL),
    "state_store_read": (state_store_read, STATE_SQL),
    "stream_first_token": (stream_first_token, FIRST_SQL),
    "stream_sessions": (stream_sessions, SESSION_SQL),
    "stream_daily_counts": (stream_daily_counts, DAILY_SQL),
    "stream_dedup": (stream_dedup, "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_ingest": (stream_ingest, INGEST_SQL),
}
