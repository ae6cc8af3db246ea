"""Evaluation queries: retrieval and answer quality, refusals, latency, cost, causes and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features, metrics, reports
from ..sources.files import fingerprint, named, scratch, stored
from . import retrieval as R
from . import texts
from .common import SQL_FOLD, SQL_TOKENS, table


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """A document is a target of an item if it covers four fifths of the item's shingles. Found once per application and tables, as the index is made."""
    found = texts.shingle_overlap(spark, d).filter("covered").select("item_id", "doc_id")
    at = named(spark, fingerprint(found, "targets"), lambda at: stored(found, f"{at}/rows"))
    return spark.read.parquet(f"{at}/rows").select("item_id", F.col("doc_id").alias("target"), "doc_id")


SQL_RANKED = f"tg AS (SELECT item_id, doc_id FROM ({texts.SHINGLE_SQL}) WHERE covered), {R.SQL_HITS}, rk AS (SELECT item_id, doc_id, rank FROM hits WHERE rank <= {R.TOP})"


def _located(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, url, breadcrumb of every document, as a hit carries them."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return docs.select("doc_id", F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "doc_id").alias("url"), F.concat_ws(" > ", "source", "lang").alias("breadcrumb"))


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    """Targets of every kind, by the item's number: the document, its page as another would write the address, the document in a section, or a section wherever it is."""
    t = _targets(spark, d).join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    kind, doc = F.col("item_id") % 4, F.col("doc_id").cast("string")
    section = F.upper(F.concat_ws(" > ", "source", "lang"))
    t = t.select("item_id", F.when(kind.isin(0, 2), doc).alias("target_doc"), F.when(kind == 1, F.concat(F.lit("HTTP://"), "source", F.lit(".Example.org/"), "doc_id", F.lit("/?utm=1#top"))).alias("target_url"), F.when(kind.isin(2, 3), section).alias("section"))
    return t.withColumn("target", F.to_json(F.struct("target_doc", "target_url", "section"))).distinct()


SQL_MET = f"""{SQL_RANKED}, wt AS (SELECT DISTINCT item_id, CASE WHEN item_id % 4 IN (0, 2) THEN doc_id END AS td, CASE WHEN item_id % 4 = 1 THEN doc_id END AS tu, CASE WHEN item_id % 4 IN (2, 3) THEN source || ' > ' || lang END AS ts FROM tg JOIN documents USING (doc_id)),
tn AS (SELECT *, row_number() OVER (ORDER BY item_id, td, tu, ts) AS target FROM wt),
mt AS (SELECT tn.item_id, target, rank FROM tn JOIN rk USING (item_id) JOIN documents d USING (doc_id) WHERE CASE WHEN td IS NOT NULL THEN td = doc_id AND (ts IS NULL OR ts = source || ' > ' || lang) WHEN tu IS NOT NULL THEN tu = doc_id ELSE ts = source || ' > ' || lang END)"""


def _metrics(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    ranked = hits.join(_located(spark, d), "doc_id").withColumn("doc_id", F.col("doc_id").cast("string"))
    return metrics.retrieval(ranked, _wanted(spark, d), "item_id")


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d, R.bm25_topk(spark, d))


def _metric_sql(ks: tuple[int, ...] = metrics.KS) -> str:
    cols, gains, right = [], [], []
    for k in ks:
        cols.append(f"round(count(rank) FILTER (rank <= {k}) / count(*), 6) AS recall_{k}")
        cols.append(f"round(coalesce(any_value(right_{k}) / least({k}, any_value(listed)), 0), 6) AS precision_{k}")
        cols.append(f"CASE WHEN count(rank) FILTER (rank <= {k}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_{k}")
        cols.append(f"round(coalesce(any_value(dcg_{k}), 0) / list_sum(list_transform(generate_series(1, least({k}, count(*))), lambda i: 1 / log2(i + 1))), 6) AS ndcg_{k}")
        gains.append(f"sum(1 / log2(rank + 1)) FILTER (rank <= {k}) AS dcg_{k}")
        right.append(f"count(DISTINCT rank) FILTER (rank <= {k}) AS right_{k}")
    return f"""SELECT item_id, {", ".join(cols)}, round(coalesce(1 / min(rank), 0), 6) AS mrr FROM (SELECT tn.item_id, target, min(rank) AS rank FROM tn LEFT JOIN mt USING (item_id, target) GROUP BY ALL) ft
LEFT JOIN (SELECT item_id, {", ".join(gains)} FROM (SELECT DISTINCT item_id, min(rank) AS rank FROM mt GROUP BY item_id, target) GROUP BY ALL) USING (item_id) LEFT JOIN (SELECT item_id, {", ".join(right)} FROM mt GROUP BY ALL) USING (item_id)
LEFT JOIN (SELECT item_id, max(rank) AS listed FROM rk GROUP BY ALL) USING (item_id) GROUP BY item_id"""


METRICS_SQL = f"WITH {SQL_MET} {_metric_sql()}"


def metric_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Averages of each metric by the language that most of an item's targets have, a missing group shown as a dash."""
    langs = _targets(spark, d).join(table(spark, d, "documents").select("doc_id", F.when(F.col("lang") != "es", F.col("lang")).alias("lang")), "doc_id")
    langs = langs.groupBy("item_id").agg(F.max("lang").alias("lang"))
    rows = metrics.long_form(retrieval_metrics(spark, d), "item_id").join(langs, "item_id")
    return rows.groupBy(F.coalesce("lang", F.lit("—")).alias("scope"), "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


BREAKDOWN_SQL = f"""WITH m AS ({METRICS_SQL}), u AS (SELECT item_id, metric, value FROM (UNPIVOT m ON COLUMNS(* EXCLUDE item_id) INTO NAME metric VALUE value)),
l AS (SELECT item_id, max(nullif(lang, 'es')) AS lang FROM ({texts.SHINGLE_SQL}) JOIN documents USING (doc_id) WHERE covered GROUP BY ALL)
SELECT coalesce(lang, '—') AS scope, metric, count(*) AS n, round(avg(value), 6) AS mean FROM u JOIN l USING (item_id) GROUP BY ALL"""


def worst_questions(spark: SparkSession, d: str) -> DataFrame:
    return retrieval_metrics(spark, d).orderBy("recall_10", "mrr", "item_id").limit(5).select("item_id", "recall_10", "mrr")


WORST_SQL = f"SELECT item_id, recall_10, mrr FROM ({METRICS_SQL}) ORDER BY recall_10, mrr, item_id LIMIT 5"


def metric_gate(spark: SparkSession, d: str) -> DataFrame:
    """Score against threshold for every item: no targets pass with 1, a missing ranking fails."""
    items = table(spark, d, "benchmark").select("item_id", F.when(F.length("text") > 90, F.concat(F.left("text", F.lit(87)), F.lit("…"))).otherwise(F.col("text")).alias("description"))
    m = items.join(retrieval_metrics(spark, d).select("item_id", "ndcg_5"), "item_id", "left")
    score = F.coalesce("ndcg_5", F.lit(1.0))
    return m.select("item_id", "description", score.alias("score"), (score >= 0.5).alias("passed"), F.col("ndcg_5").isNotNull().alias("has_targets"))


GATE_SQL = f"""SELECT item_id, CASE WHEN length(text) > 90 THEN left(text, 87) || '…' ELSE text END AS description, coalesce(ndcg_5, 1.0) AS score, coalesce(ndcg_5, 1.0) >= 0.5 AS passed, ndcg_5 IS NOT NULL AS has_targets
FROM benchmark LEFT JOIN ({METRICS_SQL}) USING (item_id)"""


def _funnel(spark: SparkSession, d: str, pool: DataFrame) -> DataFrame:
    t, items = _targets(spark, d), table(spark, d, "benchmark").select("item_id")
    best = t.join(pool.select("item_id", "doc_id", "rank"), ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.min("rank").alias("best"), F.lit(True).alias("has"))
    cause = F.when(F.col("has").isNull(), "corpus").when(F.col("best").isNull(), "search").when(F.col("best") > 3, "rerank").otherwise("found")
    return items.join(best, "item_id", "left").select("item_id", cause.alias("cause"))


def loss_funnel(spark: SparkSession, d: str) -> DataFrame:
    """For every item, where its targets were lost: no target at all, not in the pool, not in the top, or found."""
    return _funnel(spark, d, R._lexical_hits(spark, d, R.POOL))


FUNNEL_SQL = f"""WITH {SQL_RANKED}, x AS (SELECT item_id, min(rank) AS rank, true AS has FROM tg LEFT JOIN pool USING (item_id, doc_id) GROUP BY ALL)
SELECT item_id, CASE WHEN has IS NULL THEN 'corpus' WHEN rank IS NULL THEN 'search' WHEN rank > 3 THEN 'rerank' ELSE 'found' END AS cause FROM benchmark LEFT JOIN x USING (item_id)"""


def eval_row(spark: SparkSession, d: str) -> DataFrame:
    """One wide row per item: metrics, cause, best hit and text size. The pool, a few rows an item, is written once and read by all of them."""
    pool = stored(R._lexical_hits(spark, d, R.POOL), scratch(spark, "pool"))
    best = pool.filter("rank = 1").select("item_id", F.col("doc_id").alias("best_doc"), F.col("score").alias("best_score"))
    top = pool.filter(F.col("rank") <= R.TOP).select("item_id", "rank", "doc_id", "score")
    m = _metrics(spark, d, top).select("item_id", "recall_5", "mrr")
    items = table(spark, d, "benchmark").select("item_id", F.length("text").alias("n_chars"))
    return items.join(best, "item_id", "left").join(m, "item_id", "left").join(_funnel(spark, d, pool), "item_id", "left")


EVAL_SQL = f"""SELECT b.item_id, length(b.text)::INT AS n_chars, h.doc_id AS best_doc, h.score AS best_score, m.recall_5, m.mrr, f.cause FROM benchmark b
LEFT JOIN (SELECT * FROM ({R.BM25_SQL}) WHERE rank = 1) h USING (item_id) LEFT JOIN ({METRICS_SQL}) m USING (item_id) LEFT JOIN ({FUNNEL_SQL}) f USING (item_id)"""


def refusal_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Labels as answers (quality: answerable, toxic: refused), over all and by language."""
    rows = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 1).alias("refused")).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.refusals(rows.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("lang")))), "scope")


REFUSAL_SQL = """WITH r AS (SELECT quality = 1 AS a, toxic = 1 AS f, unnest(['all', lang]) AS scope FROM labels JOIN documents USING (doc_id)),
c AS (SELECT scope, count(*) AS n, count(*) FILTER (NOT a AND f) AS hit, count(*) FILTER (NOT a AND NOT f) AS missed, count(*) FILTER (a AND f) AS wrong, count(*) FILTER (a) AS na FROM r GROUP BY ALL)
SELECT scope, round((n - missed - wrong) / n, 6) AS accuracy, round(hit / nullif(hit + wrong, 0), 6) AS precision, round(hit / nullif(hit + missed, 0), 6) AS recall, round(wrong / nullif(na, 0), 6) AS false_refusal_rate, round(missed / nullif(n - na, 0), 6) AS hallucination_rate FROM c"""


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return reports.percentiles(table(spark, d, "events"), "value", "event_type")


LATENCY_SQL = """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY ALL"""

#: Prices per million tokens (model or its ending, input, output).
PRICES = (("click", 1.0, 3.0), ("view", 0.5, 1.5), ("urchase", 2.0, 8.0))


def _usage(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls: the type is the model, the payload's k the tokens in, the value the tokens out; every tenth k is a cache hit without cost."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("model"), k.alias("tokens_in"), F.floor("value").cast("long").alias("tokens_out"), (k % 10 == 0).alias("cached"))
    p = F.broadcast(spark.createDataFrame(PRICES, "name string, price_in double, price_out double"))  # a fixed list
    exact = e.join(p, e["model"] == p["name"], "left").drop("name")
    loose = p.select("name", F.col("price_in").alias("in2"), F.col("price_out").alias("out2"))
    both = exact.join(loose, exact["price_in"].isNull() & F.endswith(exact["model"], loose["name"]), "left")
    price = lambda a, b: F.coalesce(a, b, F.lit(0.0))
    cost = (F.col("tokens_in") * price("price_in", "in2") + F.col("tokens_out") * price("price_out", "out2"))  # in millionths, so sums are exact
    return both.select("event_id", "user_id", "model", "tokens_in", "tokens_out", "cached", F.when(F.col("cached"), 0.0).otherwise(cost).alias("cost"))


_prices = ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in PRICES)
SQL_USAGE = f"""pr AS (SELECT * FROM (VALUES {_prices}) AS v(name, pin, pout)),
us AS (SELECT event_id, user_id, event_type AS model, (props->>'$.k')::BIGINT AS tokens_in, floor(value)::BIGINT AS tokens_out, (props->>'$.k')::BIGINT % 10 = 0 AS cached,
  CASE WHEN (props->>'$.k')::BIGINT % 10 = 0 THEN 0 ELSE ((props->>'$.k')::BIGINT * coalesce(a.pin, b.pin, 0) + floor(value) * coalesce(a.pout, b.pout, 0)) END AS cost
  FROM events LEFT JOIN pr a ON event_type = a.name LEFT JOIN pr b ON a.name IS NULL AND ends_with(event_type, b.name))"""


def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Calls, tokens and cost by model and over all, and what a thousand calls cost."""
    u = _usage(spark, d).rollup("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost") / 1e6, 7).alias("cost"))
    return u.select(F.coalesce("model", F.lit("(all)")).alias("model"), "calls", "tokens_in", "tokens_out", "cost", F.round(F.col("cost") / F.col("calls") * 1000, 6).alias("per_thousand"))


COST_SQL = f"""WITH {SQL_USAGE}, r AS (SELECT coalesce(model, '(all)') AS model, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost) / 1e6, 7) AS cost FROM us GROUP BY ROLLUP (model))
SELECT *, round(cost / calls * 1000, 6) AS per_thousand FROM r"""


def cost_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A parseable cost in the payload wins over the price table; hits of the cache cost nothing."""
    u = _usage(spark, d)
    header = F.when(F.col("tokens_in") % 7 == 0, (F.col("tokens_in") * 1000).cast("string")).otherwise("n/a")
    cost = F.when(F.col("cached"), 0.0).otherwise(F.coalesce(F.expr("try_cast(header AS double)"), F.col("cost")))
    return u.withColumn("header", header).groupBy("user_id").agg(F.round(F.sum(cost) / 1e6, 7).alias("cost"), F.count_if("cached").alias("hits"), F.count_if(~F.col("cached")).alias("misses"))


FALLBACK_SQL = f"""WITH {SQL_USAGE} SELECT user_id, round(sum(CASE WHEN cached THEN 0 WHEN tokens_in % 7 = 0 THEN tokens_in * 1000 ELSE cost END) / 1e6, 7) AS cost, count(*) FILTER (cached) AS hits, count(*) FILTER (NOT cached) AS misses FROM us GROUP BY user_id"""


def path_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Paths of a user's day, the five commonest."""
    e = table(spark, d, "events").select(F.concat_ws("/", "user_id", F.to_date("ts")).alias("turn"), "event_id", "event_type")
    return metrics.paths(e, "turn", "event_id", "event_type").orderBy(F.desc("n"), "path").limit(5)


PATH_SQL = """SELECT path, count(*) AS n FROM (SELECT string_agg(event_type, ' → ' ORDER BY event_id) AS path FROM events GROUP BY user_id, ts::DATE) GROUP BY path ORDER BY n DESC, path LIMIT 5"""


def trace_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Events as node traces of a user: the duration of a node is the time to the next, in milliseconds."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = F.expr("timestampdiff(MILLISECOND, ts, next)")
    e = table(spark, d, "events").withColumn("next", F.lead("ts").over(w)).select(F.col("event_type").alias("node"), ms.cast("double").alias("ms"))
    return reports.percentiles(e, "ms", "node").select("node", "n", "mean", "p95")


TRACE_SQL = """WITH e AS (SELECT event_type AS node, date_sub('millisecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))::DOUBLE AS ms FROM events)
SELECT node, count(ms) AS n, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.95), 6) AS p95 FROM e GROUP BY node"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn with the assistant turn right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("next", F.lead(F.struct("role", "text")).over(w))
    c = c.filter("role = 'user' AND next.role = 'assistant'")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("pair"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"), F.coalesce("next.text", F.lit("")).alias("answer"))


SQL_PAIRS = """pa AS (SELECT conv_id || '-' || turn AS pair, conv_id, turn, coalesce(text, '') AS question, coalesce(nt, '') AS answer FROM
  (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"""


def _sql_overlap(text: str) -> str:
    for cut in features.OVERLAP_CUTS:
        text = f"regexp_replace({text}, '{cut.replace(QUOTE, QUOTE + QUOTE)}', ' ', 'g')"
    return f"list_filter(regexp_extract_all({SQL_FOLD.format(text)}, '{features.OVERLAP_WORD}'), lambda w: w NOT IN ({', '.join(map(repr, features.STOP))}))"


QUOTE = "'"
SQL_PAIR_TOKENS = f"pt AS (SELECT pair, {_sql_overlap('question')} AS q, {_sql_overlap('answer')} AS a FROM pa)"


def _words(c: str):
    return features.overlap_words(F.col(c))


def token_f1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.token_f1(_answers(spark, d), "pair", _words("answer"), _words("question"))


F1_SQL = f"""WITH {SQL_PAIRS}, {SQL_PAIR_TOKENS},
x AS (SELECT pair, w, count(*) AS n FROM (SELECT pair, unnest(a) AS w FROM pt) GROUP BY ALL), y AS (SELECT pair, w, count(*) AS n FROM (SELECT pair, unnest(q) AS w FROM pt) GROUP BY ALL),
s AS (SELECT pair, sum(least(x.n, y.n)) AS s FROM x JOIN y USING (pair, w) GROUP BY ALL)
SELECT pair, CASE WHEN len(a) = 0 OR len(q) = 0 THEN NULL WHEN s IS NULL THEN 0 ELSE round(2 * (s / len(a)) * (s / len(q)) / (s / len(a) + s / len(q)), 6) END AS token_f1 FROM pt LEFT JOIN s USING (pair)"""


def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rouge_l(_answers(spark, d), "pair", _words("answer"), _words("question"))


def keyword_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Key terms of the question, in which capitalised words are set in bold and figures in code, that the answer contains."""
    marked = F.regexp_replace(F.regexp_replace("question", r"([A-Z][a-z]{2,})", "**$1**"), r"([0-9]{3,})", "`$1`")
    a = _answers(spark, d).select("pair", "answer", F.transform(features.key_terms(marked), lambda x: T.fold(x)).alias("terms"))
    return a.select("pair", F.size("terms").alias("n_terms"), metrics.keyword_coverage(T.fold(F.col("answer")), F.col("terms")).alias("coverage"))


_labels = ", ".join(f"'{x}'" for x in features.LABELS)
KEYWORD_SQL = rf"""WITH {SQL_PAIRS}, m AS (SELECT pair, answer, regexp_replace(regexp_replace(question, '([A-Z][a-z]{{2,}})', '**\1**', 'g'), '([0-9]{{3,}})', '`\1`', 'g') AS q FROM pa),
k AS (SELECT pair, {SQL_FOLD.format("answer")} AS a, list_distinct(list_filter(list_transform(regexp_extract_all(q, '{features.MARKED}'), lambda x: {SQL_FOLD.format(f"regexp_replace(x, '{features.EDGES}', '', 'g')")}), lambda x: length(x) >= 3 AND x NOT IN ({_labels}))) AS t FROM m)
SELECT pair, len(t)::INT AS n_terms, round(len(list_filter(t, lambda x: contains(a, x))) / nullif(len(t), 0), 6) AS coverage FROM k"""


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Answers with marks [S1] to [S9] put in by rule; cited are the marks of existing sources (three), in order, once each."""
    n = F.length("answer") % 4
    text = F.concat("answer", F.lit(" [S"), n.cast("string"), F.lit("] [S2] [S7] [S"), n.cast("string"), F.lit("]"))
    all_ = F.transform(F.regexp_extract_all(text, F.lit(r"\[S(\d+)\]"), F.lit(1)), lambda x: F.concat(F.lit("S"), x))
    valid = F.array(F.lit("S1"), F.lit("S2"), F.lit("S3"))
    cited = F.array_distinct(F.filter(all_, lambda x: F.array_contains(valid, x)))
    return _answers(spark, d).select("pair", F.array_join(cited, ",").alias("cited"), F.round(F.size(F.filter(all_, lambda x: F.array_contains(valid, x))) / F.size(all_), 6).alias("precision"))


CITATION_SQL = rf"""WITH {SQL_PAIRS}, c AS (SELECT pair, list_transform(regexp_extract_all(answer || ' [S' || length(answer) % 4 || '] [S2] [S7] [S' || length(answer) % 4 || ']', '\[S(\d+)\]', 1), lambda x: 'S' || x) AS c FROM pa),
v AS (SELECT pair, c, list_filter(c, lambda x: x IN ('S1', 'S2', 'S3')) AS v FROM c)
SELECT pair, array_to_string(list_transform(list_sort(list_transform(list_distinct(v), lambda x: {{'p': list_position(v, x), 'x': x}})), lambda s: s.x), ',') AS cited, round(len(v) / len(c), 6) AS precision FROM v"""


def answer_status(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of an answer: a short refusal, else ungrounded without a citation, else answered. Refusals and citations are put in by rule; the answer travels as JSON inside a fence."""
    sentence = "Je ne sais pas."
    n = F.length("answer")
    said = F.when(n % 5 == 0, sentence).when(n % 5 == 1, F.concat("answer", F.lit(" [S1]"))).otherwise(F.col("answer"))
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct(said.alias("answer"))), F.lit("\n```"))
    answer = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "answer string")["answer"]
    status = F.when(answer.contains(sentence) & (F.length(answer) <= len(sentence) + 60), "refused").when(~answer.rlike(r"\[S\d+\]"), "ungrounded").otherwise("answered")
    return _answers(spark, d).select("pair", status.alias("status"), F.length(answer).alias("n_chars"))


STATUS_SQL = f"""WITH {SQL_PAIRS} SELECT pair, CASE length(answer) % 5 WHEN 0 THEN 'refused' WHEN 1 THEN 'answered' ELSE 'ungrounded' END AS status,
(CASE length(answer) % 5 WHEN 0 THEN 15 WHEN 1 THEN length(answer) + 5 ELSE length(answer) END)::INT AS n_chars FROM pa"""


def run_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a run in one table: events by type, documents by language with characters, labels by verdict."""
    n = F.count(F.lit(1)).alias("n")
    e = table(spark, d, "events").groupBy(F.lit("event").alias("kind"), F.col("event_type").alias("name")).agg(n, F.round(F.sum("value"), 4).alias("total"))
    c = table(spark, d, "documents").groupBy(F.lit("language").alias("kind"), F.col("lang").alias("name")).agg(n, F.sum(F.length("text")).cast("double").alias("total"))
    v = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "contradiction").otherwise("correct")).otherwise("incorrect")
    lab = table(spark, d, "labels").groupBy(F.lit("verdict").alias("kind"), v.alias("name")).agg(n, F.sum("toxic").cast("double").alias("total"))
    return e.unionByName(c).unionByName(lab)


REPORT_SQL = """SELECT 'event' AS kind, event_type AS name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL UNION ALL
SELECT 'language', lang, count(*), sum(length(text))::DOUBLE FROM documents GROUP BY ALL UNION ALL
SELECT 'verdict', CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'contradiction' ELSE 'correct' END ELSE 'incorrect' END, count(*), sum(toxic)::DOUBLE FROM labels GROUP BY ALL"""


def throughput_and_causes(spark: SparkSession, d: str) -> DataFrame:
    """By event type: calls per minute of the wall time between first and last event, share of zero values as errors, and the profiling cost estimate."""
    wall = F.expr("timestampdiff(SECOND, min(ts), max(ts))") / 60
    k = F.get_json_object("props", "$.k").cast("long")
    out = table(spark, d, "events").groupBy("event_type").agg(F.round(F.try_divide(F.count(F.lit(1)), wall), 6).alias("per_minute"), F.count_if(F.col("value") < 1).alias("errors"), F.floor(F.sum(F.least(k, F.lit(24000))) / 3.6 + 1200 * F.count(F.lit(1))).cast("long").alias("tokens"))
    return out


THROUGHPUT_SQL = """SELECT event_type, round(count(*) / (date_sub('second', min(ts), max(ts)) / 60), 6) AS per_minute, count(*) FILTER (value < 1) AS errors,
floor(sum(least((props->>'$.k')::BIGINT, 24000)) / 3.6::DOUBLE + 1200 * count(*))::BIGINT AS tokens FROM events GROUP BY ALL"""

def cause_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How often each cause of a lost target occurs, and its share of all items, commonest first."""
    c = loss_funnel(spark, d).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))
    n = table(spark, d, "benchmark").agg(F.count(F.lit(1)).alias("of"))
    return c.crossJoin(F.broadcast(n)).select("cause", "n", F.round(F.col("n") / F.col("of"), 6).alias("share"))  # one row


HISTOGRAM_SQL = f"SELECT cause, count(*) AS n, round(count(*) / (SELECT count(*) FROM benchmark), 6) AS share FROM ({FUNNEL_SQL}) GROUP BY cause"


def generation_means(spark: SparkSession, d: str) -> DataFrame:
    """Means over answered questions, by the language heuristic of the question: lexical F1, key words covered, French answers, answers over a line long."""
    a = _answers(spark, d).select("pair", features.is_french(F.col("question")).alias("french"), features.is_french(F.col("answer")).cast("int").alias("fr"), F.col("answer").contains("\n").cast("int").alias("lines"))
    x = a.join(token_f1(spark, d), "pair", "left").join(keyword_coverage(spark, d), "pair", "left")
    mean = lambda c: F.round(F.avg(c), 6)
    return x.groupBy("french").agg(F.count(F.lit(1)).alias("n"), mean("token_f1").alias("token_f1"), mean("coverage").alias("coverage"), mean("fr").alias("french_rate"), mean("lines").alias("lines_rate"))


def _sql_french(c: str) -> str:
    words = f"regexp_extract_all(lower(regexp_replace({c}, '(?s)```.*?```', ' ', 'g')), '{features.LETTERS}')"
    return " >= ".join(f"len(list_filter({words}, lambda w: w IN ({', '.join(map(repr, of))})))" for of in (features.FRENCH, features.ENGLISH))


MEANS_SQL = f"""WITH {SQL_PAIRS}, x AS (SELECT pair, {_sql_french("question")} AS french, ({_sql_french("answer")})::INT AS fr, contains(answer, chr(10))::INT AS lines FROM pa)
SELECT french, count(*) AS n, round(avg(token_f1), 6) AS token_f1, round(avg(coverage), 6) AS coverage, round(avg(fr), 6) AS french_rate, round(avg(lines), 6) AS lines_rate
FROM x LEFT JOIN ({F1_SQL}) USING (pair) LEFT JOIN ({KEYWORD_SQL}) USING (pair) GROUP BY french"""

QUERIES = {
    "cause_histogram": (cause_histogram, HISTOGRAM_SQL),
    "generation_means": (generation_means, MEANS_SQL),
    "retrieval_metrics": (retrieval_metrics, METRICS_SQL),
    "metric_breakdown": (metric_breakdown, BREAKDOWN_SQL),
    "worst_questions": (worst_questions, WORST_SQL),
    "metric_gate": (metric_gate, GATE_SQL),
    "loss_funnel": (loss_funnel, FUNNEL_SQL),
    "eval_row": (eval_row, EVAL_SQL),
    "refusal_confusion": (refusal_confusion, REFUSAL_SQL),
    "latency_percentiles": (latency_percentiles, LATENCY_SQL),
    "cost_rollup": (cost_rollup, COST_SQL),
    "cost_fallback": (cost_fallback, FALLBACK_SQL),
    "path_frequency": (path_frequency, PATH_SQL),
    "trace_rollup": (trace_rollup, TRACE_SQL),
    "token_f1": (token_f1, F1_SQL),
    "rouge_l": (rouge_l, None),
    "keyword_coverage": (keyword_coverage, KEYWORD_SQL),
    "citations": (citations, CITATION_SQL),
    "answer_status": (answer_status, STATUS_SQL),
    "run_report": (run_report, REPORT_SQL),
    "throughput_and_causes": (throughput_and_causes, THROUGHPUT_SQL),
}
