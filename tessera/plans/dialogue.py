"""Queries on conversations and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dialogue, lexical
from . import retrieval as R
from .common import SQL_FOLD, SQL_TOKENS, table
from .evaluation import SQL_PAIRS, _answers


def history_window(spark: SparkSession, d: str) -> DataFrame:
    h = dialogue.history(table(spark, d, "conversations"), "conv_id", "turn", 4)
    return h.select("conv_id", "turn", F.md5("history").alias("history_md5"), F.length("history").alias("n_chars"))


HISTORY_SQL = """WITH h AS (SELECT conv_id, turn, array_to_string(list(role || ': ' || left(coalesce(text, ''), 1500)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), chr(10)) AS h FROM conversations)
SELECT conv_id, turn, md5(h) AS history_md5, length(h)::INT AS n_chars FROM h"""


#: The words of the example search.
SEARCHED = ("TION", "á", "Ré")


def history_search(spark: SparkSession, d: str) -> DataFrame:
    """First turn of each conversation that holds all words, case and accents aside, with what stands around the first of them; questions come before answers."""
    c = dialogue.search(table(spark, d, "conversations"), "text", SEARCHED)
    c = c.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy((F.col("role") != "user").cast("int"), "turn"))).filter("i = 1")
    return c.select("conv_id", "turn", "role", F.substring("text", F.greatest(F.lit(1), F.col("at") - 40), F.lit(124)).alias("snippet"))


SEARCH_SQL = f"""SELECT conv_id, turn, role, substr(text, greatest(1, at_ - 40), 124) AS snippet FROM (SELECT *, instr({SQL_FOLD.format("text")}, 'tion') AS at_ FROM conversations) WHERE at_ > 0 AND contains({SQL_FOLD.format("text")}, 're')
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY (role <> 'user')::INT, turn) = 1"""


def question_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("conv_id", "turn", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


PAIRS_SQL = f"WITH {SQL_PAIRS} SELECT conv_id, turn, md5(question) AS question_md5, md5(answer) AS answer_md5 FROM pa"


def time_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Users by their last event against the day of the last event of all."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    today = last.agg(F.to_date(F.max("last")).alias("today"))
    age = F.date_diff("today", F.to_date("last"))
    b = F.when(age == 0, "today").when(age == 1, "yesterday").when(age <= 7, "7 days").when(age <= 30, "30 days").otherwise("older")
    return last.crossJoin(F.broadcast(today)).select("user_id", b.alias("bucket"))  # today is one row


BUCKETS_SQL = """WITH l AS (SELECT user_id, max(ts)::DATE AS d FROM events GROUP BY ALL), a AS (SELECT user_id, date_diff('day', d, (SELECT max(d) FROM l)) AS age FROM l)
SELECT user_id, CASE WHEN age = 0 THEN 'today' WHEN age = 1 THEN 'yesterday' WHEN age <= 7 THEN '7 days' WHEN age <= 30 THEN '30 days' ELSE 'older' END AS bucket FROM a"""


def event_fold(spark: SparkSession, d: str) -> DataFrame:
    """Events as steps: by id they start or end the node named by their type, or are a token."""
    kind = F.concat_ws(":", "event_type", F.element_at(F.array(F.lit("start"), F.lit("end"), F.lit("token")), (F.col("event_id") % 3 + 1).cast("int")))
    e = table(spark, d, "events").select("user_id", "event_id", kind.alias("kind"))
    return dialogue.fold_events(e, "user_id", "event_id", "kind")


FOLD_SQL = """WITH e AS (SELECT user_id, event_type AS name, event_id % 3 AS k, sum(CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS depth, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS x FROM events),
n AS (SELECT user_id, name, sum(x) AS net, least(min(depth), 0) AS un, count(*) FILTER (k = 1) AS ends, count(*) FILTER (k = 2) AS tokens FROM e GROUP BY ALL)
SELECT user_id, sum(net - un)::BIGINT AS running, sum(ends + un)::BIGINT AS done, sum(tokens)::BIGINT AS tokens FROM n GROUP BY user_id"""


def turn_reducer(spark: SparkSession, d: str) -> DataFrame:
    """Event types as a per-turn list of each user that an error resets."""
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", dialogue.RESET).otherwise(F.col("event_type")).alias("item"))
    return dialogue.reduce_turns(e, "user_id", "event_id", "item")


REDUCER_SQL = """WITH l AS (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS last FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS items, count(*) AS n FROM events JOIN l USING (user_id) WHERE event_id > coalesce(last, -1) GROUP BY user_id"""


def summary_trigger(spark: SparkSession, d: str) -> DataFrame:
    """Turns at which a conversation is summarised: more than 4 messages and a multiple of 3; all but the last 2 go in."""
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    c = table(spark, d, "conversations").withColumn("n", n)
    return c.filter("n > 4 AND n % 3 = 0").select("conv_id", "turn", "n", (F.col("n") - 2).alias("summarised"))


TRIGGER_SQL = """SELECT conv_id, turn, count(*) OVER w AS n, count(*) OVER w - 2 AS summarised FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) QUALIFY n > 4 AND n % 3 = 0"""


def query_variants(spark: SparkSession, d: str) -> DataFrame:
    """Requests of each item: the text, its folded form and its first three sentences, trimmed, distinct, in order, and one request per corpus with its own size."""
    sub = F.slice(F.filter(F.transform(F.split("text", r"[.!?]"), lambda x: F.trim(x)), lambda x: x != ""), 1, 3)
    v = F.array_distinct(F.filter(F.transform(F.concat(F.array("text", T.fold(F.col("text"))), sub), lambda x: F.trim(x)), lambda x: x != ""))
    q = table(spark, d, "benchmark").select("item_id", F.posexplode(v).alias("at", "query"))
    general = q.select("item_id", "at", F.lit("general").alias("scope"), F.lit(10).alias("top_k"), F.md5("query").alias("query_md5"))
    focused = q.filter("at = 0").withColumn("scope", F.explode(F.array(F.lit("api"), F.lit("help")))).select("item_id", "at", "scope", F.greatest(F.lit(8), F.lit(10 // 2)).alias("top_k"), F.md5("query").alias("query_md5"))
    return general.unionByName(focused)


VARIANTS_SQL = rf"""WITH s AS (SELECT item_id, text, list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda x: trim(x)), lambda x: x <> '')[1:3] AS sub FROM benchmark),
v AS (SELECT item_id, list_filter(list_transform([text, {SQL_FOLD.format("text")}] || sub, lambda x: trim(x)), lambda x: x <> '') AS v FROM s),
o AS (SELECT item_id, list_transform(list_sort(list_transform(list_distinct(v), lambda x: {{'i': list_position(v, x), 'x': x}})), lambda s: s.x) AS o FROM v),
q AS (SELECT item_id, generate_subscripts(o, 1) - 1 AS k, unnest(o) AS query FROM o)
SELECT item_id, k::INT AS "at", 'general' AS scope, 10 AS top_k, md5(query) AS query_md5 FROM q UNION ALL SELECT item_id, k::INT, unnest(['api', 'help']), 8, md5(query) FROM q WHERE k = 0"""


def corrective_loop(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items in at most three passes over all documents. The grade is the best share of an item's words that one document has; a rewrite drops the last third of the words."""
    index = R._index(spark, d)
    ask = table(spark, d, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("words"))

    def search(open_: DataFrame, i: int) -> DataFrame:
        hit = lexical.overlap(index, open_.select("item_id", F.explode("words").alias("term")), "item_id", 1).groupBy("item_id").agg(F.max("score").cast("long").alias("n"))
        return open_.join(hit, "item_id", "left").withColumn("share", F.round(F.coalesce("n", F.lit(0)) / F.size("words"), 6)).drop("n")

    def rewrite(left: DataFrame, i: int) -> DataFrame:
        return left.withColumn("words", F.slice("words", F.lit(1), F.ceil(F.size("words") * 2 / 3).cast("int")))

    out = dialogue.corrective_loop(ask, search, F.col("share") >= GRADE, rewrite)
    return out.select("item_id", "attempts", "sufficient", "share", F.size("words").alias("n_words"))


#: The share of words that counts as sufficient.
GRADE = 0.95


def _loop_sql() -> str:
    first = f"list_transform(list_sort(list_transform(list_distinct(w), lambda x: {{'i': list_position(w, x), 'x': x}})), lambda s: s.x)"
    ctes = [f"dw AS (SELECT DISTINCT doc_id, unnest({SQL_TOKENS.format('text')}) AS w FROM documents)", f"r0 AS (SELECT item_id, {first} AS words FROM (SELECT item_id, {SQL_TOKENS.format('text')} AS w FROM benchmark))"]
    for i in range(3):
        ctes.append(f"s{i} AS (SELECT item_id, max(n) AS n FROM (SELECT item_id, doc_id, count(*) AS n FROM (SELECT item_id, unnest(words) AS w FROM r{i}) JOIN dw USING (w) GROUP BY ALL) GROUP BY ALL)")
        ctes.append(f"f{i} AS (SELECT item_id, words, {i + 1} AS attempts, round(coalesce(n, 0) / len(words), 6) AS share FROM r{i} LEFT JOIN s{i} USING (item_id))")
        ctes.append(f"r{i + 1} AS (SELECT item_id, words[1:ceil(len(words) * 2 / 3)::INT] AS words FROM f{i} WHERE share < {GRADE})")
    last = f"SELECT item_id, attempts, share >= {GRADE} AS sufficient, share, len(words)::INT AS n_words FROM "
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join([f"{last} f0 WHERE share >= {GRADE}", f"{last} f1 WHERE share >= {GRADE}", f"{last} f2"])


def final_projection(spark: SparkSession, d: str) -> DataFrame:
    """Turn log of a user: last turn, summed cost, distinct steps, and durations as text."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_step"), F.round(F.sum("value"), 4).alias("cost"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("steps"), F.max("event_id").alias("last_id"))
    ms = F.col("last_id") % 5000
    return e.select("user_id", "last_step", "cost", "steps", F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).otherwise(F.concat(F.round(ms / 1000, 1).cast("string"), F.lit(" s"))).alias("duration"))


FINAL_SQL = """SELECT user_id, arg_max(event_type, event_id) AS last_step, round(sum(value), 4) AS cost, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS steps,
CASE WHEN max(event_id) % 5000 < 1000 THEN (max(event_id) % 5000) || ' ms' ELSE round((max(event_id) % 5000)::DOUBLE / 1000, 1) || ' s' END AS duration FROM events GROUP BY user_id"""


def sse_frames(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as numbered frames, each parsed as a row of its own: fields, comments left out, data over several lines."""
    data = F.to_json(F.struct("event_id", "event_type"))
    frame = F.concat(F.lit(": ping\nevent: "), "event_type", F.lit("\ndata: "), data, F.lit("\ndata: x"))
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    f = table(spark, d, "events").select("user_id", at.alias("at"), F.filter(F.split(frame, "\n"), lambda x: ~x.startswith(":")).alias("lines"))
    of = lambda name: F.transform(F.filter("lines", lambda x: x.startswith(name + ":")), lambda x: F.trim(F.substring(x, F.lit(len(name) + 2), F.length(x))))
    return f.select("user_id", "at", F.element_at(of("event"), 1).alias("event"), F.get_json_object(F.element_at(of("data"), 1), "$.event_id").cast("long").alias("event_id"), F.size(of("data")).alias("n_data"))


SSE_SQL = """SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS "at", event_type AS event, event_id, 2 AS n_data FROM events"""


def answer_outline(spark: SparkSession, d: str) -> DataFrame:
    """Hits of an item grouped by source in order of first appearance, with the languages as breadcrumb and whether the best three cite it."""
    h = R._found(spark, d, R.TOP).join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    g = h.groupBy("item_id", "source").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("lang")), " › ").alias("breadcrumb"), (F.min("rank") <= 3).alias("cited"))
    return g.withColumn("position", F.row_number().over(Window.partitionBy("item_id").orderBy("first"))).drop("first")


OUTLINE_SQL = f"""WITH {R.SQL_HITS}, g AS (SELECT item_id, source, min(rank) AS f, count(*) AS n, string_agg(DISTINCT lang, ' › ' ORDER BY lang) AS breadcrumb, min(rank) <= 3 AS cited FROM hits JOIN documents USING (doc_id) WHERE rank <= {R.TOP} GROUP BY ALL)
SELECT item_id, source, n, breadcrumb, cited, row_number() OVER (PARTITION BY item_id ORDER BY f) AS position FROM g"""


def api_cue_guard(spark: SparkSession, d: str) -> DataFrame:
    """Routing by cue words of a turn or of what came before it; without a cue the general route is taken. A question stands verbatim unless there is history."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    cue = F.lower(F.coalesce("text", F.lit(""))).rlike("(^|[^a-z])(endpoint|json|http|api|the ing)($|[^a-z])")
    c = table(spark, d, "conversations").withColumn("seen", F.max(cue).over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    return c.filter("role = 'user'").select("conv_id", "turn", F.when(F.col("seen"), "api").otherwise("general").alias("route"), F.when(F.col("n") > 1, "standalone").otherwise("verbatim").alias("question"))


CUE_SQL = """SELECT conv_id, turn, CASE WHEN seen THEN 'api' ELSE 'general' END AS route, CASE WHEN n > 1 THEN 'standalone' ELSE 'verbatim' END AS question FROM
(SELECT conv_id, turn, role, bool_or(regexp_matches(lower(coalesce(text, '')), '(^|[^a-z])(endpoint|json|http|api|the ing)($|[^a-z])')) OVER w AS seen, count(*) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE role = 'user'"""

QUERIES = {
    "history_window": (history_window, HISTORY_SQL),
    "history_search": (history_search, SEARCH_SQL),
    "question_pairs": (question_pairs, PAIRS_SQL),
    "time_buckets": (time_buckets, BUCKETS_SQL),
    "event_fold": (event_fold, FOLD_SQL),
    "turn_reducer": (turn_reducer, REDUCER_SQL),
    "summary_trigger": (summary_trigger, TRIGGER_SQL),
    "query_variants": (query_variants, VARIANTS_SQL),
    "corrective_loop": (corrective_loop, _loop_sql()),
    "final_projection": (final_projection, FINAL_SQL),
    "sse_frames": (sse_frames, SSE_SQL),
    "answer_outline": (answer_outline, OUTLINE_SQL),
    "api_cue_guard": (api_cue_guard, CUE_SQL),
}
