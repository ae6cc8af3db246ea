"""Queries on files of records: catalogues, vocabularies, business questions, payloads, and reports over many dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunking, context, markdown, payload, profiles, reports, vocabularies
from ..sources import catalogue, files
from . import retrieval as R
from . import structure as S
from . import texts as X
from .common import table


def _catalogues(spark: SparkSession, d: str) -> DataFrame:
    """A YAML file for each nation, with its suppliers as entries and their short names as a vocabulary, written and read back."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    s = table(spark, d, "supplier").join(n, "s_nationkey")
    part = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    whole = F.round("s_acctbal").cast("long")
    entry = part("  - key: ", F.col("s_suppkey"), '\n    name: "', F.col("s_name"), '"\n    balance: ', whole, "\n    limits: {low: 0, high: 9}\n", F.when(whole < 0, F.lit("    flag: true\n")).otherwise(F.lit("")))
    term = part('  "', F.col("s_name"), '": ["s', F.col("s_suppkey"), '", "', F.lower("s_name"), '"]\n')
    ordered = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", x.alias("t")))), lambda y: y["t"]), "")
    text = s.groupBy("n_name").agg(part('name: "', F.first("n_name"), '"\nsuppliers:\n', ordered(entry), "terms:\n", ordered(term)).alias("value"))
    at = files.scratch(spark, "catalogue")
    text.select("value").repartition(F.col("value")).write.option("maxRecordsPerFile", 1).mode("append").text(f"{at}/files")
    return catalogue.tree_files(spark, f"{at}/files", "part-*")


def catalogue_scan(spark: SparkSession, d: str) -> DataFrame:
    leaves = files.stored(_catalogues(spark, d), files.scratch(spark, "leaves") + "/rows")
    names = leaves.filter("keys = array('name')").select("file", F.col("value").alias("catalogue"))
    return catalogue.entries(leaves, "suppliers", ("key", "name", "balance", "flag")).join(names, "file").drop("file")


CATALOGUE_SQL = """SELECT n_name AS catalogue, (row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1)::INT AS entry, s_suppkey::VARCHAR AS key, s_name AS name, round(s_acctbal)::BIGINT::VARCHAR AS balance,
CASE WHEN round(s_acctbal) < 0 THEN 'true' END AS flag FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def vocabulary_scan(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.vocabulary(_catalogues(spark, d), "terms")


VOCABULARY_SQL = "SELECT s_name AS term, unnest([s_name, 's' || s_suppkey, lower(s_name)]) AS alias FROM supplier"


def business_questions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as a sheet of business questions with links, written and read back; every fifth is marked for review."""
    i = F.col("item_id")
    links = F.concat(F.lit("https://a.example/"), i, F.lit(" ; http://b.example/x, mail;"))
    reference = F.concat(F.lit("Voir **Menu "), i, F.lit("** : `champ_"), i, F.lit("` et **menu "), i, F.lit("**, **Note**\n"), F.col("text"))
    x = table(spark, d, "benchmark").select(F.concat(F.lit("p"), (i % 3).cast("string")).alias("produit"), F.when(i % 7 != 3, F.concat(F.lit("Question "), i.cast("string"))).otherwise(F.lit(" ")).alias("requete"), reference.alias("reponse_ideale"), links.alias("liens_possibles"), F.when(i % 2 == 0, "theme").otherwise(F.lit("")).alias("thematique"), i.alias("item"))
    at = files.scratch(spark, "business")
    files.write_export(x.orderBy("item").drop("item").coalesce(1), f"{at}/questions")
    q = catalogue.business_questions(spark, f"{at}/questions")
    files.write_export(q.filter("int(substr(id, 2)) % 5 = 0").select("id", F.lit("à relire").alias("raison")), f"{at}/flags")
    flags = catalogue.review_flags(spark, f"{at}/flags").unionByName(catalogue.review_flags(spark, f"{at}/missing"))
    out = q.join(flags, "id", "left")
    return out.select("id", "product", "question", F.array_join("links", " ").alias("links"), "theme", F.array_join("terms", "|").alias("terms"), F.md5("reference").alias("reference_md5"), "reason")


BUSINESS_SQL = """WITH q AS (SELECT *, row_number() OVER (ORDER BY item_id) AS n FROM benchmark WHERE item_id % 7 <> 3)
SELECT 't' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS id, 'p' || (item_id % 3) AS product, 'Question ' || item_id AS question, 'https://a.example/' || item_id || ' http://b.example/x' AS links,
CASE WHEN item_id % 2 = 0 THEN 'theme' END AS theme, 'Menu ' || item_id || '|champ_' || item_id AS terms,
md5('Voir **Menu ' || item_id || '** : `champ_' || item_id || '` et **menu ' || item_id || '**, **Note**' || chr(10) || text) AS reference_md5, CASE WHEN n % 5 = 0 THEN 'à relire' END AS reason FROM q"""


def payload_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Documents as nested payloads and back: what the text tells (features) overwrites what the catalogue says (metadata), if it tells anything."""
    docs = table(spark, d, "documents")
    n = F.regexp_count("text", F.lit("the"))
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]*tion"), F.lit(0)))
    x = docs.select("doc_id", F.to_json(F.struct(
        F.col("doc_id").alias("id"), F.concat(F.lit("v"), F.col("doc_id") % 3).alias("version"),
        F.struct(F.col("lang").alias("lang"), F.array("source").alias("products"), F.struct(F.col("source").alias("site"), F.lit(1).alias("rank")).alias("origin")).alias("metadata"),
        F.struct(F.slice(found, 1, 3).alias("products"), n.alias("count"), F.when(n > 3, F.lit("")).otherwise(F.lit("xx")).alias("lang")).alias("features"),
    )).alias("payload"))
    columns = {"language": ("lang", "string"), "products": ("products", "array<string>"), "n": ("count", "int")}
    flat = payload.flatten(x, "payload", columns, ("metadata", "features"))
    back = payload.nest(flat.select("doc_id", "language", "n", "rest"), "doc_id", {"language": "lang", "n": "count"}, "nested")
    flat = flat.join(back, "doc_id")
    rest = F.array_join(F.transform(F.array_sort(F.map_entries("rest")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    again = F.get_json_object("nested", "$.lang")
    return flat.select("doc_id", "language", F.array_join("products", ",").alias("products"), "n", rest.alias("rest"), (again.eqNullSafe(F.col("language")) & (F.get_json_object("nested", "$.version") == F.concat(F.lit("v"), F.col("doc_id") % 3))).alias("kept"))


PAYLOAD_SQL = """WITH t AS (SELECT *, len(regexp_extract_all(text, 'the')) AS n, regexp_extract_all(lower(text), '[a-z]*tion') AS f FROM documents),
u AS (SELECT *, list_transform(list_sort(list_transform(list_distinct(f), lambda x: {'p': list_position(f, x), 'x': x})), lambda s: s.x)[1:3] AS p FROM t)
SELECT doc_id, CASE WHEN n > 3 THEN lang ELSE 'xx' END AS language, CASE WHEN len(p) > 0 THEN array_to_string(p, ',') ELSE source END AS products, n::INT AS n,
'id=' || doc_id || ';metadata.origin={"rank":1,"site":"' || source || '"};version="v' || (doc_id % 3) || '"' AS rest, true AS kept FROM u"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as judged answers: language as theme, source as product, and a cost by length."""
    x = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") != "es", F.col("lang")).alias("theme"), F.col("source").alias("product"), F.length("text").alias("chars")).join(table(spark, d, "labels"), "doc_id")
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.when(F.col("chars") < 200, "partial").otherwise("correct")).when((F.col("quality") == 1) & (F.col("toxic") == 1), "contradiction").when(F.col("toxic") == 0, "incorrect")
    return x.withColumn("verdict", verdict).withColumn("cost", F.col("chars").cast("double"))


SQL_JUDGED = """jd AS (SELECT doc_id, nullif(lang, 'es') AS theme, source AS product, length(text) AS chars, quality, toxic, length(text)::DOUBLE AS cost,
CASE WHEN quality = 1 AND toxic = 0 THEN CASE WHEN length(text) < 200 THEN 'partial' ELSE 'correct' END WHEN quality = 1 AND toxic = 1 THEN 'contradiction' WHEN toxic = 0 THEN 'incorrect' END AS verdict FROM documents JOIN labels USING (doc_id))"""


def report_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Means of every metric by theme, product, verdict and over all; toxicity only where the quality is good."""
    x = _judged(spark, d).select("doc_id", "theme", "product", "verdict", "quality", F.when(F.col("quality") == 1, F.col("toxic")).alias("toxic"), "chars")
    return reports.breakdown(x, "doc_id", ["theme", "product", "verdict"], ["quality", "toxic", "chars"])


BREAKDOWN_SQL = f"""WITH {SQL_JUDGED}, s AS (SELECT coalesce(theme, '—') AS theme, coalesce(product, '—') AS product, coalesce(verdict, '—') AS verdict, quality::DOUBLE AS quality, CASE WHEN quality = 1 THEN toxic::DOUBLE END AS toxic, chars::DOUBLE AS chars FROM jd),
u AS (UNPIVOT s ON quality, toxic, chars INTO NAME metric VALUE x)
SELECT CASE WHEN theme IS NOT NULL THEN 'theme' WHEN product IS NOT NULL THEN 'product' WHEN verdict IS NOT NULL THEN 'verdict' ELSE 'all' END AS dimension, coalesce(theme, product, verdict, '') AS value, metric, count(*) AS n, round(avg(x), 6) AS mean
FROM u GROUP BY GROUPING SETS ((metric), (theme, metric), (product, metric), (verdict, metric))"""

VERDICTS = ("correct", "partial", "incorrect", "contradiction")


def verdict_rates(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of every product: shares, answers that got none, what an answer and what a correct answer cost."""
    v = F.col("verdict")
    x = _judged(spark, d).groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("unjudged"), *reports.rates(v, VERDICTS), F.sum("cost").alias("cost"), F.count_if(v == "correct").alias("right"))
    return x.select("product", "n", "unjudged", *(f"{k}_rate" for k in VERDICTS), reports.per_unit(F.col("cost"), F.col("n")).alias("per_answer"), reports.per_unit(F.col("cost"), F.col("right")).alias("per_correct"))


RATES_SQL = f"""WITH {SQL_JUDGED} SELECT product, count(*) AS n, count(*) FILTER (verdict IS NULL) AS unjudged, {", ".join(f"round(count(*) FILTER (verdict = '{v}') / nullif(count(verdict), 0), 6) AS {v}_rate" for v in VERDICTS)},
round(sum(cost) / count(*), 8) AS per_answer, round(sum(cost) / nullif(count(*) FILTER (verdict = 'correct'), 0), 8) AS per_correct FROM jd GROUP BY product"""


def vocabulary_text(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers of each nation as a described vocabulary."""
    x = table(spark, d, "supplier").select("s_nationkey", "s_name", F.concat(F.lit("balance "), F.round("s_acctbal").cast("long").cast("string")).alias("t"))
    return vocabularies.described(x, "s_name", "t", "s_nationkey")


DESCRIBED_SQL = "SELECT s_nationkey, string_agg('- ' || s_name || ' : balance ' || round(s_acctbal)::BIGINT, chr(10) ORDER BY s_name) AS lines FROM supplier GROUP BY s_nationkey"


def context_format(spark: SparkSession, d: str) -> DataFrame:
    """The three best documents of every item of even number, as a model is shown them; the others have none."""
    i, name = F.col("doc_id"), F.concat_ws(" > ", "source", "lang")
    kind = F.element_at(F.array(*map(F.lit, ("reference_api", "guide_fonctionnel", "fiche_partenaire_agregation", "guide_utilisateur", "note_interne", ""))), (i % 6 + 1).cast("int"))
    hits = R._found(spark, d, 3).filter("item_id % 2 = 0").join(table(spark, d, "documents"), "doc_id")
    text = context.extract(
        F.concat(F.lit("S"), "rank"), name, F.col("text"), F.when(i % 2 == 0, F.concat(F.lit("API "), "lang")), F.when(i % 4 == 0, "1.2"), kind, F.when(i % 3 == 0, i), F.when(i % 3 == 0, i + i % 2),
        F.when(i % 5 == 0, F.concat(F.lit("https://a.example/"), i)), F.when(i % 5 != 4, F.concat("source", F.lit(".md"))),
    )
    x = context.formatted(table(spark, d, "benchmark"), hits.select("item_id", "rank", text.alias("extract")), "item_id", "rank")
    return x.select("item_id", F.length("context").alias("n_chars"), F.md5("context").alias("context_md5"))


CONTEXT_SQL = rf"""WITH {R.SQL_HITS}, e AS (SELECT item_id, rank, doc_id AS i, text, source || ' > ' || lang AS name, ['référence technique', 'guide fonctionnel', 'fiche partenaire', 'aide en ligne', 'note interne', NULL][doc_id % 6 + 1] AS kind,
  CASE WHEN doc_id % 2 = 0 THEN 'API ' || lang || CASE WHEN doc_id % 4 = 0 THEN ' v1.2' ELSE '' END END AS api, CASE WHEN doc_id % 3 = 0 THEN 'p. ' || doc_id || CASE WHEN doc_id % 2 = 1 THEN '-' || (doc_id + 1) ELSE '' END END AS pages,
  CASE WHEN doc_id % 5 = 0 THEN 'lien : https://a.example/' || doc_id WHEN doc_id % 5 <> 4 THEN 'fichier : ' || source || '.md' END AS place FROM hits JOIN documents USING (doc_id) WHERE rank <= 3 AND item_id % 2 = 0),
t AS (SELECT item_id, rank, '<extrait id="S' || rank || '">' || chr(10) || '[S' || rank || '] Source : ' || name || CASE WHEN concat_ws(' ; ', api, kind, pages, place) <> '' THEN ' (' || concat_ws(' ; ', api, kind, pages, place) || ')' ELSE '' END
  || chr(10) || chr(10) || regexp_replace(text, '\A\s+|\s+\z', '', 'g') || chr(10) || '</extrait>' AS t FROM e),
c AS (SELECT item_id, string_agg(t, chr(10) || chr(10) ORDER BY rank) AS c FROM t GROUP BY ALL)
SELECT item_id, length(coalesce(c, '{context.NOTHING}'))::INT AS n_chars, md5(coalesce(c, '{context.NOTHING}')) AS context_md5 FROM benchmark LEFT JOIN c USING (item_id)"""


def answer_headings(spark: SparkSession, d: str) -> DataFrame:
    """Documents as answers that cite sources in headings, texts and code: their headings without citations, and what they cite outside code."""
    g = S._guide(spark, d)
    md = F.regexp_replace(F.regexp_replace("md", r"(?m)^(#+ .*)$", "$1 [S3]"), r"(?m)^(- .*)$", "$1 [S1] `[S9]` [S12]")
    x = markdown.outline(g.select("doc_id", md.alias("md")), "doc_id", F.col("md")).join(g.select("doc_id", md.alias("md")), "doc_id")
    heads = F.transform(context.outline(F.col("sections")), lambda h: F.concat_ws(":", h["at"], h["depth"], h["text"]))
    cites = F.transform(context.cited(F.col("md"), F.array(F.lit("S1"), F.lit("S3"))), lambda c: F.concat(c["sid"], F.when(c["known"], "").otherwise(F.lit("?"))))
    return x.select("doc_id", F.array_join(heads, "|").alias("headings"), F.array_join(F.array_sort(cites), ",").alias("cites"))


HEADINGS_SQL = rf"""WITH {S._guide_sql(6)}, h AS (SELECT doc_id, string_agg((n - 1) || ':' || level || ':' || title, '|' ORDER BY section) AS headings FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS n FROM gs WHERE level > 0) GROUP BY doc_id),
c AS (SELECT doc_id, bool_or(starts_with(line, '- ') AND kind <> 'code') AS item, bool_or(regexp_matches(line, '^#+ ') AND kind <> 'code') AS head FROM gl GROUP BY doc_id)
SELECT doc_id, coalesce(headings, '') AS headings, concat_ws(',', CASE WHEN item THEN 'S1' END, CASE WHEN item THEN 'S12?' END, CASE WHEN head THEN 'S3' END) AS cites FROM c LEFT JOIN h USING (doc_id)"""


def document_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts that need no front matter: outline of three levels, at most 80 headings, number of words, products."""
    x = S._guide(spark, d)
    o = markdown.outline(x, "doc_id", F.col("md"), 3)
    heads = F.slice(F.transform(F.filter("sections", lambda s: s["level"] > 0), lambda s: s["title"]), 1, 80)
    products = vocabularies.detected(F.col("md"), X.PRODUCTS, X.EXACT)
    y = x.select("doc_id", F.regexp_count("md", F.lit(r"[\p{L}\p{N}_]+")).alias("n_words"), F.array_join(products, ",").alias("products"))
    return o.select("doc_id", F.size(heads).alias("n_headings"), F.md5(F.array_join(heads, "|")).alias("outline_md5")).join(y, "doc_id")


FACTS_SQL = rf"""WITH {S._guide_sql(3)}, h AS (SELECT doc_id, list(title ORDER BY section)[1:80] AS h FROM gs WHERE level > 0 GROUP BY doc_id), m AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM gl GROUP BY doc_id)
SELECT doc_id, coalesce(len(h), 0)::INT AS n_headings, md5(coalesce(array_to_string(h, '|'), '')) AS outline_md5, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))::INT AS n_words, {X._detected_sql(X.PRODUCTS, X.EXACT)} AS products FROM m LEFT JOIN h USING (doc_id)"""


def dry_run(spark: SparkSession, d: str) -> DataFrame:
    """What an ingestion would make of the documents of a source, without models or a store: nodes by level and kind with their tokens."""
    docs = S._guide(spark, d)
    t = chunking.tree(docs, "doc_id", F.col("md")).join(docs.select("doc_id", "lang", "source"), "doc_id")
    kind = F.when(markdown.endpoint(F.col("path")).isNotNull(), "endpoint").otherwise(F.lit("content"))
    return t.groupBy("source", "level", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs")).filter("level <> 'document'")


DRY_SQL = rf"""WITH {S._blocks_sql(6)}, {S._pack_sql(200, 20)},
an AS (SELECT a.doc_id, a.section, a.level, bool_or(regexp_matches(trim(b.title), '^(GET|HEAD|POST|PUT|PATCH|DELETE|OPTIONS)\s+/\S*$')) AS e FROM gs a LEFT JOIN gs b ON a.doc_id = b.doc_id AND b.level > 0 AND a.section BETWEEN b.section AND b."last" GROUP BY ALL),
n AS (SELECT doc_id, 'section' AS level, e FROM an WHERE level > 0 UNION ALL SELECT doc_id, 'chunk', e FROM k5 JOIN an USING (doc_id, section))
SELECT source, level, CASE WHEN e THEN 'endpoint' ELSE 'content' END AS kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM n JOIN documents USING (doc_id) GROUP BY ALL"""


SYSTEM = "Entrepot"


def partner_profile(spark: SparkSession, d: str) -> DataFrame:
    """Nations as partners: their suppliers are the products, and numbers tell the other facts."""
    k = F.col("n_nationkey")
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list("s_name")).alias("products"))
    x = table(spark, d, "nation").join(s, "n_nationkey", "left")
    code = F.when(k % 3 != 0, F.concat(F.lit("format du code apporteur "), k.cast("string"), F.lit("..")))
    f = profiles.partner(F.col("n_name"), code, F.col("products"), F.when(k % 4 != 3, k % 4 == 1), F.when(k % 5 == 0, "mensuelle").otherwise(F.lit("")), k % 2 == 0, SYSTEM)
    return x.select("n_nationkey", "n_name", f["title"].alias("title"), f["summary"].alias("summary"), *(F.array_join(f[c], "|").alias(c) for c in ("tasks", "questions", "keywords", "prerequisites")))


_said = lambda texts: "|".join(texts).replace("'", "''").replace("{s}", SYSTEM).replace("{p}", "' || n_name || '")
PARTNER_SQL = f"""WITH s AS (SELECT s_nationkey AS n_nationkey, list(s_name ORDER BY s_name) AS p FROM supplier GROUP BY ALL), x AS (SELECT *, n_nationkey AS k FROM nation LEFT JOIN s USING (n_nationkey)),
f AS (SELECT *, concat_ws(' ; ', CASE WHEN k % 3 <> 0 THEN 'format du le code apporteur ' || k END, CASE WHEN len(p) > 0 THEN len(p) || ' produit(s) agrégé(s) : ' || array_to_string(p[1:8], ', ') || CASE WHEN len(p) > 8 THEN '…' ELSE '' END END,
  CASE k % 4 WHEN 3 THEN NULL WHEN 1 THEN 'prix d''achat moyens transmis' ELSE 'prix d''achat moyens non transmis' END, CASE WHEN k % 5 = 0 THEN 'agrégation mensuelle' END, CASE WHEN k % 2 = 0 THEN 'lettre d''autorisation signée requise' END) AS facts FROM x)
SELECT n_nationkey, n_name, '{_said([profiles.TITLE])}' AS title, 'Fiche d''agrégation du partenaire ' || n_name || ' dans {SYSTEM}' || CASE WHEN facts <> '' THEN ' : ' || facts ELSE '' END || '.' AS summary, '{_said(profiles.TASKS)}' AS tasks,
'{_said(profiles.QUESTIONS)}' AS questions, n_name || '|{_said(profiles.KEYWORDS)}' || CASE WHEN len(p) > 0 THEN '|' || array_to_string(p[1:6], '|') ELSE '' END AS keywords, CASE WHEN k % 2 = 0 THEN 'Lettre d''autorisation complétée et signée' ELSE '' END AS prerequisites FROM f"""


def intent_routing(spark: SparkSession, d: str) -> DataFrame:
    """User turns with an analysis told by their number, some of it missing or broken, routed by what they and the turns before them say."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = F.col("turn")
    x = table(spark, d, "conversations").withColumn("history", F.lag("text").over(w)).filter("role = 'user'")
    at = lambda *names: F.element_at(F.array(*map(F.lit, names)), (t % len(names) + 1).cast("int"))
    said = F.to_json(F.struct(
        F.left("text", F.lit(15)).alias("standalone_question"), at("Reference", "autre chose", "faq").alias("intent"), at("api", "", "help", "api").alias("corpus"), at("outils", "documentation").alias("route"),
        F.array(F.left("text", F.lit(5)), F.left("text", F.lit(15)), F.lit(" "), F.lit("never")).alias("sub_queries"),
    ))
    analysis = F.when(F.col("conv_id") % 5 == 1, F.lit(None)).when(F.col("conv_id") % 5 == 2, F.lit("{broken")).otherwise(said)
    r = profiles.routed(F.col("text"), F.col("history"), analysis, ["reference", "faq", "autre"], "(?i)tion", "api", tools=False)
    x = x.select("conv_id", "turn", *(c.alias(k) for k, c in r.items()))
    boost = profiles.boosted(t % 2, F.col("intent"), F.col("corpus"), ["reference"], "api")
    return x.select("conv_id", "turn", "intent", "corpus", "route", F.size("queries").alias("n_queries"), F.md5(F.array_join("queries", "|")).alias("queries_md5"), "fallback", boost.alias("boost"))


ROUTING_SQL = """WITH h AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS history FROM conversations), u AS (SELECT *, conv_id % 5 IN (1, 2) AS lost FROM h WHERE role = 'user'),
a AS (SELECT *, CASE WHEN lost THEN 'autre' ELSE ['reference', 'autre', 'faq'][turn % 3 + 1] END AS intent, CASE WHEN lost THEN '' ELSE ['api', '', 'help', 'api'][turn % 4 + 1] END AS said FROM u),
b AS (SELECT *, CASE WHEN said = 'api' AND NOT regexp_matches(concat_ws(' ', text, history), '(?i)tion') THEN '' ELSE said END AS corpus,
  list_filter(list_transform(CASE WHEN lost THEN [text] ELSE [text, left(text, 15), left(text, 5), left(text, 15)] END, lambda x: trim(x)), lambda x: x <> '') AS c FROM a),
q AS (SELECT *, list_transform(list_sort(list_transform(list_distinct(c), lambda x: {'p': list_position(c, x), 'x': x})), lambda s: s.x) AS q FROM b)
SELECT conv_id, turn, intent, corpus, 'documentation' AS route, coalesce(len(q), 0)::INT AS n_queries, md5(coalesce(array_to_string(q, '|'), '')) AS queries_md5, lost AS fallback, turn % 2 = 0 AND (intent <> 'reference' OR corpus = 'api') AS boost FROM q"""


QUERIES = {
    "partner_profile": (partner_profile, PARTNER_SQL),
    "intent_routing": (intent_routing, ROUTING_SQL),
    "vocabulary_text": (vocabulary_text, DESCRIBED_SQL),
    "context_format": (context_format, CONTEXT_SQL),
    "answer_headings": (answer_headings, HEADINGS_SQL),
    "document_facts": (document_facts, FACTS_SQL),
    "dry_run": (dry_run, DRY_SQL),
    "catalogue_scan": (catalogue_scan, CATALOGUE_SQL),
    "vocabulary_scan": (vocabulary_scan, VOCABULARY_SQL),
    "business_questions": (business_questions, BUSINESS_SQL),
    "payload_flatten": (payload_flatten, PAYLOAD_SQL),
    "report_breakdown": (report_breakdown, BREAKDOWN_SQL),
    "verdict_rates": (verdict_rates, RATES_SQL),
}
