"""Queries on texts: URLs, links, folding, cleaning, features, languages, overlap and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features, lexical, vocabularies
from .common import SQL_FOLD, SQL_KEY, SQL_TOKENS, table

Q = "'"


def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", T.canonical_url(u).alias("canonical"), T.same_url(u).alias("same"), T.url_slug(u).alias("slug"), F.size(T.links_in("html")).alias("n_links"))


URL_SQL = r"""SELECT page_id, regexp_replace(regexp_replace(url, '[#?].*$', ''), '/+$', '') || '/' AS canonical,
regexp_replace(regexp_replace(lower(trim(url)), '^http://', 'https://'), '/+$', '') AS same,
string_split(regexp_replace(regexp_replace(lower(trim(regexp_replace(url, '[#?].*$', ''))), '^http://', 'https://'), '/+$', ''), '/')[-1] AS slug,
len(regexp_extract_all(html, 'https?://[^\s)\]>"'']+'))::INT AS n_links FROM pages"""


def link_graph(spark: SparkSession, d: str) -> DataFrame:
    """Each page's resolved links and the pages that cite it: relative links resolve against the page's host, the first page of a URL wins, a page does not link to itself."""
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    host = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    links = pages.select("page_id", F.explode(F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda h: F.when(h.startswith("/"), F.concat(host, h)).otherwise(h))).alias("href"))
    links = links.select("page_id", T.canonical_url(F.col("href")).alias("target")).distinct()
    own = pages.groupBy(T.canonical_url(F.col("url")).alias("target")).agg(F.min("page_id").alias("to"))
    edges = links.join(own, "target").filter("page_id <> to").select("page_id", "to").distinct()
    out = edges.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_out"))
    into = edges.groupBy(F.col("to").alias("page_id")).agg(F.count(F.lit(1)).alias("n_in"))
    missing = links.join(own, "target", "left_anti").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_missing"))
    done = pages.select("page_id").join(out, "page_id", "left").join(into, "page_id", "left").join(missing, "page_id", "left")
    return done.select("page_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_out", "n_in", "n_missing")))


LINKS_SQL = r"""WITH l AS (SELECT DISTINCT page_id, regexp_replace(regexp_replace(CASE WHEN h LIKE '/%' THEN regexp_extract(url, '^(https?://[^/]+)', 1) || h ELSE h END, '[#?].*$', ''), '/+$', '') || '/' AS target
  FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages)),
o AS (SELECT regexp_replace(regexp_replace(url, '[#?].*$', ''), '/+$', '') || '/' AS target, min(page_id) AS dest FROM pages GROUP BY 1),
e AS (SELECT DISTINCT page_id, dest FROM l JOIN o USING (target) WHERE page_id <> dest)
SELECT page_id, (SELECT count(*) FROM e WHERE e.page_id = p.page_id) AS n_out, (SELECT count(*) FROM e WHERE e.dest = p.page_id) AS n_in,
(SELECT count(*) FROM l WHERE l.page_id = p.page_id AND l.target NOT IN (SELECT target FROM o)) AS n_missing FROM pages p"""


def slug_and_fold(spark: SparkSession, d: str) -> DataFrame:
    line = F.substring_index("text", "\n", 1)
    return table(spark, d, "documents").select("doc_id", T.slug(line).alias("slug"), F.md5(T.fold(F.col("text"))).alias("folded"), F.md5(T.norm(F.col("text"))).alias("normed"), F.md5(T.despace(F.col("text"))).alias("despaced"), T.text_key(F.col("text")).alias("text_key"))


SLUG_SQL = rf"""SELECT doc_id, regexp_replace(regexp_replace({SQL_FOLD.format("string_split(text, chr(10))[1]")}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
md5({SQL_FOLD.format("text")}) AS folded, md5(trim(regexp_replace(lower(replace(text, '’', {Q * 4})), '[^\p{{L}}\p{{N}}_+%€$]+', ' ', 'g'))) AS normed,
md5(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '', 'g')) AS despaced, {SQL_KEY.format("text")} AS text_key FROM documents"""


def clean_chars(spark: SparkSession, d: str) -> DataFrame:
    c = T.squeeze_lines(T.strip_invisible(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.md5(c).alias("cleaned"), F.length(c).alias("n_chars"))


CLEAN_SQL = r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[\x{FEFF}\x{200B}-\x{200F}\x{00AD}\x{2060}]', '', 'g'), '[\x{0080}-\x{009F}]', '•', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\s+$', '') || chr(10) AS t FROM a)
SELECT doc_id, md5(t) AS cleaned, length(t)::INT AS n_chars FROM b"""


def structural_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of every page and document, lists as their size and joined text."""
    both = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    both = both.unionByName(table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"))
    f = features.structural(F.col("text"))
    return both.select("kind", "id", *(c.alias(k) if k.startswith("has") else F.array_join(c, ",").alias(k) for k, c in f.items()))


def _all(pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(text, '{pattern.replace(Q, Q + Q)}', {group})"


def _first_of_equal(values: str, most: int = 0) -> str:
    """The distinct values of a list in order, at most `most`, joined by commas."""
    out = f"list_sort(list_transform(list_distinct({values}), lambda x: {{'p': list_position({values}, x), 'x': x}}))"
    return f"coalesce(array_to_string(list_transform({out}{f'[1:{most}]' if most else ''}, lambda s: s.x), ','), '')"


_quoted = lambda of: ", ".join(f"'{x}'" for x in of)
_spans, _requests = _all(features.CODE_SPAN, 1), _all(features.REQUEST)
_methods = f"list_transform({_requests}, lambda x: regexp_extract(x, '^[A-Z]+')) || list_filter(list_transform({_all(features.LED, 1)} || {_all(features.FIELD_OF_METHOD, 1)}, lambda x: upper(x)), lambda x: x IN ({_quoted(features.ALONE)}))"
_paths = f"list_transform({_requests}, lambda x: regexp_extract(x, '{features.PATH}')) || list_filter({_spans}, lambda x: regexp_matches(x, '^{features.PATH}$') AND length(x) > 1)"
_names = f"""list_filter(list_filter({_all(T.TOKEN)}, lambda x: regexp_matches(x, '{features.COMPOUND}')) || list_filter(list_transform({_all(features.QUOTATION, 1)}
  || list_transform({_all(features.CELL, 1)} || {_all(features.ITEM, 1)}, lambda x: regexp_replace(x, '{features.REMARK}', '', 'g')), lambda x: trim(x)), lambda x: regexp_matches(x, '{features.NAME}')), lambda x: x NOT IN ({_quoted(features.NOT_CONSTANTS)}))"""
FEATURES_SQL = f"""WITH t AS (SELECT 'page' AS kind, page_id AS id, html AS text FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)
SELECT kind, id, {_first_of_equal(_methods)} AS methods, {_first_of_equal(_paths, 20)} AS endpoints, {_first_of_equal(_all(features.URL), 10)} AS urls,
{_first_of_equal(f"list_filter({_spans}, lambda x: regexp_matches(x, '{features.IDENTIFIER}') AND length(x) <= 61)", 30)} AS parameters, {_first_of_equal(_names, 40)} AS constants,
{_first_of_equal(f"list_transform({_all(features.INFO, 1)}, lambda x: lower(x))")} AS code_languages,
len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '|') AND ends_with(x, '|') AND length(x) > 1)) >= 2 AS has_table,
regexp_matches(text, '{features.LIST_ROW}') AS has_list, regexp_matches(text, '{features.FENCE}') AS has_code FROM t"""


def status_codes(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    both = both.unionByName(table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"))
    codes = features.status_codes(F.col("text"))
    return both.select("kind", "id", F.array_join(F.array_sort(codes), ",").alias("codes"), F.size(codes).alias("n_codes"))


_codes = ", ".join(f"'{x}'" for x in features.STATUS_CODES)
STATUS_SQL = rf"""WITH t AS (SELECT 'page' AS kind, page_id AS id, html AS text FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents),
l AS (SELECT kind, id, unnest(string_split(text, chr(10))) AS line FROM t), n AS (SELECT kind, id, unnest(regexp_extract_all(line, '[\d.]+')) AS x FROM l WHERE len(list_filter([{_quoted(features.STATUS_WORDS)}], lambda w: contains(lower(line), w))) > 0),
c AS (SELECT DISTINCT kind, id, x AS code FROM n WHERE regexp_matches(x, '^[1-5]\d{{2}}$'))
SELECT kind, id, coalesce(string_agg(code, ',' ORDER BY code) FILTER (code IN ({_codes})), '') AS codes, count(code) FILTER (code IN ({_codes}))::INT AS n_codes FROM t LEFT JOIN c USING (kind, id) GROUP BY kind, id"""


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    cut = T.hard_split(t, 512)
    return table(spark, d, "documents").select("doc_id", T.n_tokens(t).alias("n_tokens"), F.md5(T.token_tail(t, 50)).alias("tail"), F.size(cut).alias("n_pieces"), F.md5(F.element_at(cut, -1)).alias("last_piece"))


TOKENS_SQL = """SELECT doc_id, greatest(1, length(text) // 4)::INT AS n_tokens, md5(right(text, 200)) AS tail, greatest(1, ceil(length(text) / 2048))::INT AS n_pieces,
md5(substr(text, (greatest(1, ceil(length(text) / 2048))::INT - 1) * 2048 + 1)) AS last_piece FROM documents"""

NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def node_ids(spark: SparkSession, d: str) -> DataFrame:
    """Version 5 UUIDs of document|level|path|ordinal; the ordinal keeps equal paths of one document apart."""
    name = F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.lit("section"), "source", F.lit("0"))
    return table(spark, d, "documents").select("doc_id", T.uuid5(name, NAMESPACE).alias("node_id"))


_sha = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc_id || chr(31) || 'section' || chr(31) || source || chr(31) || '0'))"
NODE_SQL = f"""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(h, 17, 1))::INT + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS node_id
FROM (SELECT doc_id, {_sha} AS h FROM documents)"""


def language_guess(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", features.is_french(F.col("text")).alias("french"))


_fr, _en = (", ".join(f"'{x}'" for x in of) for of in (features.FRENCH, features.ENGLISH))
LANGUAGE_SQL = f"""SELECT doc_id, lang, len(list_filter(w, lambda x: x IN ({_fr}))) >= len(list_filter(w, lambda x: x IN ({_en}))) AS french
FROM (SELECT doc_id, lang, regexp_extract_all(lower(regexp_replace(text, '(?s)```.*?```', ' ', 'g')), '{features.LETTERS}') AS w FROM documents)"""

#: A small vocabulary of products with their forms, one of exact case, and a glossary with an acronym.
PRODUCTS = {"licence": ("license", "apache license"), "contact": ("e-mail", "email"), "The": (), "conjunction": ("and", "und"), "version": ("version 2.0",)}
EXACT = ("The",)
GLOSSARY = {"IS": ("it is",), "of": ("of the", "of that"), "not": ("nicht", "no")}


def taxonomy_detect(spark: SparkSession, d: str) -> DataFrame:
    """Products and glossary terms that every document holds as whole words, acronyms by exact case, and the glossary's expansions."""
    products, terms = vocabularies.detected(F.col("text"), PRODUCTS, EXACT), vocabularies.detected(F.col("text"), GLOSSARY)
    x = table(spark, d, "documents").select("doc_id", products.alias("products"), terms.alias("terms"))
    return x.select("doc_id", F.array_join("products", ",").alias("products"), F.array_join("terms", ",").alias("terms"), F.array_join(vocabularies.expansions(F.col("terms"), GLOSSARY), ",").alias("expansions"))


def _detected_sql(vocabulary: dict, exact: tuple = (), shown=lambda t, forms: t) -> str:
    hit = lambda t, f: f"regexp_matches(text, '{vocabularies.pattern([t, *f], t in exact or (t.isupper() and len(t) > 1))}')"
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {hit(t, f)} THEN '{shown(t, f)}' END" for t, f in vocabulary.items()) + ")"


TAXONOMY_SQL = f"""SELECT doc_id, {_detected_sql(PRODUCTS, EXACT)} AS products, {_detected_sql(GLOSSARY)} AS terms, {_detected_sql(GLOSSARY, shown=lambda t, f: ",".join([t, *f]))} AS expansions FROM documents"""


def taxonomy_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Values outside the vocabulary become the default."""
    known = spark.createDataFrame([(f"src{i}", f"theme{i % 4}") for i in range(12)], "value string, theme string")
    docs = table(spark, d, "documents").withColumn("value", F.lower(F.trim(F.concat(F.lit("  "), F.upper("source"), F.lit(" ")))))
    return docs.join(F.broadcast(known), "value", "left").groupBy(F.coalesce("theme", F.lit("autre")).alias("theme"), "lang").agg(F.count(F.lit(1)).alias("n"))


NORMALISE_SQL = """SELECT CASE WHEN regexp_extract(source, '\\d+')::INT < 12 THEN 'theme' || regexp_extract(source, '\\d+')::INT % 4 ELSE 'autre' END AS theme, lang, count(*) AS n FROM documents GROUP BY ALL"""


def shingle_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Share of each benchmark item's distinct four-word shingles that a document holds, where it holds any; shingles are told by 64-bit hashes."""
    n = 4

    def grams(of: str, key: str) -> DataFrame:
        """key, g: a row for every place of a shingle. No text's shingles are held as a list, and its words are told once: a filter on them would tell them again."""
        w = lexical.spread(table(spark, d, of).select(key, "text")).select(key, T.tokens(F.col("text")).alias("w"))
        i = F.explode(F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n))).alias("i")
        return w.select(key, "w", i).select(key, F.xxhash64(*(F.get("w", F.col("i") + k) for k in range(n))).alias("g"))

    items = grams("benchmark", "item_id").distinct()
    size = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    both = grams("documents", "doc_id").join(items, "g").groupBy("doc_id", "item_id").agg(F.countDistinct("g").alias("shared"))
    return both.join(size, "item_id").select("item_id", "doc_id", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("coverage"), (F.col("shared") >= 0.8 * F.col("n")).alias("covered"))


_g = "SELECT DISTINCT {0}, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT {0}, w, unnest(generate_series(1, len(w) - 3)) AS i FROM (SELECT {0}, " + SQL_TOKENS.format("text").replace("{", "{{").replace("}", "}}") + " AS w FROM {1}) WHERE len(w) >= 4)"
SHINGLE_SQL = f"""WITH a AS ({_g.format("doc_id", "documents")}), b AS ({_g.format("item_id", "benchmark")}), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY ALL)
SELECT item_id, doc_id, count(*) AS shared, round(count(*) / any_value(n), 6) AS coverage, count(*) >= 0.8 * any_value(n) AS covered FROM a JOIN b USING (g) JOIN n USING (item_id) GROUP BY item_id, doc_id"""


def occurrence_number(spark: SparkSession, d: str) -> DataFrame:
    """Lines that a document repeats: which occurrence each is, and the distinct lines' number."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id", "line")
    lines = lines.withColumn("nth", F.row_number().over(w.orderBy("pos"))).withColumn("of", F.count(F.lit(1)).over(w))
    return lines.filter("of > 1").select("doc_id", "pos", "nth", "of", F.md5("line").alias("line_md5"))


OCCURRENCE_SQL = """WITH l AS (SELECT doc_id, unnest(generate_series(0, len(x) - 1)) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))
SELECT doc_id, pos::INT AS pos, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos)::INT AS nth, count(*) OVER (PARTITION BY doc_id, line) AS of, md5(line) AS line_md5 FROM l QUALIFY of > 1"""


def lost_words(spark: SparkSession, d: str) -> DataFrame:
    """Words over three letters of the raw text that are neither words nor, spaceless, part of the cleaned text (symbols and their words removed)."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.regexp_replace("text", r"\S*[#$%&|]\S*", " ").alias("clean"))
    raw = F.filter(F.array_distinct(T.tokens(F.col("text"))), lambda w: F.length(w) > 3)
    lost = F.filter(F.array_except(raw, T.tokens(F.col("clean"))), lambda w: ~F.contains(T.despace(F.col("clean")), w))
    return docs.select("doc_id", F.size(lost).alias("n_lost"), F.array_join(F.array_sort(lost), " ").alias("lost"))


LOST_SQL = rf"""WITH c AS (SELECT doc_id, text, regexp_replace(text, '\S*[#$%&|]\S*', ' ', 'g') AS clean FROM documents),
x AS (SELECT doc_id, clean, list_distinct({SQL_TOKENS.format("text")}) AS raw, {SQL_TOKENS.format("clean")} AS kept, regexp_replace(lower(clean), '[^\p{{L}}\p{{N}}]+', '', 'g') AS flat FROM c),
y AS (SELECT doc_id, list_sort(list_filter(raw, lambda w: length(w) > 3 AND NOT list_contains(kept, w) AND NOT contains(flat, w))) AS lost FROM x)
SELECT doc_id, len(lost)::INT AS n_lost, coalesce(array_to_string(lost, ' '), '') AS lost FROM y"""


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    crumb = F.concat(F.col("lang"), F.lit(" > "), F.col("source"), F.lit(" » "), F.lit("x "), F.lit("›"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", F.left(F.sha2("text", 256), F.lit(16)).alias("file_hash"), F.array_join(T.breadcrumb_parts(crumb), "/").alias("parts"), F.md5(T.head_tail(F.col("text"))).alias("cut"), F.length(T.head_tail(F.col("text"))).alias("n_cut"))


FINGERPRINT_SQL = """SELECT doc_id, left(sha256(text), 16) AS file_hash, lang || '/' || source || '/x/' || doc_id AS parts, md5(cut) AS cut, length(cut)::INT AS n_cut
FROM (SELECT *, CASE WHEN length(text) > 24000 THEN left(text, 20000) || chr(10) || '[…]' || chr(10) || right(text, 4000) ELSE text END AS cut FROM documents)"""


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = T.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.md5(F.substring(F.array_join(F.slice(s, 1, 3), " "), 1, 450)).alias("summary"))


SENTENCE_SQL = r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 25 AND NOT regexp_matches(x, '^[#|]')) AS s FROM documents)
SELECT doc_id, len(s)::INT AS n_sentences, md5(left(coalesce(array_to_string(s[1:3], ' '), ''), 450)) AS summary FROM s"""


def title_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Title: a heading line, else a first line that is no sentence of over 80 characters, else the source's name; id: the slug with a prefix."""
    head = F.nullif(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1), F.lit(""))
    line = F.substring_index("text", "\n", 1)
    title = F.coalesce(head, F.when(F.length(line).between(1, 80), line), F.initcap("source"))
    return table(spark, d, "documents").select("doc_id", title.alias("title"), F.concat(F.lit("help-"), T.slug(title), F.lit("-"), F.col("doc_id")).alias("resolved_id"))


TITLE_SQL = rf"""WITH t AS (SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?m)^#\s+(.+)$', 1), ''), CASE WHEN length(string_split(text, chr(10))[1]) BETWEEN 1 AND 80 THEN string_split(text, chr(10))[1] END, upper(left(source, 1)) || substr(source, 2)) AS title FROM documents)
SELECT doc_id, title, 'help-' || regexp_replace(regexp_replace({SQL_FOLD.format("title")}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || doc_id AS resolved_id FROM t"""

def path_features(spark: SparkSession, d: str) -> DataFrame:
    """Menu and field paths of documents that have some put in."""
    text = F.concat(F.lit("Open the "), "source", F.lit(" settings > "), "lang", F.lit(" > last one two three four five six seven. See group / field"), F.col("doc_id").cast("string"), F.lit(" and readme/file.md and /users/list, "), "text")
    x = table(spark, d, "documents").select("doc_id", text.alias("t"))
    return x.select("doc_id", F.array_join(features.menu_paths(F.col("t")), "|").alias("menus"), F.array_join(features.field_paths(F.col("t")), "|").alias("fields"))


_leads = ", ".join(f"'{x}'" for x in features.LEADS)
_seg = f"list_filter(string_split(s, ' '), lambda w: w <> '' AND lower(w) NOT IN ({_leads}))"
_uniq = lambda x: f"coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct({x}), lambda u: {{{{'p': list_position({x}, u), 'x': u}}}})), lambda v: v.x), '|'), '')".replace("{{", "{").replace("}}", "}")
PATHS_SQL = rf"""WITH t AS (SELECT doc_id, 'Open the ' || source || ' settings > ' || lang || ' > last one two three four five six seven. See group / field' || doc_id || ' and readme/file.md and /users/list, ' || text AS t FROM documents),
m AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(t, '{features.MENU}'), lambda p: array_to_string(list_filter(list_transform(string_split(p, ' > '), lambda s, i: CASE WHEN i = 1
  THEN array_to_string(({_seg})[-7:], ' ') ELSE array_to_string((list_filter(string_split(s, ' '), lambda w: w <> ''))[1:7], ' ') END), lambda s: s <> ''), ' > ')), lambda p: contains(p, ' > ')) AS m,
  list_filter(regexp_extract_all(regexp_replace(t, '([A-Za-z0-9]) / ([A-Za-z])', '\1/\2', 'g'), '{features.FIELD}', 1), lambda p: NOT regexp_matches(p, '\.({"|".join(features.EXTENSIONS)})$')) AS f FROM t)
SELECT doc_id, {_uniq("m")} AS menus, {_uniq("f")} AS fields FROM m"""


def diagnostic_headings(spark: SparkSession, d: str) -> DataFrame:
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 1, F.concat(i.cast("string"), F.lit(". "), x)).otherwise(x)), "\n")
    x = table(spark, d, "documents").select("doc_id", features.diagnostic_headings(numbered).alias("t"))
    return x.select("doc_id", F.md5("t").alias("sheet"), F.regexp_count("t", F.lit(r"(?m)^## ")).alias("n_headings"))


DIAGNOSTIC_SQL = r"""WITH l AS (SELECT doc_id, (list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 4 = 1 THEN (i - 1) || '. ' || x ELSE x END))[2:] AS l FROM documents),
t AS (SELECT doc_id, coalesce(array_to_string(list_transform(l, lambda x: regexp_replace(x, '^\s*\d+[.)]\s+(.+)$', '## \1')), chr(10)), '') AS t FROM l)
SELECT doc_id, md5(t) AS sheet, len(regexp_extract_all(t, '(?m)^## '))::INT AS n_headings FROM t"""

def frequent_menus(spark: SparkSession, d: str) -> DataFrame:
    """The twenty commonest menu paths by source, of texts that have some put in."""
    text = F.concat(F.lit("Open the "), "lang", F.lit(" settings > "), "source", F.lit(" > rights, "), "text")
    x = table(spark, d, "documents").select("source", F.explode(features.menu_paths(text)).alias("menu")).groupBy("source", "menu").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "menu")
    return x.withColumn("rank", F.row_number().over(w)).filter("rank <= 20")


MENUS_SQL = rf"""WITH t AS (SELECT doc_id, source, 'Open the ' || lang || ' settings > ' || source || ' > rights, ' || text AS t FROM documents),
m AS (SELECT source, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(t, '{features.MENU}'), lambda p: array_to_string(list_filter(list_transform(string_split(p, ' > '), lambda s, i: CASE WHEN i = 1
  THEN array_to_string(({_seg})[-7:], ' ') ELSE array_to_string((list_filter(string_split(s, ' '), lambda w: w <> ''))[1:7], ' ') END), lambda s: s <> ''), ' > ')), lambda p: contains(p, ' > ')))) AS menu FROM t)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, menu) AS rank FROM (SELECT source, menu, count(*) AS n FROM m GROUP BY ALL)) WHERE rank <= 20"""

QUERIES = {
    "frequent_menus": (frequent_menus, MENUS_SQL),
    "path_features": (path_features, PATHS_SQL),
    "diagnostic_headings": (diagnostic_headings, DIAGNOSTIC_SQL),
    "url_normalise": (url_normalise, URL_SQL),
    "link_graph": (link_graph, LINKS_SQL),
    "slug_and_fold": (slug_and_fold, SLUG_SQL),
    "clean_chars": (clean_chars, CLEAN_SQL),
    "structural_features": (structural_features, FEATURES_SQL),
    "status_codes": (status_codes, STATUS_SQL),
    "token_counts": (token_counts, TOKENS_SQL),
    "node_ids": (node_ids, NODE_SQL),
    "language_guess": (language_guess, LANGUAGE_SQL),
    "taxonomy_detect": (taxonomy_detect, TAXONOMY_SQL),
    "taxonomy_normalise": (taxonomy_normalise, NORMALISE_SQL),
    "shingle_overlap": (shingle_overlap, SHINGLE_SQL),
    "occurrence_number": (occurrence_number, OCCURRENCE_SQL),
    "lost_words": (lost_words, LOST_SQL),
    "fingerprints": (fingerprints, FINGERPRINT_SQL),
    "sentence_split": (sentence_split, SENTENCE_SQL),
    "title_resolution": (title_resolution, TITLE_SQL),
}
