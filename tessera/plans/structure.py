"""Queries on document structure: lines, sections, chunks, trees, rules, precedence and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, lexical, markdown, rules, trees
from ..sources import files
from .common import SQL_FOLD, table


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown: their whole lines, before some of which headings, fences and page marks are put in, by the line's number."""
    mark = lambda x, i: (
        F.when(i % 13 == 0, F.concat(F.lit("# "), F.left(x, F.lit(20)))).when(i % 5 == 0, F.concat(F.lit("## "), F.left(x, F.lit(12)))).when(i % 7 == 0, F.concat(F.lit("### "), F.left(x, F.lit(8))))
        .when(i % 11 == 0, F.lit("```")).when(i % 17 == 0, F.concat(F.lit("<!-- Page "), i.cast("string"), F.lit(" -->")))
    )
    lines = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.filter(F.array(mark(x, i), x), lambda y: y.isNotNull())))
    return table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("md"))


SQL_LINES = """md AS (SELECT doc_id, i - 1 AS pos, x AS line FROM (SELECT doc_id, unnest(generate_series(1, len(l))) AS i, unnest(l) AS x FROM
  (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda x, i: list_filter([CASE WHEN (i - 1) % 13 = 0 THEN '# ' || left(x, 20) WHEN (i - 1) % 5 = 0 THEN '## ' || left(x, 12)
    WHEN (i - 1) % 7 = 0 THEN '### ' || left(x, 8) WHEN (i - 1) % 11 = 0 THEN '```' WHEN (i - 1) % 17 = 0 THEN '<!-- Page ' || (i - 1) || ' -->' END, x], lambda y: y IS NOT NULL))) AS l FROM documents))),
fe AS (SELECT *, regexp_matches(line, '^\\s*(```|~~~)') AS fence FROM md),
co AS (SELECT *, sum(fence::INT) OVER w % 2 = 1 OR fence AS in_code FROM fe WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
le AS (SELECT *, CASE WHEN NOT in_code AND regexp_matches(line, '^#{1,6}\\s+\\S') THEN length(regexp_extract(line, '^(#{1,6})', 1)) END AS level,
  CASE WHEN NOT in_code THEN TRY_CAST(nullif(regexp_extract(line, '^<!--\\s*[Pp]age\\s+(\\d+)\\s*-->\\s*$', 1), '') AS INT) END AS mark FROM co),
st AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS page, max(CASE WHEN level = 1 THEN pos END) OVER w AS p1, max(CASE WHEN level = 2 THEN pos END) OVER w AS p2, max(CASE WHEN level = 3 THEN pos END) OVER w AS p3
  FROM le WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ln AS (SELECT doc_id, pos, line, in_code, level, page, p1, CASE WHEN p2 > coalesce(p1, -1) THEN p2 END AS p2, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN p3 END AS p3 FROM st)"""


def line_sections(spark: SparkSession, d: str) -> DataFrame:
    x = chunking.lines(_markdown(spark, d), "doc_id", F.col("md"))
    return x.select("doc_id", "pos", "in_code", "level", "page", "section", F.array_join("path", " > ").alias("path"))


LINES_SQL = rf"""WITH {SQL_LINES}, ti AS (SELECT doc_id, pos, regexp_replace(line, '^#{{1,6}}\s+|\s+$', '', 'g') AS title FROM ln)
SELECT ln.doc_id, ln.pos::INT AS pos, in_code, level::INT AS level, page, greatest(coalesce(p1, -1), coalesce(p2, -1), coalesce(p3, -1))::INT AS section, coalesce(concat_ws(' > ', a.title, b.title, c.title), '') AS path
FROM ln LEFT JOIN ti a ON a.doc_id = ln.doc_id AND a.pos = p1 LEFT JOIN ti b ON b.doc_id = ln.doc_id AND b.pos = p2 LEFT JOIN ti c ON c.doc_id = ln.doc_id AND c.pos = p3"""


def section_sizes(spark: SparkSession, d: str) -> DataFrame:
    s = markdown.sections(_markdown(spark, d), "doc_id", F.col("md"))
    return s.select("doc_id", "section", "depth", "n_lines", "first_page", "last_page", F.md5("body").alias("body_md5"))


SIZES_SQL = f"""WITH {SQL_LINES}, s AS (SELECT *, greatest(coalesce(p1, -1), coalesce(p2, -1), coalesce(p3, -1))::INT AS section FROM ln)
SELECT doc_id, section, (count(DISTINCT p1) + count(DISTINCT p2) + count(DISTINCT p3))::INT AS depth, count(*) AS n_lines, min(page) AS first_page, max(page) AS last_page,
md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level IS NULL), '')) AS body_md5 FROM s GROUP BY doc_id, section"""


def chunk_links(spark: SparkSession, d: str) -> DataFrame:
    """Lines as leaves of one section per document: neighbours and positions."""
    x = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("section", "text")).withColumn("at", F.col("section")).withColumn("section", F.floor(F.col("section") / 4))
    x = x.withColumn("node_id", F.concat_ws("-", "doc_id", "at"))
    return chunking.chain(x, "doc_id", ["at"]).select("doc_id", "node_id", "prev_id", "next_id", "position", "in_section", "of_section")


CHAIN_SQL = """WITH l AS (SELECT doc_id, unnest(generate_series(0, len(x) - 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), n AS (SELECT *, doc_id || '-' || k AS node_id FROM l)
SELECT doc_id, node_id, lag(node_id) OVER w AS prev_id, lead(node_id) OVER w AS next_id, (row_number() OVER w - 1)::INT AS position, (row_number() OVER (PARTITION BY doc_id, k // 4 ORDER BY k) - 1)::INT AS in_section,
count(*) OVER (PARTITION BY doc_id, k // 4) AS of_section FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY k)"""


def _guide(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown with every kind of block: each line is turned, by its number, into headings, fences, lists, tables, page marks or separators that hold it."""

    def turned(x: Column, i: Column) -> Column:
        w = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
        page = w("<!-- Page ", i.cast("string"), " -->")
        forms = {
            0: [w("# ", F.left(x, F.lit(20))), x], 2: [w("## ", F.left(x, F.lit(12))), x], 3: [F.lit("```"), x, F.lit(""), w("# ", F.left(x, F.lit(9))), F.lit("```")],
            4: [w("- ", x), F.lit(""), w("  ", x), w("* ", F.left(x, F.lit(30)))], 5: [w("| ", F.left(x, F.lit(30)), " |"), page, F.lit("|---|"), w("| ", x, " |")],
            6: [w("### GET /", F.replace(F.left(x, F.lit(8)), F.lit(" "), F.lit("/"))), x], 7: [x, F.lit("---")], 8: [page, x], 9: [w("#### ", F.left(x, F.lit(10))), x],
            10: [w("1. ", x), w("next ", F.left(x, F.lit(40)))], 11: [x, F.lit("")],
        }
        out = F.array(x)
        for k, lines in forms.items():
            out = F.when((i + F.col("doc_id")) % 12 == k, F.array(*lines)).otherwise(out)
        return out

    lines = F.flatten(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), turned))
    return lexical.spread(table(spark, d, "documents").select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", F.array_join(lines, "\n").alias("md"))


def _guide_sql(levels: int) -> str:
    """gl: doc_id, pos, line, kind, page, section of every line; gs: one row a section with its title, level and last descendant."""
    x = r"""CASE (i - 1 + doc_id) % 12 WHEN 0 THEN ['# ' || left(x, 20), x] WHEN 2 THEN ['## ' || left(x, 12), x] WHEN 3 THEN ['```', x, '', '# ' || left(x, 9), '```']
      WHEN 4 THEN ['- ' || x, '', '  ' || x, '* ' || left(x, 30)] WHEN 5 THEN ['| ' || left(x, 30) || ' |', '<!-- Page ' || (i - 1) || ' -->', '|---|', '| ' || x || ' |']
      WHEN 6 THEN ['### GET /' || replace(left(x, 8), ' ', '/'), x] WHEN 7 THEN [x, '---'] WHEN 8 THEN ['<!-- Page ' || (i - 1) || ' -->', x] WHEN 9 THEN ['#### ' || left(x, 10), x]
      WHEN 10 THEN ['1. ' || x, 'next ' || left(x, 40)] WHEN 11 THEN [x, ''] ELSE [x] END"""
    return rf"""g0 AS (SELECT doc_id, flatten(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {x})) AS l FROM documents),
g1 AS (SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS line FROM g0),
g2 AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence, sum(regexp_matches(line, '^\s*(```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS odd FROM g1),
g3 AS (SELECT *, CASE WHEN odd OR fence THEN 'code' WHEN regexp_matches(line, '^<!--\s*[Pp]age\s+\d+\s*-->\s*$') THEN 'page' WHEN regexp_matches(line, '^#{{1,6}}\s+\S') THEN 'heading'
  WHEN regexp_matches(line, '^(---+|\*\*\*+|___+|<!-- chunk -->)\s*$') THEN 'break' WHEN regexp_matches(line, '^\s*$') THEN 'blank' WHEN regexp_matches(line, '^\s*\|') THEN 'table'
  WHEN regexp_matches(line, '^\s*([-*+]|\d+[.)])\s') THEN 'list' ELSE 'text' END AS kind FROM g2),
g4 AS (SELECT *, CASE WHEN kind = 'heading' AND length(regexp_extract(line, '^(#+)', 1)) <= {levels} THEN length(regexp_extract(line, '^(#+)', 1)) END AS level FROM g3),
gl AS (SELECT *, coalesce(max(CASE WHEN level IS NOT NULL THEN pos END) OVER w, -1) AS section,
  last_value(CASE WHEN kind = 'page' THEN regexp_extract(line, '(\d+)', 1)::INT END IGNORE NULLS) OVER w AS page FROM g4 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
gh AS (SELECT doc_id, section, coalesce(max(level), 0) AS level, regexp_replace(any_value(CASE WHEN level IS NOT NULL THEN line END), '^#{{1,6}}\s+|\s+$', '', 'g') AS title FROM gl GROUP BY ALL),
gn AS (SELECT a.doc_id, a.section, min(b.section) AS stop FROM gh a JOIN gh b ON a.doc_id = b.doc_id AND b.section > a.section AND b.level <= a.level GROUP BY ALL),
gs AS (SELECT h.*, (SELECT max(k.section) FROM gh k WHERE k.doc_id = h.doc_id AND k.section >= h.section AND (n.stop IS NULL OR k.section < n.stop) AND (h.level > 0 OR k.section = h.section)) AS "last"
  FROM gh h LEFT JOIN gn n USING (doc_id, section))"""


def chunk_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Typed blocks of every section; headings of the fourth level and below are blocks."""
    x = markdown.sections(_guide(spark, d), "doc_id", F.col("md"), 3)
    return x.select("doc_id", "section", F.posexplode("blocks").alias("at", "b")).select("doc_id", "section", "at", "b.kind", "b.page", F.length("b.text").alias("n_chars"), F.md5("b.text").alias("text_md5"))


_TRIM = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def _blocks_sql(levels: int) -> str:
    return f"""{_guide_sql(levels)},
b1 AS (SELECT *, sum((kind = 'page')::INT) OVER (PARTITION BY doc_id, section ORDER BY pos) AS np FROM gl WHERE level IS NULL),
b2 AS (SELECT *, kind = 'blank' OR (kind IN ('table', 'text') AND left(line, 1) IN (' ', chr(9))) AS soft FROM b1 WHERE kind <> 'page'),
b3 AS (SELECT *, CASE WHEN soft AND last_value(CASE WHEN NOT soft THEN kind END IGNORE NULLS) OVER w = 'list' THEN 'list' ELSE kind END AS r FROM b2 WINDOW w AS (PARTITION BY doc_id, section ORDER BY pos)),
b4 AS (SELECT *, lag(r) OVER w AS before, lag(np) OVER w AS np0 FROM b3 WINDOW w AS (PARTITION BY doc_id, section ORDER BY pos)),
b5 AS (SELECT *, sum((CASE WHEN r = 'code' THEN (fence AND odd) OR before IS NULL WHEN r IN ('heading', 'break') THEN true WHEN r = 'text' THEN before IS DISTINCT FROM r OR np > np0 ELSE before IS DISTINCT FROM r END)::INT)
  OVER (PARTITION BY doc_id, section ORDER BY pos) AS blk FROM b4 WHERE r <> 'blank'),
b6 AS (SELECT doc_id, section, blk, any_value(r) AS kind, arg_min(page, pos) FILTER (page IS NOT NULL) AS p1, min(pos) AS pos, trim(string_agg(line, chr(10) ORDER BY pos), {_TRIM}) AS text FROM b5 GROUP BY doc_id, section, blk),
b7 AS (SELECT b6.doc_id, b6.section, blk, b6.kind, gl.page, text FROM b6 JOIN gl USING (doc_id, pos) WHERE text <> '')"""


BLOCKS_SQL = f"""WITH {_blocks_sql(3)}
SELECT doc_id, section::INT AS section, (row_number() OVER (PARTITION BY doc_id, section ORDER BY blk) - 1)::INT AS "at", kind, page, length(text)::INT AS n_chars, md5(text) AS text_md5 FROM b7"""


def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of every section packed into chunks of 60 tokens, of which 15 go on into the next."""
    x = markdown.sections(_guide(spark, d), "doc_id", F.col("md"), 3)
    x = x.select("doc_id", "section", F.posexplode(chunking.pack(chunking.cut_blocks(F.col("blocks"), 60), 60, 15)).alias("at", "c"))
    return x.select("doc_id", "section", "at", "c.first_page", "c.last_page", T.n_tokens(F.col("c.text")).alias("n_tokens"), F.md5("c.text").alias("text_md5"))


def _n(x: str) -> str:
    return f"greatest(1, length({x}) // 4)"


def _pack_sql(most: int, overlap: int) -> str:
    join = lambda q: f"array_to_string(list_transform({q}, lambda b: b.text), chr(10) || chr(10))"
    flush = "CASE WHEN acc.now IS NULL THEN acc.out ELSE list_append(acc.out, acc.now) END"
    hard = f"list_transform(generate_series(0, ((length(l) + {4 * most - 1}) // {4 * most} - 1)::INT), lambda i: substr(l, (i * {4 * most} + 1)::BIGINT, {4 * most}))"
    cut = f"""list_filter(list_transform([list_reduce(string_split(text, chr(10)), lambda acc, l: CASE WHEN {_n("l")} > {most} THEN {{'now': NULL::VARCHAR, 'out': list_concat({flush}, {hard})}}
      WHEN acc.now IS NOT NULL AND {_n("acc.now || chr(10) || l")} <= {most} THEN {{'now': acc.now || chr(10) || l, 'out': acc.out}} ELSE {{'now': l, 'out': {flush}}} END, {{'now': NULL::VARCHAR, 'out': []::VARCHAR[]}})],
      lambda acc: {flush})[1], lambda t: trim(t) <> '')"""
    chunk = f"{{'text': {join('acc.now')}, 'fp': list_min(list_transform(acc.now, lambda b: b.page)), 'lp': list_max(list_transform(acc.now, lambda b: b.page))}}"
    out = f"CASE WHEN len(acc.now) = 0 THEN acc.out ELSE list_append(acc.out, {chunk}) END"
    own = "[{'page': b.page, 'text': b.text}]"
    n = f"len(list_filter(generate_series(1, len(acc.now)), lambda k: length({join('acc.now[-k:]')}) // 4 <= {overlap}))"
    carried = f"CASE WHEN {n} > 0 THEN acc.now[-{n}:] ELSE [{{'page': acc.now[-1].page, 'text': right(acc.now[-1].text, {4 * overlap})}}] END"
    fits = lambda q: f"{_n(join(f'list_concat({q}, {own})'))} <= {most}"
    step = f"""CASE WHEN b.kind = 'break' THEN {{'now': acc.now[1:0], 'out': {out}}} WHEN len(acc.now) = 0 OR {fits("acc.now")} THEN {{'now': list_concat(acc.now, {own}), 'out': acc.out}}
      ELSE {{'now': CASE WHEN {fits(carried)} THEN list_concat({carried}, {own}) ELSE {own} END, 'out': {out}}} END"""
    return f"""k1 AS (SELECT doc_id, section, blk, kind, page, CASE WHEN {_n("text")} <= {most} THEN [text] ELSE {cut} END AS ts FROM b7),
k2 AS (SELECT doc_id, section, flatten(list(list_transform(ts, lambda t: {{'kind': kind, 'page': page, 'text': t}}) ORDER BY blk)) AS bs FROM k1 GROUP BY ALL),
k3 AS (SELECT doc_id, section, list_reduce(bs, lambda acc, b: {step}, {{'now': []::STRUCT(page INT, text VARCHAR)[], 'out': []::STRUCT(text VARCHAR, fp INT, lp INT)[]}}) AS acc FROM k2),
k4 AS (SELECT doc_id, section, list_filter({out}, lambda c: NOT regexp_matches(c.text, '^\\s*#{{1,6}}\\s+[^\\n]*\\s*$')) AS c FROM k3),
k5 AS (SELECT doc_id, section, generate_subscripts(c, 1) - 1 AS k, unnest(c) AS c FROM k4)"""


PACK_SQL = f"""WITH {_blocks_sql(3)}, {_pack_sql(60, 15)}
SELECT doc_id, section::INT AS section, k::INT AS "at", c.fp AS first_page, c.lp AS last_page, {_n("c.text")}::INT AS n_tokens, md5(c.text) AS text_md5 FROM k5"""


def section_render(spark: SparkSession, d: str) -> DataFrame:
    """Sections with the text of their subtrees, cut at 150 tokens."""
    x = markdown.render(markdown.sections(_guide(spark, d), "doc_id", F.col("md")), "doc_id", 150)
    return x.select("doc_id", "section", "last", "depth", F.length("rendered").alias("n_chars"), F.md5("rendered").alias("text_md5"))


SQL_RENDERED = rf"""rb AS (SELECT doc_id, section, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level IS NULL AND NOT regexp_matches(line, '^<!--\s*[Pp]age\s+\d+\s*-->\s*$')), ''), '\A\s+|\s+\z', '', 'g') AS body FROM gl GROUP BY ALL),
ro AS (SELECT gs.*, concat_ws(chr(10) || chr(10), repeat('#', level) || ' ' || title, nullif(body, '')) AS own FROM gs JOIN rb USING (doc_id, section)),
rt AS (SELECT a.doc_id, a.section, any_value(a."last") AS "last", string_agg(b.own, chr(10) || chr(10) ORDER BY b.section) AS t FROM ro a JOIN ro b ON a.doc_id = b.doc_id AND b.section BETWEEN a.section AND a."last" GROUP BY ALL),
rd AS (SELECT a.doc_id, a.section, count(b.section) AS depth FROM gs a LEFT JOIN gs b ON a.doc_id = b.doc_id AND b.level > 0 AND a.section BETWEEN b.section AND b."last" GROUP BY ALL),
rx AS (SELECT *, CASE WHEN greatest(1, length(t) // 4) <= 150 THEN t ELSE left(t, 600) || chr(10) || '[…]' END AS x FROM rt JOIN rd USING (doc_id, section))"""
RENDER_SQL = f"""WITH {_guide_sql(6)}, {SQL_RENDERED}
SELECT doc_id, section::INT AS section, "last"::INT AS "last", depth::INT AS depth, length(x)::INT AS n_chars, md5(x) AS text_md5 FROM rx"""

#: Fixed values of the example rules (position, pattern, corpus, slot, value), resources (kind, name, resource) and themes.
GUIDE_RULES = ((0, "^Th", "en", "theme", "articles"), (1, " > GET /", None, "kind", "call"), (2, "(?i)tion", None, "shared", "true"), (3, "^[DE]", None, "theme_hint", "short"), (4, "(?i)[aeiou]$", "fr", "kind", "vowel"))
GUIDE_RESOURCES = (("path", "/The", "the"), ("path", "/Of", "of"), ("path", "/Of/the", "of the"), ("path", "/De", "de"), ("path", "/En", "en"), ("chapter", "La", "la"), ("chapter", "The", "the"), ("chapter", "De", "de"))
GUIDE_THEMES = ("the", "of the", "de", "la")


def section_annotate(spark: SparkSession, d: str) -> DataFrame:
    """Sections with endpoint, resource, chapter, kind, shared flag and theme; the default theme is the document's source."""
    docs = _guide(spark, d)
    x = markdown.sections(docs, "doc_id", F.col("md")).select("doc_id", "section", "path").join(docs.select("doc_id", "lang", "source"), "doc_id")
    r = spark.createDataFrame(GUIDE_RULES, "rule_pos int, pattern string, corpus string, slot string, value string")
    x = markdown.annotate(x, ["doc_id", "section"], r, GUIDE_RESOURCES, list(GUIDE_THEMES), F.col("source"), F.col("lang"))
    return x.drop("path", "lang", "source")


def _values(rows: tuple) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


ANNOTATE_SQL = rf"""WITH {_guide_sql(6)},
pa AS (SELECT a.doc_id, a.section, coalesce(list(b.title ORDER BY b.section) FILTER (b.title IS NOT NULL), []) AS path FROM gs a LEFT JOIN gs b ON a.doc_id = b.doc_id AND b.level > 0 AND a.section BETWEEN b.section AND b."last" GROUP BY ALL),
an AS (SELECT pa.*, lang, source, list_filter(path, lambda h: regexp_matches(trim(h), '^(GET|HEAD|POST|PUT|PATCH|DELETE|OPTIONS)\s+/\S*$'))[-1] AS e FROM pa JOIN documents USING (doc_id)),
ae AS (SELECT *, regexp_extract(e, '^\s*(\S+)', 1) AS method, regexp_extract(e, '(/\S*)\s*$', 1) AS ep FROM an),
ta AS (SELECT doc_id, section, lang, unnest([0, 1]) AS tp, unnest([path[-1], array_to_string(path, ' > ')]) AS target FROM ae WHERE len(path) > 0),
hits AS (SELECT doc_id, section, regexp_replace(slot, '_hint$', '') AS slot, value, ends_with(slot, '_hint') AS hint FROM ta JOIN {_values(GUIDE_RULES)} r(rp, pattern, scope, slot, value) ON regexp_matches(target, pattern) AND (scope IS NULL OR scope = lang)
  QUALIFY row_number() OVER (PARTITION BY doc_id, section, regexp_replace(slot, '_hint$', '') ORDER BY tp, rp) = 1),
res AS (SELECT * FROM {_values(GUIDE_RESOURCES)} v(kind, name, resource)),
ar AS (SELECT ae.*, (SELECT arg_max(resource, length(name)) FROM res WHERE res.kind = 'path' AND (ep = name OR starts_with(ep, name || '/'))) AS p, (SELECT any_value(resource) FROM res WHERE res.kind = 'chapter' AND name = path[1]) AS c FROM ae)
SELECT ar.doc_id, ar.section::INT AS section, CASE WHEN e IS NOT NULL THEN method END AS method, CASE WHEN e IS NOT NULL THEN ep END AS endpoint, coalesce(p, c) AS resource, CASE WHEN len(path) > 0 THEN array_to_string(path[1:2], ' > ') END AS chapter,
coalesce(k.value, CASE WHEN e IS NOT NULL THEN 'endpoint' END, CASE WHEN len(path) = 0 THEN 'document' END, 'content') AS kind, coalesce(s.value = 'true', false) AS shared,
CASE WHEN t.value IS NOT NULL THEN t.value WHEN p IN {GUIDE_THEMES} THEN p WHEN c IN {GUIDE_THEMES} THEN c ELSE source END AS theme, CASE WHEN t.value IS NOT NULL THEN NOT t.hint ELSE coalesce(p IN {GUIDE_THEMES}, false) END AS theme_forced
FROM ar LEFT JOIN hits k ON k.doc_id = ar.doc_id AND k.section = ar.section AND k.slot = 'kind' LEFT JOIN hits s ON s.doc_id = ar.doc_id AND s.section = ar.section AND s.slot = 'shared' LEFT JOIN hits t ON t.doc_id = ar.doc_id AND t.section = ar.section AND t.slot = 'theme'"""


def chunk_tree(spark: SparkSession, d: str) -> DataFrame:
    t = chunking.tree(_markdown(spark, d), "doc_id", F.col("md"))
    return t.select("doc_id", "node_id", "level", "parent_id", "root_id", "prev_id", "next_id", "position", F.size("path").alias("depth"), "token_count")


def node_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents, sections with a heading, and chunks of the tree."""
    t = chunking.tree(_guide(spark, d), "doc_id", F.col("md"))
    return t.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node_id").alias("n_ids"))


COUNTS_SQL = f"""WITH {_blocks_sql(6)}, {_pack_sql(200, 20)}
SELECT 'document' AS level, count(*) AS n, count(*) AS n_ids FROM documents UNION ALL SELECT 'section', count(*), count(*) FROM gs WHERE level > 0 UNION ALL SELECT 'chunk', count(*), count(*) FROM k5"""


def parent_probe(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 60 tokens and whether both of their ends are in their parent's text as it is shown, cut at 150 tokens."""
    x = markdown.render(markdown.sections(_guide(spark, d), "doc_id", F.col("md")), "doc_id", 150)
    x = x.select("doc_id", "section", "rendered", F.posexplode(chunking.pack(chunking.cut_blocks(F.col("blocks"), 60), 60, 15)).alias("at", "c"))
    return x.select("doc_id", "section", "at", chunking.within_parent(F.col("c.text"), F.col("rendered")).alias("within"))


_flat = lambda c: rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
PROBE_SQL = f"""WITH {_blocks_sql(6)}, {_pack_sql(60, 15)}, {SQL_RENDERED},
pp AS (SELECT doc_id, section, k, {_flat("c.text")} AS c, {_flat("x")} AS p FROM k5 JOIN rx USING (doc_id, section))
SELECT doc_id, section::INT AS section, k::INT AS "at", contains(p, left(c, 150)) AND contains(p, right(c, 150)) AS within FROM pp"""


#: Fixed values of the example rules: (position, pattern, corpus, slot, value).
SECTION_RULES = ((0, "^The ", None, "theme", "articles"), (1, "(?i)ti", "en", "theme", "forms"), (2, "(?i)en", None, "kind_hint", "english"), (3, "(?i)[aeiou]$", "es", "kind", "vowel"), (4, "^https://", None, "kind", "secure"), (5, ".", None, "theme_hint", "other"))


def section_rules(spark: SparkSession, d: str) -> DataFrame:
    """Titles, then whole breadcrumbs (URL and title), against ordered rules scoped to a corpus (the page's language)."""
    p = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("corpus"))
    targets = p.select("page_id", "corpus", F.posexplode(F.array("title", F.concat_ws(" > ", "url", "title"))).alias("target_pos", "target"))
    r = spark.createDataFrame(SECTION_RULES, "rule_pos int, pattern string, corpus string, slot string, value string")
    return rules.section_rules(targets, ["page_id"], r)


_sr = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in SECTION_RULES)
RULES_SQL = f"""WITH p AS (SELECT page_id, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS corpus, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url FROM pages),
t AS (SELECT page_id, corpus, 0 AS tp, title AS target FROM p UNION ALL SELECT page_id, corpus, 1, url || ' > ' || title FROM p),
r AS (SELECT * FROM (VALUES {_sr}) AS v(rp, pattern, scope, slot, value))
SELECT page_id, regexp_replace(slot, '_hint$', '') AS slot, value, ends_with(slot, '_hint') AS hint FROM t JOIN r ON regexp_matches(target, pattern) AND (scope IS NULL OR scope = corpus)
QUALIFY row_number() OVER (PARTITION BY page_id, regexp_replace(slot, '_hint$', '') ORDER BY tp, rp) = 1"""

PATTERNS = ((0, "^src1$", "theme", "one"), (1, "^src1", "theme", "tens"), (2, "[02468]$", "parity", "even"), (3, "^src", "theme", "any"))


def precedence_merge(spark: SparkSession, d: str) -> DataFrame:
    """defaults < first matching pattern < label < the document's own language mark. A higher source that is present decides, also with null or an empty string."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    r = spark.createDataFrame(PATTERNS, "pos int, pattern string, slot string, value string")
    by = rules.first_match(docs, ["doc_id"], F.col("source"), r).filter("slot = 'theme'").select("doc_id", F.col("value").alias("pattern_theme"))
    x = docs.join(by, "doc_id", "left").join(table(spark, d, "labels").withColumn("labelled", F.lit(True)), "doc_id", "left")
    own = F.col("lang") == "de"
    theme = rules.overlay(
        (F.lit(True), F.lit("default")), (F.col("pattern_theme").isNotNull(), F.col("pattern_theme")),
        (F.coalesce("labelled", F.lit(False)), F.when(F.col("quality") == 1, F.lit("good"))), (own, F.lit("")),
    )
    return x.select("doc_id", theme.alias("theme"))


PRECEDENCE_SQL = """SELECT d.doc_id, CASE WHEN lang = 'de' THEN '' WHEN l.doc_id IS NOT NULL THEN CASE WHEN quality = 1 THEN 'good' END
WHEN source = 'src1' THEN 'one' WHEN source LIKE 'src1%' THEN 'tens' WHEN source LIKE 'src%' THEN 'any' ELSE 'default' END AS theme FROM documents d LEFT JOIN labels l USING (doc_id)"""


#: Fixed values of the example names: (entity, alias).
NAMES = (("licence", "License"), ("apache", "Apache License"), ("apache two", "Apache License, Version 2.0"), ("contact", "contact"), ("mail", "e-mail"), ("article", "the"), ("conjunction", "and"), ("german", "und"), ("spanish", "que"), ("rights", "Allrights reserved"))


def entity_match(spark: SparkSession, d: str) -> DataFrame:
    """Whole-word names in the texts, longest first: one inside a longer match of the same text does not count."""
    n = spark.createDataFrame(NAMES, "entity string, alias string")
    return rules.longest_matches(table(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"), n)


_plain = "trim(regexp_replace(" + SQL_FOLD + ", '[^a-z0-9]+', ' ', 'g'))"
_names = ", ".join(f"('{a}', '{b}')" for a, b in NAMES)
ENTITY_SQL = f"""WITH n AS (SELECT entity, {_plain.format("alias")} AS alias FROM (VALUES {_names}) v(entity, alias)), t AS (SELECT doc_id, ' ' || {_plain.format("text")} || ' ' AS t FROM documents),
h AS (SELECT doc_id, entity, replace(alias, ' ', '') AS alias FROM t JOIN n ON contains(t, ' ' || alias || ' ') OR (length(replace(alias, ' ', '')) >= {rules.LONG} AND contains(replace(t, ' ', ''), replace(alias, ' ', ''))))
SELECT DISTINCT doc_id, entity FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.doc_id = h.doc_id AND length(g.alias) > length(h.alias) AND contains(g.alias, h.alias))"""


def node_projection(spark: SparkSession, d: str) -> DataFrame:
    """Flat rows: excluded documents (toxic) gone, breadcrumb, short context, and both the document's and the text's products under their own names."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").filter(F.coalesce("toxic", F.lit(0)) == 0)
    context = F.substring(F.trim(F.coalesce(F.nullif(F.substring_index("text", "\n", 1), F.lit("")), "source", F.lit(""))), 1, 400)
    return x.select("doc_id", T.breadcrumb(F.col("source"), F.array("lang", F.lit("part"))).alias("breadcrumb"), context.alias("context"), F.col("source").alias("document_products"), F.array_join(T.ordered_distinct(F.regexp_extract_all("text", F.lit("(The|And|Que|Und) "), F.lit(1))), ",").alias("text_products"))


PROJECTION_SQL = r"""WITH x AS (SELECT d.*, regexp_extract_all(text, '(The|And|Que|Und) ', 1) AS p FROM documents d LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0)
SELECT doc_id, source || ' > ' || lang || ' > part' AS breadcrumb, left(trim(coalesce(nullif(string_split(text, chr(10))[1], ''), source, '')), 400) AS context, source AS document_products,
coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(p), lambda v: {'i': list_position(p, v), 'v': v})), lambda s: s.v), ','), '') AS text_products FROM x"""


def _embedding_text(keep: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("["), F.col("lang"), F.lit("]")), F.coalesce(keep, F.lit("")), F.concat_ws(" > ", "source", "lang"), F.lit(""), "text")


def embed_and_lexical_text(spark: SparkSession, d: str) -> DataFrame:
    """The dense template keeps an empty line for missing parts, the lexical one drops them."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    q = F.when(F.col("quality") == 1, F.lit("good"))
    lexical = F.array_join(T.ordered_distinct(F.array(F.concat_ws(" > ", "source", "lang"), q, F.col("lang"), F.col("text"))), "\n")
    return x.select("doc_id", F.md5(_embedding_text(q)).alias("dense"), F.md5(lexical).alias("lexical"))


EMBED_SQL = r"""WITH x AS (SELECT d.*, CASE WHEN quality = 1 THEN 'good' END AS q FROM documents d LEFT JOIN labels USING (doc_id))
SELECT doc_id, md5('[' || lang || ']' || chr(10) || coalesce(q, '') || chr(10) || source || ' > ' || lang || chr(10) || chr(10) || text) AS dense,
md5(array_to_string(list_filter([source || ' > ' || lang, q, lang, text], lambda v: v <> ''), chr(10))) AS lexical FROM x"""


def tree_propagation(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of the Markdown trees with what goes down to them: language and source of the document, the headings, and the size of a chunk."""
    docs = _guide(spark, d)
    own = F.when(F.col("level") == "document", F.concat_ws("/", "lang", "source")).when(F.col("level") == "section", F.element_at("path", -1)).otherwise(F.col("token_count").cast("string"))
    x = chunking.tree(docs, "doc_id", F.col("md")).join(docs.select("doc_id", "lang", "source"), "doc_id").select("doc_id", "node_id", "parent_id", "level", "position", own.alias("own"))
    out = trees.propagate(files.stored(x, files.scratch(spark, "nodes") + "/rows"), "node_id", "parent_id", F.col("own"))
    return out.select("doc_id", "level", "position", F.col("depth").cast("int").alias("depth"), "inherited")


PROPAGATION_SQL = f"""WITH RECURSIVE {_blocks_sql(6)}, {_pack_sql(200, 20)},
up AS (SELECT a.doc_id, a.section, max(b.section) AS up FROM gs a LEFT JOIN gs b ON a.doc_id = b.doc_id AND b.level > 0 AND b.section < a.section AND a.section <= b."last" GROUP BY ALL),
tr AS (SELECT doc_id, section, 0 AS depth, lang || '/' || source AS t FROM (SELECT doc_id, -1 AS section, lang, source FROM documents) UNION ALL
  SELECT gs.doc_id, gs.section, depth + 1, t || ' > ' || title FROM tr JOIN up ON up.doc_id = tr.doc_id AND coalesce(up.up, -1) = tr.section JOIN gs ON gs.doc_id = up.doc_id AND gs.section = up.section WHERE gs.level > 0)
SELECT doc_id, CASE WHEN section < 0 THEN 'document' ELSE 'section' END AS level, greatest(section, 0)::INT AS position, depth::INT AS depth, t AS inherited FROM tr
UNION ALL SELECT k5.doc_id, 'chunk', (row_number() OVER (PARTITION BY k5.doc_id ORDER BY k5.section, k) - 1)::INT, (depth + 1)::INT, t || ' > ' || {_n("c.text")} FROM k5 JOIN tr ON tr.doc_id = k5.doc_id AND tr.section = k5.section"""


def doc_rollup(spark: SparkSession, d: str) -> DataFrame:
    """By source: commonest language (first seen on ties), sorted languages, and the first lines of the first documents, cut."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.substring_index("text", "\n", 1).alias("line"))
    langs = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    main = langs.groupBy("source").agg(F.max_by("lang", F.struct("n", -F.col("first"))).alias("lang"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))
    first = docs.withColumn("i", rules.occurrence(["source"], "doc_id")).filter("i <= 5").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("xs"))
    return main.join(first.select("source", F.left(F.array_join(F.transform("xs", lambda x: x["line"]), " "), F.lit(1200)).alias("summary")), "source")


ROLLUP_SQL = """WITH l AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL), m AS (SELECT source, lang FROM l QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, f) = 1),
s AS (SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY ALL),
f AS (SELECT source, left(string_agg(string_split(text, chr(10))[1], ' ' ORDER BY doc_id), 1200) AS summary FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5) GROUP BY ALL)
SELECT source, lang, langs, summary FROM m JOIN s USING (source) JOIN f USING (source)"""


def build_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as export rows: short and test rows skipped, family by text, file names by slug with a suffix on collisions, hash over text and sorted metadata."""
    x = table(spark, d, "documents").filter((F.length("text") >= 60) & (F.lower(F.trim("text")) != "test"))
    family = F.when(F.col("text").contains("License"), "licence").when(F.col("text").contains("|"), "table").otherwise("article")
    name = T.slug(F.left("text", F.lit(12)))
    x = x.select("doc_id", family.alias("family"), name.alias("name"), F.sha2(F.concat("text", F.lit('{"lang":"'), "lang", F.lit('","source":"'), "source", F.lit('"}')), 256).alias("content_hash"))
    n = rules.occurrence(["name"], "doc_id")
    return x.withColumn("n", n).select("doc_id", "family", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat_ws("-", "name", "n")).alias("file"), "content_hash")


BUILD_SQL = rf"""WITH x AS (SELECT doc_id, CASE WHEN contains(text, 'License') THEN 'licence' WHEN contains(text, '|') THEN 'table' ELSE 'article' END AS family,
regexp_replace(regexp_replace({SQL_FOLD.format("left(text, 12)")}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS name, sha256(text || '{{"lang":"' || lang || '","source":"' || source || '"}}') AS content_hash
FROM documents WHERE length(text) >= 60 AND lower(trim(text)) <> 'test'), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS n FROM x)
SELECT doc_id, family, CASE n WHEN 1 THEN name ELSE name || '-' || n END AS file, content_hash FROM n"""


def toc_locate(spark: SparkSession, d: str) -> DataFrame:
    """Where each navigation entry of a page first occurs in its article."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1).alias("nav"), F.regexp_extract("html", "(?s)<article>(.*)</article>", 1).alias("article"))
    e = p.select("page_id", "article", F.posexplode(F.regexp_extract_all("nav", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))).alias("at", "entry"))
    return e.select("page_id", "at", "entry", F.instr("article", F.col("entry")).alias("found_at"))


TOC_SQL = """WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS article FROM pages),
e AS (SELECT page_id, article, unnest(regexp_extract_all(nav, '<a href="[^"]*">([^<]*)</a>', 1)) AS entry, generate_subscripts(regexp_extract_all(nav, '<a href="[^"]*">([^<]*)</a>', 1), 1) - 1 AS k FROM p)
SELECT page_id, k::INT AS "at", entry, instr(article, entry)::INT AS found_at FROM e"""


def target_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Links to pages: exact URL first, then the last part of the path; the rest is missing. Links are the pages' own URLs, altered by rule."""
    p = table(spark, d, "pages").select("page_id", "url")
    link = F.when(F.col("page_id") % 3 == 0, F.regexp_replace(T.same_url(F.col("url")), "^https://", "http://")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://elsewhere.example/"), T.url_slug(F.col("url")))).otherwise(F.lit("https://nowhere.example/none"))
    links = p.select(F.col("page_id").alias("link_id"), link.alias("link"))
    exact = p.groupBy(T.same_url(F.col("url")).alias("u")).agg(F.min("page_id").alias("by_url"))
    slug = p.groupBy(T.url_slug(F.col("url")).alias("s")).agg(F.min("page_id").alias("by_slug"))
    x = links.join(exact, T.same_url(F.col("link")) == F.col("u"), "left").join(slug, F.col("by_url").isNull() & (T.url_slug(F.col("link")) == F.col("s")), "left")
    return x.select("link_id", F.coalesce("by_url", "by_slug").alias("page_id"), F.when(F.col("by_url").isNotNull(), "url").when(F.col("by_slug").isNotNull(), "slug").otherwise("missing").alias("how"))


_same = "regexp_replace(regexp_replace(lower(trim({0})), '^http://', 'https://'), '/+$', '')"
_slug = "string_split(" + _same.format("regexp_replace({0}, '[#?].*$', '')") + ", '/')[-1]"
RESOLUTION_SQL = f"""WITH l AS (SELECT page_id AS link_id, CASE page_id % 3 WHEN 0 THEN regexp_replace({_same.format("url")}, '^https://', 'http://') WHEN 1 THEN 'https://elsewhere.example/' || {_slug.format("url")} ELSE 'https://nowhere.example/none' END AS link FROM pages),
e AS (SELECT {_same.format("url")} AS u, min(page_id) AS by_url FROM pages GROUP BY 1), s AS (SELECT {_slug.format("url")} AS s, min(page_id) AS by_slug FROM pages GROUP BY 1)
SELECT link_id, coalesce(by_url, by_slug) AS page_id, CASE WHEN by_url IS NOT NULL THEN 'url' WHEN by_slug IS NOT NULL THEN 'slug' ELSE 'missing' END AS how
FROM l LEFT JOIN e ON {_same.format("link")} = u LEFT JOIN s ON by_url IS NULL AND {_slug.format("link")} = s.s"""

QUERIES = {
    "line_sections": (line_sections, LINES_SQL),
    "section_sizes": (section_sizes, SIZES_SQL),
    "chunk_links": (chunk_links, CHAIN_SQL),
    "chunk_blocks": (chunk_blocks, BLOCKS_SQL),
    "chunk_pack": (chunk_pack, PACK_SQL),
    "parent_probe": (parent_probe, PROBE_SQL),
    "section_render": (section_render, RENDER_SQL),
    "section_annotate": (section_annotate, ANNOTATE_SQL),
    "chunk_tree": (chunk_tree, None),
    "node_counts": (node_counts, COUNTS_SQL),
    "section_rules": (section_rules, RULES_SQL),
    "precedence_merge": (precedence_merge, PRECEDENCE_SQL),
    "entity_match": (entity_match, ENTITY_SQL),
    "node_projection": (node_projection, PROJECTION_SQL),
    "embed_and_lexical_text": (embed_and_lexical_text, EMBED_SQL),
    "tree_propagation": (tree_propagation, PROPAGATION_SQL),
    "doc_rollup": (doc_rollup, ROLLUP_SQL),
    "build_rows": (build_rows, BUILD_SQL),
    "toc_locate": (toc_locate, TOC_SQL),
    "target_resolution": (target_resolution, RESOLUTION_SQL),
}
