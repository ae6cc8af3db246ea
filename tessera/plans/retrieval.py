"""Retrieval queries: BM25, dense search, fusion, filters, de-duplication, rescue, parents, diversity, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import text_key, tokens
from ..operators import lexical, ranking, vectors
from ..sources.files import scratch, stored
from .common import SQL_KEY, SQL_TOKENS, table

POOL, TOP, FETCH = 30, 10, 25


def _index(spark: SparkSession, d: str) -> lexical.Index:
    return lexical.index(table(spark, d, "documents"), "doc_id", F.col("text"), ("lang",))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def _lexical_hits(spark: SparkSession, d: str, k: int, langs: tuple[str, ...] = ()) -> DataFrame:
    """The k best documents of each item, in some languages or all, with the statistics of the whole collection."""
    return lexical.top_k(lexical.bm25(_index(spark, d), _asked(spark, d), "item_id", {"lang": list(langs)}, most=k), "item_id", "doc_id", k)


def _written(hits: DataFrame) -> DataFrame:
    """A cut list of hits, written: few beside the documents. A join with documents then knows its size and leaves the documents where they lie, unless the hits are many."""
    return stored(hits, scratch(hits.sparkSession, "hits") + "/rows")


def _found(spark: SparkSession, d: str, k: int) -> DataFrame:
    return _written(_lexical_hits(spark, d, k))


def _several(of: lexical.Index, asked: DataFrame, k: int) -> DataFrame:
    """item_id, list, doc_id, score, rank: the k best documents of each list of an item, all lists in one pass over the index. asked: item_id, list, term, lang (null: any language)."""
    words = asked.select(F.struct("item_id", "list").alias("ask"), "term", "lang")
    return lexical.top_k(lexical.bm25(of, words, "ask", most=k, group="lang"), "ask", "doc_id", k).select("ask.*", "doc_id", "score", "rank")


SQL_HITS = f"""tok AS (SELECT doc_id, unnest({SQL_TOKENS.format("text")}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, len({SQL_TOKENS.format("text")}) AS dl FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT item_id, unnest({SQL_TOKENS.format("text")}) AS term FROM benchmark),
sc AS (SELECT item_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY ALL),
hits AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc),
pool AS (SELECT * FROM hits WHERE rank <= {POOL})"""


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _lexical_hits(spark, d, TOP).select("item_id", "rank", "doc_id", "score")


BM25_SQL = f"WITH {SQL_HITS} SELECT item_id, rank, doc_id, score FROM hits WHERE rank <= {TOP}"


def filtered_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The filter is below the top-k: only documents in French or Spanish are candidates, with statistics of the whole collection."""
    return _lexical_hits(spark, d, TOP, ("fr", "es")).select("item_id", "rank", "doc_id", "score")


def _where(condition: str) -> str:
    return SQL_HITS.replace("CROSS JOIN st GROUP BY ALL", f"CROSS JOIN st WHERE doc_id IN (SELECT doc_id FROM documents WHERE {condition}) GROUP BY ALL")


FILTERED_SQL = f"""WITH {_where("lang IN ('fr', 'es')")} SELECT item_id, rank, doc_id, score FROM hits WHERE rank <= {TOP}"""


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(None).cast("string").alias("g"))
    q = e.filter("id % 100 = 0").select(F.col("id").alias("query"), "v", "g")
    return vectors.cosine_top_k(e, q, TOP, same=True)


SQL_COS = """q AS (SELECT vec_id AS query, label, embedding::DOUBLE[] AS u FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query, q.label AS g, vec_id AS id, e.label, round(list_cosine_similarity(u, embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings e ON vec_id <> query)"""
COSINE_SQL = f"WITH {SQL_COS} SELECT * FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {TOP}"


def filtered_hybrid_boost(spark: SparkSession, d: str) -> DataFrame:
    """The intent filter is a vote: the filtered and the free list are both fused."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("string").alias("g"))
    q = e.filter("id % 100 = 0").select(F.col("id").alias("query"), "v", "g")
    free = vectors.cosine_top_k(e, q.withColumn("g", F.lit(None).cast("string")), POOL, same=True)
    own = vectors.cosine_top_k(e, q, POOL, same=True)
    return lexical.top_k(ranking.fuse(free.unionByName(own), "query", "id"), "query", "id", TOP)


BOOST_SQL = f"""WITH {SQL_COS},
a AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s),
b AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s WHERE g = label),
f AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM a WHERE rank <= {POOL} UNION ALL SELECT * FROM b WHERE rank <= {POOL}) GROUP BY ALL)
SELECT * FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= {TOP}"""


def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    e = vectors.hashed_embedding(table(spark, d, "documents"), "doc_id", F.col("text"))
    return e.select("doc_id", F.posexplode("embedding").alias("bucket", "n")).filter("n > 0").select("doc_id", "bucket", F.col("n").cast("long").alias("n"))


def _buckets(key: str, of: str) -> str:
    return f"SELECT {key}, (('0x' || right(md5(w), 2))::INT % 64) AS bucket, count(*) AS n FROM (SELECT {key}, unnest({SQL_TOKENS.format('text')}) AS w FROM {of}) GROUP BY ALL"


def _dense(spark: SparkSession, d: str) -> DataFrame:
    """id, v, g (its language): the stored embeddings of documents."""
    e = vectors.hashed_index(table(spark, d, "documents"), "doc_id", F.col("text"), ("lang",))
    return e.select(F.col("doc_id").alias("id"), F.col("embedding").alias("v"), F.col("lang").alias("g"))


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """BM25 and hashed-embedding rankings of each benchmark item over all documents, fused."""
    e = _dense(spark, d).withColumn("g", F.lit(None).cast("string"))
    q = vectors.hashed_index(table(spark, d, "benchmark"), "item_id", F.col("text")).select(F.col("item_id").alias("query"), F.col("embedding").alias("v"), F.lit(None).cast("string").alias("g"))
    dense = vectors.cosine_top_k(e, q, POOL).select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "rank")
    both = dense.unionByName(_lexical_hits(spark, d, POOL).select("item_id", "doc_id", "rank"))
    return lexical.top_k(ranking.fuse(both, "item_id", "doc_id"), "item_id", "doc_id", TOP)


SQL_DENSE = f"""db AS ({_buckets("doc_id", "documents")}), qb AS ({_buckets("item_id", "benchmark")}),
dn AS (SELECT doc_id, sqrt(sum(n * n)) AS dn FROM db GROUP BY ALL), qn AS (SELECT item_id, sqrt(sum(n * n)) AS qn FROM qb GROUP BY ALL),
cs AS (SELECT item_id, doc_id, round(any_value(dot) / (any_value(dn) * any_value(qn)), 6) AS score
  FROM (SELECT item_id, doc_id, sum(db.n * qb.n) AS dot FROM db JOIN qb USING (bucket) GROUP BY ALL) JOIN dn USING (doc_id) JOIN qn USING (item_id) GROUP BY ALL)"""
HYBRID_SQL = f"""WITH {SQL_HITS}, {SQL_DENSE},
ds AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM cs),
f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT item_id, doc_id, rank FROM ds WHERE rank <= {POOL} UNION ALL SELECT item_id, doc_id, rank FROM pool) GROUP BY ALL)
SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= {TOP}"""


def _pool(spark: SparkSession, d: str) -> DataFrame:
    """BM25 hits with the source as the document they belong to and the key of their text."""
    docs = table(spark, d, "documents").select("doc_id", "source", text_key(F.col("text")).alias("text_key"))
    return _found(spark, d, POOL).join(docs, "doc_id")


SQL_POOL = f"{SQL_HITS}, ph AS (SELECT pool.*, source, {SQL_KEY.format('text')} AS text_key FROM pool JOIN documents USING (doc_id))"


def dedupe_text_hash(spark: SparkSession, d: str) -> DataFrame:
    return ranking.keep_first(_pool(spark, d), "item_id", F.col("text_key")).filter(F.col("rank") <= POOL).select("item_id", "rank", "doc_id", "text_key")


DEDUPE_SQL = f"WITH {SQL_POOL} SELECT item_id, rank, doc_id, text_key FROM ph QUALIFY row_number() OVER (PARTITION BY item_id, text_key ORDER BY rank) = 1"


def keep_max_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two lists of each item (all documents; one language only) merged by the best score, first seen on ties."""
    lang = F.array(F.lit(None).cast("string"), F.lit("en"))
    asked = _asked(spark, d).select("item_id", "term", F.posexplode(lang).alias("list", "lang"))
    hits = _several(_index(spark, d), asked, POOL).withColumn("position", F.col("list") * 1000 + F.col("rank"))
    out = ranking.keep_max(hits, "item_id", "doc_id")
    return out.select("item_id", "doc_id", "score", "list", "rank")


SQL_EN = _where("lang = 'en'")
KEEP_MAX_SQL = f"""WITH a AS (WITH {SQL_HITS} SELECT item_id, doc_id, score, 0 AS list, rank FROM pool),
b AS (WITH {SQL_EN} SELECT item_id, doc_id, score, 1 AS list, rank FROM pool)
SELECT item_id, doc_id, score, list, rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, list, rank) = 1"""


def rescue_top_docs(spark: SparkSession, d: str) -> DataFrame:
    """Kept are the three best hits; rescued the best hits of the five best sources that have none there."""
    hits = _pool(spark, d)
    out = ranking.rescue(hits, hits.filter("rank <= 3"), "item_id", "source", 5)
    return out.select("item_id", "source", "doc_id", "rank", "doc_rank")


RESCUE_SQL = f"""WITH {SQL_POOL},
best AS (SELECT * FROM ph QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY rank) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS doc_rank FROM best)
SELECT item_id, source, doc_id, rank, doc_rank FROM r WHERE doc_rank <= 5 AND NOT EXISTS (SELECT 1 FROM ph WHERE ph.item_id = r.item_id AND ph.source = r.source AND ph.rank <= 3)"""


def diversity_select(spark: SparkSession, d: str) -> DataFrame:
    hits = _pool(spark, d).select("item_id", "rank", F.col("doc_id").alias("key"), F.col("source").alias("doc"), "text_key", "score")
    out = ranking.diversify(hits, "item_id", top_n=8, per_doc=2, threshold=1.0)
    return out.select("item_id", "position", F.col("key").alias("doc_id"), F.col("doc").alias("source"), "rank")


DIVERSITY_SQL = f"""WITH {SQL_POOL}, l AS (SELECT item_id, list({{'rank': rank, 'doc_id': doc_id, 'source': source, 'text_key': text_key, 'score': score}} ORDER BY rank) AS xs FROM ph GROUP BY item_id),
f AS (SELECT item_id, list_reduce(xs, lambda acc, x: CASE WHEN x.score >= 1 AND len(acc) < 8 AND NOT list_contains(list_transform(acc, lambda k: k.text_key), x.text_key) AND len(list_filter(acc, lambda k: k.source = x.source)) < 2
  THEN list_append(acc, x) ELSE acc END, []::STRUCT(rank BIGINT, doc_id BIGINT, source VARCHAR, text_key VARCHAR, score DOUBLE)[]) AS xs FROM l),
u AS (SELECT item_id, generate_subscripts(xs, 1) AS position, unnest(xs) AS x FROM f) SELECT item_id, position::INT AS position, x.doc_id, x.source, x.rank FROM u"""


def parent_join(spark: SparkSession, d: str) -> DataFrame:
    """Small to big: hits get the size of their parent, a section node per source and language; document nodes do not count."""
    docs = table(spark, d, "documents")
    parent = F.concat_ws("/", "source", "lang")
    nodes = docs.groupBy(parent.alias("node_id")).agg(F.lit("section").alias("level"), F.min("text").alias("text"), F.sum("n_chars").alias("token_count"))
    hits = _found(spark, d, TOP).join(docs.select("doc_id", parent.alias("parent_id")), "doc_id")
    out = ranking.with_parents(hits, nodes.withColumn("level", F.when(F.col("node_id").endswith("/en"), "document").otherwise(F.col("level"))))
    return out.select("item_id", "rank", "doc_id", "parent_id", F.md5("parent_text").alias("parent_md5"), "parent_tokens")


PARENT_SQL = f"""WITH {SQL_HITS}, n AS (SELECT source || '/' || lang AS node_id, min(text) AS text, sum(n_chars)::BIGINT AS token_count FROM documents GROUP BY ALL)
SELECT item_id, rank, doc_id, d.source || '/' || d.lang AS parent_id, md5(n.text) AS parent_md5, n.token_count AS parent_tokens
FROM hits JOIN documents d USING (doc_id) LEFT JOIN n ON node_id = d.source || '/' || d.lang AND node_id NOT LIKE '%/en' WHERE rank <= {TOP}"""


def source_numbering(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.number_sources(_pool(spark, d).filter(F.col("rank") <= TOP), "item_id", "doc_id", F.col("source"), "rank")
    return out.select("item_id", F.col("source").alias("label"), "first", F.array_join("members", ",").alias("members"))


SOURCES_SQL = f"""WITH {SQL_POOL}, g AS (SELECT item_id, source, min(rank) AS first, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS members FROM ph WHERE rank <= {TOP} GROUP BY ALL)
SELECT item_id, 'S' || row_number() OVER (PARTITION BY item_id ORDER BY first) AS label, first, members FROM g"""


def rerank_order(spark: SparkSession, d: str) -> DataFrame:
    """A stub scorer (share of the item's words that the document has, through a sigmoid) reorders the pool; ties keep the order they came in."""
    docs = table(spark, d, "documents").select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("dw"))
    items = table(spark, d, "benchmark").select("item_id", F.array_distinct(tokens(F.col("text"))).alias("qw"))
    hits = _found(spark, d, POOL).join(docs, "doc_id").join(items, "item_id")
    x = F.size(F.array_intersect("qw", "dw")) / F.size("qw")
    hits = hits.withColumn("rerank_score", F.round(1 / (1 + F.exp(-(x * 8 - 4))), 6))
    return lexical.top_k(hits.withColumnRenamed("rank", "was"), "item_id", "was", TOP, "rerank_score").select("item_id", "rank", "doc_id", "rerank_score", "was")


RERANK_SQL = f"""WITH {SQL_HITS},
d AS (SELECT doc_id, list_distinct({SQL_TOKENS.format("text")}) AS dw FROM documents), q AS (SELECT item_id, list_distinct({SQL_TOKENS.format("text")}) AS qw FROM benchmark),
s AS (SELECT item_id, doc_id, rank AS was, round(1 / (1 + exp(-(len(list_intersect(qw, dw)) / len(qw) * 8 - 4))), 6) AS rerank_score FROM pool JOIN d USING (doc_id) JOIN q USING (item_id))
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, was) AS rank, doc_id, rerank_score, was FROM s) WHERE rank <= {TOP}"""


def search_service(spark: SparkSession, d: str) -> DataFrame:
    """One plan from request to answer: dense and lexical lists over all documents and, as a vote of the intent, over the languages it means; all four over-fetched,
    fused, one hit kept per text, then cut. The intent of an item is told by its number; items of intent 0 have none, and of intent 2 are strict: their free lists are left out."""
    docs = table(spark, d, "documents").select("doc_id", text_key(F.col("text")).alias("text_key"))
    intent = table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 3).alias("intent"), F.element_at(F.array(*map(F.lit, ("en", "fr", "de"))), (F.col("item_id") % 3 + 1).cast("int")).alias("wanted"))
    lang = F.array(F.lit(None).cast("string"), F.col("wanted"))
    lists = intent.select("item_id", "intent", F.posexplode(lang).alias("list", "lang")).filter(F.when(F.col("list") == 0, F.col("intent") != 2).otherwise(F.col("intent") != 0)).drop("intent")
    q = vectors.hashed_index(table(spark, d, "benchmark"), "item_id", F.col("text")).join(lists, "item_id")
    ask = q.select(F.struct("item_id", "list").alias("query"), F.col("embedding").alias("v"), F.col("lang").alias("g"))
    dense = vectors.cosine_top_k(_dense(spark, d), ask, FETCH).select("query.item_id", F.col("id").alias("doc_id"), "rank")
    both = dense.unionByName(_several(_index(spark, d), _asked(spark, d).join(lists, "item_id"), FETCH).select("item_id", "doc_id", "rank"))
    hits = _written(lexical.top_k(ranking.fuse(both, "item_id", "doc_id"), "item_id", "doc_id", 4 * FETCH)).join(docs, "doc_id")
    kept = ranking.keep_first(hits, "item_id", F.col("text_key")).withColumnRenamed("rank", "was")
    best = F.row_number().over(Window.partitionBy("item_id").orderBy("was"))
    return kept.withColumn("rank", best).filter(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score")


SERVICE_SQL = f"""WITH {SQL_HITS}, it AS (SELECT item_id, item_id % 3 AS intent, ['en', 'fr', 'de'][item_id % 3 + 1] AS wanted FROM benchmark),
{SQL_DENSE},
l AS (SELECT item_id, doc_id, score, 0 AS src FROM sc UNION ALL SELECT item_id, doc_id, score, 1 FROM cs),
m AS (SELECT l.*, v.own FROM l JOIN it USING (item_id) JOIN documents USING (doc_id) CROSS JOIN (VALUES (false), (true)) v(own) WHERE CASE WHEN own THEN intent <> 0 AND lang = wanted ELSE intent <> 2 END),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, src, own ORDER BY score DESC, doc_id) AS rank FROM m),
f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM r WHERE rank <= {FETCH} GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, {SQL_KEY.format("text")} AS text_key FROM f JOIN documents USING (doc_id)),
o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY item_id, text_key ORDER BY score DESC, doc_id) = 1)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM o QUALIFY rank <= {TOP}"""


QUERIES = {
    "search_service": (search_service, SERVICE_SQL),
    "bm25_topk": (bm25_topk, BM25_SQL),
    "filtered_bm25": (filtered_bm25, FILTERED_SQL),
    "cosine_topk": (cosine_topk, COSINE_SQL),
    "filtered_hybrid_boost": (filtered_hybrid_boost, BOOST_SQL),
    "hashed_embedding": (hashed_embedding, _buckets("doc_id", "documents")),
    "hybrid_rrf": (hybrid_rrf, HYBRID_SQL),
    "dedupe_text_hash": (dedupe_text_hash, DEDUPE_SQL),
    "keep_max_merge": (keep_max_merge, KEEP_MAX_SQL),
    "rescue_top_docs": (rescue_top_docs, RESCUE_SQL),
    "diversity_select": (diversity_select, DIVERSITY_SQL),
    "parent_join": (parent_join, PARENT_SQL),
    "source_numbering": (source_numbering, SOURCES_SQL),
    "rerank_order": (rerank_order, RERANK_SQL),
}
