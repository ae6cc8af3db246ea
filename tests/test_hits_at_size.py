"""What is joined with a collection is written first, so that its size is known; several lists of an item take one pass."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical, vectors
from tessera.plans import registry, retrieval


@pytest.mark.parametrize("name", "rerank_order rescue_top_docs context_format dedupe_text_hash source_numbering diversity_select grounded_answers answer_outline search_service parent_join provider_rerank".split())
def test_hits_are_a_small_table_where_they_meet_the_documents(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS block#" not in plan, "postings are scored before the join, and once"


@pytest.mark.parametrize(("name", "dense"), [("keep_max_merge", 0), ("search_service", 1)])
def test_lists_of_an_item_take_one_pass(spark, sf, monkeypatch, name, dense):
    seen = []
    for of, step in ((lexical, "bm25"), (vectors, "cosine_top_k")):
        monkeypatch.setattr(of, step, lambda *a, f=getattr(of, step), step=step, **k: seen.append(step) or f(*a, **k))
    registry.queries()[name](spark, sf)
    assert sorted(seen) == ["bm25"] + ["cosine_top_k"] * dense


def test_lists_of_an_item_equal_single_searches(spark, sf):
    """Also for documents and items without words, and a language no document has."""
    of, asked = retrieval._index(spark, sf), retrieval._asked(spark, sf)
    lists = asked.withColumn("list", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("lang", F.element_at(F.array(F.lit(None).cast("string"), F.lit("en"), F.lit("none")), F.col("list") + 1))
    got = {tuple(r) for r in retrieval._several(of, lists, 5).select("list", "item_id", "rank", "doc_id", "score").collect()}
    one = lambda k, langs: {(k, *r) for r in retrieval._lexical_hits(spark, sf, 5, langs).select("item_id", "rank", "doc_id", "score").collect()}
    assert got == one(0, ()) | one(1, ("en",)) and got


def test_dense_lists_keep_the_type_of_their_query(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 2.0], "b"), (3, [1.0, 1.0], "b")], "id long, v array<double>, g string")
    q = spark.createDataFrame([(9, 0, [1.0, 0.0], None), (9, 1, [1.0, 0.0], "b")], "item long, list int, v array<double>, g string").select(F.struct("item", "list").alias("query"), "v", "g")
    out = vectors.cosine_top_k(v, q, 2, block=2).select("query.*", "rank", "id")
    assert {tuple(r) for r in out.collect()} == {(9, 0, 1, 1), (9, 0, 2, 3), (9, 1, 1, 3), (9, 1, 2, 2)}


def test_postings_stay_where_they_lie_when_terms_are_few(spark):
    """The terms' size is known even where the plan cannot tell it."""
    d = spark.createDataFrame([(1, "a b"), (2, "b c")], "id long, text string")
    wide = spark.range(2000).crossJoin(spark.range(2000).withColumnRenamed("id", "j")).filter("id = 5 AND j = 7").select(F.lit("b").alias("term")).distinct()
    found = lexical.index(d, "id", F.col("text")).frequencies(wide)
    assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("b", 2)]
