"""Postings are stored in bounded blocks that stay where they lie; queries come to them in packs."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical
from tessera.plans import retrieval

TEXTS = {i: " ".join(f"w{j}" for j in range(1, 13) if (i * 7 + j * j) % (j + 1) == 0 or i % 3 == 0) + " w1" * (i % 4) for i in range(120)} | {200: None, 201: "...", 202: " ".join(f"x{j}" for j in range(300))}


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(i, t, (None, "a", "b")[i % 3]) for i, t in TEXTS.items()], "id long, text string, lang string")


@pytest.fixture()
def asked(spark):
    words = {"x": ["w1", "w5", "nowhere"], "y": ["w2", "w3", "w7"], "z": ["w12", "x5"], "none": ["nothing"]}
    return spark.createDataFrame([(k, w) for k, ws in words.items() for w in ws], "q string, term string")


@pytest.mark.parametrize("langs", [(), ("fr", "es")])
def test_postings_are_not_shuffled(spark, sf, langs):
    """bm25_topk and filtered_bm25: only the hits of each block move."""
    hits = lexical.bm25(retrieval._index(spark, sf), retrieval._asked(spark, sf), "item_id", {"lang": list(langs)}, most=10)
    assert "hashpartitioning" not in hits._jdf.queryExecution().executedPlan().toString()


def test_a_block_is_bounded_and_keeps_all(spark, docs, monkeypatch):
    """However many documents a task has, a block has about BLOCK postings, or one document that is longer."""
    monkeypatch.setattr(lexical, "BLOCK", 60)
    rows = lexical.inverted(docs.coalesce(1), "id", F.col("text"), ("lang",)).collect()
    assert len(rows) > 10 and all(len(r["places"]) < 60 + 12 or len(r["places"]) < 60 + 300 and any(d["id"] == 202 for d in r["docs"]) for r in rows)
    got = {}
    for r in rows:
        assert [d["id"] for d in r["docs"]] == sorted(d["id"] for d in r["docs"]) and sum(r["dfs"]) == len(r["places"]) == len(r["tfs"]) and len(set(r["terms"])) == len(r["terms"]) == len(r["dfs"])
        terms = [t for t, n in zip(r["terms"], r["dfs"], strict=True) for _ in range(n)]
        for d in r["docs"]:
            got[d["id"]] = (d["lang"], d["dl"], {})
        for t, p, n in zip(terms, r["places"], r["tfs"], strict=True):
            got[r["docs"][p]["id"]][2][t] = n
    words = {i: (t or "").replace(".", "").split() for i, t in TEXTS.items()}
    assert got == {i: ((None, "a", "b")[i % 3], len(ws), {w: ws.count(w) for w in ws}) for i, ws in words.items()}


@pytest.mark.parametrize("langs", [[], ["a"], ["a", "b"], ["none"]])
def test_packs_and_pruning_give_the_same_hits(spark, docs, asked, monkeypatch, langs):
    """Many packs over many blocks, with a filter and deleted documents, against one block and hits that are pruned afterwards."""
    whole = lexical.index(docs, "id", F.col("text"), ("lang",))
    dead = docs.filter("id % 5 = 0").select("id")
    plain = lexical.bm25(whole, asked, "q").join(docs.select("id", "lang"), "id").join(dead, "id", "left_anti")
    want = {tuple(r) for r in (plain.filter(F.col("lang").isin(langs)) if langs else plain).select("q", "id", "score").collect()}
    monkeypatch.setattr(lexical, "BLOCK", 60)
    monkeypatch.setattr(lexical, "PACK", 3)
    of = lexical.index(docs.filter("id >= 0"), "id", F.col("text"), ("lang",))
    assert of.blocks.count() > 10
    got = [tuple(r) for r in lexical.bm25(of, asked, "q", {"lang": langs}, dead).select("q", "id", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == want and bool(want) == (langs != ["none"])
