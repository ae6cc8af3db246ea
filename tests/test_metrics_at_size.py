"""Metric queries on tables of their own: shingles by place, and what is scored or compared only once."""

import re

from tessera.operators import lexical
from tessera.plans import evaluation, texts
from tessera.sources import files


def test_shingles_are_counted_by_place_and_words_told_once(spark, tmp_path):
    d = str(tmp_path)
    docs = {1: "a b c d e f", 2: "A b c d a b c d a b c d", 3: "b c d", 4: None, 5: "", 6: "x " * 5000 + "c d e f", 7: "a b. C, d"}
    asked = {10: "a b c d e", 11: "x x x x x x", 12: "c d e", 13: None, 14: "a b c d a b c d"}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(asked.items()), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    def grams(text):
        w = re.findall(r"\w+", (text or "").lower())
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}

    want = set()
    for k, q in asked.items():
        for i, t in docs.items():
            shared, of = len(grams(q) & grams(t)), len(grams(q))
            if shared:
                want.add((k, i, shared, round(shared / of, 6), shared >= 0.8 * of))
    out = texts.shingle_overlap(spark, d)
    assert {tuple(r) for r in out.select("item_id", "doc_id", "shared", "coverage", "covered").collect()} == want and len(want) >= 6
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan, "a text's shingles are no list"
    words = [line for line in plan.splitlines() if "regexp_extract_all" in line]
    assert len(words) == 3 and not any("Filter" in line for line in words), "documents once, items for their shingles and sizes"


def test_documents_are_compared_and_scored_once_for_all_metrics(spark, sf, monkeypatch):
    """Whatever asks for an item's targets or hits inside one query shares one pass over the documents."""
    seen = []
    score = lexical.bm25
    monkeypatch.setattr(lexical, "bm25", lambda *a, **k: seen.append("scored") or score(*a, **k))
    for name in ("metric_breakdown", "eval_row", "cause_histogram"):
        monkeypatch.setattr(files, "_made", {})
        seen.clear()
        plan = getattr(evaluation, name)(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert seen == ["scored"], name
        assert not re.search(r"xxhash64\((element_at\()?w#", plan), f"{name}: shingles are compared before, once"
