"""Each stage against a plain version on what the stage before it kept."""

from collections import Counter, defaultdict

import corpus_pipeline
from helpers import documents, hard_rows, words
from test_jaccard_join import brute as near, family
from test_quality_rules import brute as measure
from test_suffix_dedup import brute as repeats
from tessera.llm import mixing, packing, quality_rules
from tessera.llm.common import durable


def test_stages(spark):
    passage = words(70, 80)
    rows = hard_rows() + [(100 + i, t, "a") for i, t in enumerate(family(3, 30, 100, 5))] + [(200 + i, words(200 + i, 60 + i) + " " + passage, f"s{i % 3}") for i in range(60)]
    rows += [(400 + i, "same words again and again " * 20, "a") for i in range(5)]
    docs = documents(spark, rows)
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 == len(set(names))
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = durable(stage(spark, docs, ""), "test")
        if k < 4:
            assert out.columns == docs.columns
        seen.append((docs.collect(), out.collect()))
        docs = out

    def good(t):
        m = measure(t)
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        return not failed and not any(100 * m[f"dup_chars_{k}"] > v * m["word_chars"] for k, v in quality_rules.NGRAM_LIMITS.items()) and 100 * m["dup_line_chars"] <= quality_rules.LINE_LIMIT * m["word_chars"]

    a, b = seen[0]
    assert Counter((r["doc_id"], r["text"]) for r in b) == Counter((r["doc_id"], r["text"]) for r in a if good(r["text"]))
    a, b = seen[1]
    assert Counter(r["doc_id"] for r in b) == Counter({c for _, c, _ in near([(r["doc_id"], r["text"], r["source"]) for r in a])})
    a, b = seen[2]
    spans = repeats([r["text"] for r in a])
    left = {r["doc_id"]: len(r["text"].encode()) - sum(e - x for x, e in s) for r, s in zip(a, spans, strict=True)}
    assert {r["doc_id"]: r["n_chars"] for r in b} == {r["doc_id"]: len(r["text"]) for r in b}
    assert all(0 <= len(r["text"].encode()) - left[r["doc_id"]] <= 6 for r in b) and len(a) == len(b)
    assert all(passage[:300] not in r["text"] for r in b)
    a, b = seen[3]
    copies = Counter((r["doc_id"], r["text"]) for r in b)
    total, taken = defaultdict(int), defaultdict(int)
    for r in a:
        assert copies[r["doc_id"], r["text"]] <= 2
        total[r["source"]] += len(r["text"].split())
        taken[r["source"]] += len(r["text"].split()) * copies[r["doc_id"], r["text"]]
    assert sum(copies.values()) == len(b) and all(taken[s] <= 2 * n for s, n in total.items())
    want = {r["source"]: r["target"] for r in mixing.plan(documents(spark, [(r["doc_id"], r["text"], r["source"]) for r in a])).collect()}
    longest = {s: max(len(r["text"].split()) for r in a if r["source"] == s) for s in want}
    assert all(abs(taken[s] - t) <= longest[s] for s, t in want.items())
    a, b = seen[4]
    assert sum(r["piece_size"] for r in b) == sum(len(r["text"].split()) for r in a)
    bins = defaultdict(list)
    for r in b:
        bins[r["bin_id"]].append(r)
    assert all(sum(r["piece_size"] for r in x) <= packing.CAPACITY and len({r["source"] for r in x}) == len(x) for x in bins.values())


def test_run_makes_the_same_rows_again(spark, sf):
    a, b = (Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) for _ in "ab")
    assert a == b and a


def test_empty_table(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, ""), "test")
        assert docs.count() == 0
