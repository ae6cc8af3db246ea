from pyspark.sql import functions as F

from tessera.operators import dialogue, index, lexical, metrics, ranking, reports, vectors


def test_diversity_is_order_dependent(spark):
    """Four hits of one document and a twin text in another: a hit refused by the cap does not mark its text."""
    rows = [(1, i + 1, k, d, t, s) for i, (k, d, t, s) in enumerate([("A1", "A", "t1", 0.9), ("A2", "A", "t2", 0.8), ("A3", "A", "t3", 0.7), ("B1", "B", "t3", 0.6), ("A4", "A", "t4", 0.5), ("C1", "C", "t1", 0.45), ("D1", "D", "t5", 0.1)])]
    h = spark.createDataFrame(rows, "q int, rank int, key string, doc string, text_key string, score double")
    assert [r["key"] for r in ranking.diversify(h, "q", 5, 2, 0.4).orderBy("position").collect()] == ["A1", "A2", "B1"]


def test_rescue_takes_the_best_of_dropped_documents(spark):
    h = spark.createDataFrame([(1, 1, "A"), (1, 2, "A"), (1, 3, "B"), (1, 4, "C")], "q int, rank int, doc string")
    out = ranking.rescue(h, h.filter("doc = 'B'"), "q", "doc", 2).collect()
    assert [(r["doc"], r["rank"]) for r in out] == [("A", 1)]


def test_sources_are_numbered_by_first_use(spark):
    c = spark.createDataFrame([(1, 1, "a", "p2"), (1, 2, "b", "p1"), (1, 3, "c", "p2")], "q int, position int, key string, parent string")
    out = ranking.number_sources(c, "q", "key", F.col("parent")).orderBy("source").collect()
    assert [(r["source"], r["members"]) for r in out] == [("S1", ["a", "c"]), ("S2", ["b"])]


def test_parents_must_be_sections(spark):
    nodes = spark.createDataFrame([("s", "section", "S", 3), ("d", "document", "D", 9)], "node_id string, level string, text string, token_count int")
    hits = spark.createDataFrame([(1, "s"), (2, "d"), (3, None)], "k int, parent_id string")
    assert {r["k"]: r["parent_text"] for r in ranking.with_parents(hits, nodes).collect()} == {1: "S", 2: None, 3: None}


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "a2"), (2, 1, "b"), (3, 1, "z")], "q int, rank int, doc_id string").withColumn("url", F.lit(None).cast("string")).withColumn("breadcrumb", F.when(F.col("doc_id").startswith("a"), "Guide > A"))
    targets = spark.createDataFrame([(1, 0, None, "guide > a"), (2, 0, "b", None), (2, 1, "c", None), (3, 0, "y", None), (4, 0, "w", None)], "q int, target int, target_doc string, section string").withColumn("target_url", F.lit(None).cast("string"))
    m = {r["q"]: r for r in metrics.retrieval(ranked, targets, "q", (1, 3)).collect()}
    assert m[1]["mrr"] == 0.5 and m[1]["recall_1"] == 0 and m[1]["recall_3"] == 1 and m[1]["precision_3"] == round(2 / 3, 6)
    assert m[1]["ndcg_3"] == 0.63093, "the second hit on one target adds nothing"
    assert m[2]["recall_3"] == 0.5 and m[2]["precision_3"] == 1 and m[3]["mrr"] == 0 and m[4]["recall_3"] == 0


def test_refusals_with_empty_denominators(spark):
    rows = spark.createDataFrame([("a", True, False), ("a", True, True), ("a", False, True), ("a", False, False), ("b", True, False)], "g string, answerable boolean, refused boolean")
    m = {r["g"]: r for r in metrics.refusals(rows, "g").collect()}
    assert tuple(m["a"])[1:] == (0.5, 0.5, 0.5, 0.5, 0.5)
    assert m["b"]["precision"] is None and m["b"]["recall"] is None and m["b"]["accuracy"] == 1 and m["b"]["false_refusal_rate"] == 0


def test_percentiles_interpolate(spark):
    d = spark.createDataFrame([("x", v) for v in (1.0, 2.0, 3.0, 4.0, 100.0, None)], "g string, v double")
    r = reports.percentiles(d, "v", "g").first()
    assert (r["n"], r["p50"], r["p90"], r["max"]) == (5, 3.0, 61.6, 100.0)


def test_rouge_and_f1(spark):
    d = spark.createDataFrame([(1, "a b c d".split(), "a c d e".split()), (2, [], ["a"]), (3, ["x"], ["y"]), (4, "a a b".split(), "a b b".split())], "k long, a array<string>, r array<string>")
    rouge = {r["k"]: r["rouge_l"] for r in metrics.rouge_l(d, "k", F.col("a"), F.col("r")).collect()}
    f1 = {r["k"]: r["token_f1"] for r in metrics.token_f1(d, "k", F.col("a"), F.col("r")).collect()}
    assert rouge == {1: 0.75, 2: None, 3: 0.0, 4: round(2 / 3, 6)}
    assert f1 == {1: 0.75, 2: None, 3: 0.0, 4: round(2 / 3, 6)}


def test_fold_and_reset(spark):
    ev = ["n:start", "n:start", "n:end", "m:end", "m:start", "t:token", "t:token"]
    d = spark.createDataFrame([(1, i, k) for i, k in enumerate(ev)], "u int, i int, k string")
    assert tuple(dialogue.fold_events(d, "u", "i", "k").first()) == (1, 2, 1, 2)
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", dialogue.RESET, "b", "c"])] + [(2, 0, "x")], "u int, i int, v string")
    assert {r["u"]: r["items"] for r in dialogue.reduce_turns(d, "u", "i", "v").collect()} == {1: "b,c", 2: "x"}


def test_index_diff(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, h string")
    e = spark.createDataFrame([(2, "b"), (3, "old"), (4, "d")], "k int, h string")
    assert {r["k"]: r["action"] for r in index.diff(s, e, "k", "h").collect()} == {1: "new", 2: "unchanged", 3: "changed", 4: "pruned"}
    assert {r["action"] for r in index.diff(s, e, "k", "h", force=True).collect()} == {"new", "changed", "pruned"}


def test_bm25_and_cosine(spark):
    d = spark.createDataFrame([(1, "rare word here"), (2, "common word here"), (3, "common common"), (4, None)], "id long, text string")
    q = spark.createDataFrame([(9, "rare"), (9, "word")], "q long, term string")
    hits = lexical.bm25(lexical.index(d, "id", F.col("text")), q, "q")
    assert [r["id"] for r in lexical.top_k(hits, "q", "id", 5).orderBy("rank").collect()] == [1, 2]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "id long, v array<double>").withColumn("g", F.lit(None).cast("string"))
    out = vectors.cosine_top_k(v, v.filter("id = 1").select(F.col("id").alias("query"), "v", "g"), 3, block=2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in out] == [(1, 1.0), (2, 0.0), (3, 0.0)]
    e = vectors.hashed_embedding(d, "id", F.col("text")).collect()
    assert len(e) == 3 and all(len(r["embedding"]) == 64 for r in e)


def test_blocks_give_only_what_can_be_among_the_best(spark, monkeypatch):
    """Many blocks, many copies: each block hands on k hits of a query at most, and the ranking is that of all hits, computed plainly."""
    import math

    monkeypatch.setattr(lexical, "BLOCK", 60)
    texts = {i: " ".join(f"w{j}" for j in range(1, 13) if (i * 7 + j * j) % (j + 1) == 0 or i % 3 == 0) + " w1" * (i % 4) for i in range(120)} | {200: None, 201: "..."}
    d = spark.createDataFrame([(i, t, ("a", "b")[i % 2]) for i, t in texts.items()], "id long, text string, lang string")
    asked = {"x": (["w1", "w5", "nowhere"], None), "y": (["w2", "w3", "w7"], "b"), "z": (["w12"], "a")}
    q = spark.createDataFrame([(k, w, g) for k, (ws, g) in asked.items() for w in ws], "q string, term string, lang string")
    of = lexical.index(d, "id", F.col("text"), ("lang",))
    words = {i: (t or "").replace(".", "").split() for i, t in texts.items()}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df = {w: sum(w in x for x in words.values()) for ws, _ in asked.values() for w in ws}
    want = set()
    for k, (ws, g) in asked.items():
        one = lambda w, x: math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * x.count(w) * 2.2 / (x.count(w) + 1.2 * (0.25 + 0.75 * len(x) / avg))
        scores = {i: round(sum(one(w, x) for w in ws if w in x), 6) for i, x in words.items() if set(ws) & set(x) and (g is None or "ab"[i % 2] == g)}
        want |= {(k, r + 1, i, scores[i]) for r, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:4])}
    found = lexical.bm25(of, q, "q", most=4, group="lang")
    assert {(r["q"], r["rank"], r["id"], r["score"]) for r in lexical.top_k(found, "q", "id", 4).collect()} == want
    whole = lexical.top_k(lexical.bm25(of, q, "q", group="lang"), "q", "id", 4)
    assert {(r["q"], r["rank"], r["id"], r["score"]) for r in whole.collect()} == want
    blocks = -(-of.totals.first()["postings"] // 60)
    assert blocks > 5 and found.count() <= 3 * 4 * blocks
    most = {r["q"]: r["n"] for r in lexical.overlap(of, q, "q", 1).groupBy("q").agg(F.max("score").alias("n")).collect()}
    assert most == {k: max(len(set(ws) & set(x)) for x in words.values()) for k, (ws, _) in asked.items()}
    pruned = lexical.bm25(of, q, "q", {"lang": ["a"]}, d.filter("id < 50"), most=4)
    assert {r["id"] for r in pruned.collect()} <= {i for i in words if i >= 50 and i % 2 == 0}


def test_texts_reach_python_in_bounded_batches(spark):
    """Many long texts: no Arrow batch of words holds all of a part's rows."""
    from tessera.session import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    d = spark.createDataFrame([(i,) for i in range(60)], "id long").coalesce(1).select("id", F.repeat(F.concat(F.lit("word"), "id", F.lit(" other ")), 10000).alias("text"))
    for made in (lambda: lexical.index(d, "id", F.col("text")).documents, lambda: vectors.hashed_index(d, "id", F.col("text"))):
        spark.conf.unset(key)
        assert made().count() == 60 and int(spark.conf.get(key)) <= BATCH_BYTES
