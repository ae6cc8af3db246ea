import numpy as np
from helpers import documents, hard_rows, words
from tessera.llm import quality_model as Q


def test_interactions_are_learned():
    r = np.random.default_rng(0)
    x = r.random((4000, len(Q.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = Q.Additive(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.9
    assert (1, 0) in m.pairs


def test_held_out_accuracy(spark, sf):
    p = Q.op9_quality_model(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = p[p.held_out]
    assert len(held) > 10 and (held.predicted == held.quality).mean() > 0.85
    assert p.score.between(0, 1).all()


def test_hard_rows_and_few_labels(spark):
    rows = hard_rows() + [(100 + i, words(i, 60), "a") for i in range(30)] + [(200 + i, "$$$ ### | " * 20, "a") for i in range(30)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, 1 if i < 200 else 0) for i, _, _ in rows if i and i >= 100] + [(1, None)], "doc_id long, quality int")
    m = Q.fit(docs, labels)
    out = Q.measured(docs, ["doc_id"], model=m).collect()
    assert len(out) == len(rows)
    assert all((r["score"] > 0.5) == (r["doc_id"] < 200) for r in out if (r["doc_id"] or 0) >= 100)
    again = Q.measured(docs.repartition(5), ["doc_id"], model=Q.fit(docs.repartition(3), labels)).collect()
    assert sorted((r["doc_id"] or 0, r["score"]) for r in again) == sorted((r["doc_id"] or 0, r["score"]) for r in out)
    none = Q.fit(docs, labels.limit(0))
    assert set(none.score(Q.features(["", "a b"])).tolist()) == {0.5}


def test_repeated_rows_count_once_and_the_bound_holds(spark):
    """Copies of a labelled row change nothing, under any partitioning; the fit equals one on the rows chosen by hash in plain Python."""
    rows = [(i, words(i, 40 + i) if i % 2 else "## | $$ " * (20 + i), "a") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i, _, _ in rows] * 2, "doc_id long, quality int")
    probe = Q.features([t for _, t, _ in rows])
    plain = Q.fit(documents(spark, rows), labels).score(probe)
    copied = documents(spark, rows + rows[:5] * 50)
    for n in (1, 3, 8):
        assert np.array_equal(Q.fit(copied.repartition(n), labels.repartition(n)).score(probe), plain)
    x, y = probe, np.array([i % 2 for i, _, _ in rows], float)
    order = np.lexsort((*x.T, y))
    assert np.array_equal(Q.Additive(x[order], y[order]).score(probe), plain)
    less = [Q.fit(copied.repartition(n), labels, most=20).score(probe) for n in (1, 4)]
    assert np.array_equal(*less) and not np.array_equal(less[0], plain)


def test_scores_equal_a_plain_sum_of_table_entries(spark, sf):
    import pyarrow.parquet as pq

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    m = Q.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in Q.measured(docs, ["doc_id"], model=m).collect()}
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    for i, text in list(zip(t["doc_id"], t["text"], strict=True))[:60]:
        f = Q.features([text])[0]
        total = m.bias + sum(table[sum(v >= e for e in edges)] for v, edges, table in zip(f, m.edges, m.tables, strict=True))
        at = [sum(v >= e for e in edges) for v, edges in zip(f, m.pair_edges, strict=True)]
        total += sum(g[at[a], at[b]] for (a, b), g in zip(m.pairs, m.grids, strict=True))
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-9


def test_empty_table(spark):
    m = Q.Additive(np.zeros((0, len(Q.FEATURES))), np.zeros(0))
    assert Q.measured(documents(spark, []), ["doc_id"], model=m).count() == 0
