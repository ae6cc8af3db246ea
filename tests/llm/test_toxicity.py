import re

import numpy as np
import pytest
from helpers import documents, hard_rows
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.common import read
from tessera.llm.quality_model import fold

TEXTS = ["You IDIOT, idiots!", "", None, "réeux Réeuxa é x", "sh*t happ@ns", "NOOOO WAY THIS IS SHOUTED!", "plain words only here", "a\x00b <|endoftext|>", "stoooop it", "idiot " * 40 + "fine " * 80]


def plain_words(x):
    return [w.encode() for w in re.findall("[a-z\x80-\U0010ffff]+", (x or "").lower())]


def plain_terms(x):
    out = {}
    for i, w in enumerate(plain_words(x)):
        for kind, n in enumerate(toxicity.KINDS):
            if len(w) >= n:
                out.setdefault((kind, w[: n or len(w)]), []).append(i)
    return out


def raw(texts):
    return [None if x is None else x.encode() for x in texts]


@pytest.mark.parametrize("stretch", [None, 16])
def test_terms_equal_plain_ones(monkeypatch, stretch):
    """Two terms have one number exactly if they are one term; long texts are worked in stretches."""
    from tessera.llm import ragged

    whole = {}
    t = toxicity.words(raw(TEXTS))
    for kind, h, at in toxicity.terms(t):
        for x, w in zip(h.tolist(), at.tolist(), strict=True):
            word = t.buf[t.w0[w] : t.w1[w]].tobytes()
            whole.setdefault(x, set()).add((kind, word[: toxicity.KINDS[kind] or len(word)]))
    assert all(len(v) == 1 for v in whole.values())
    assert {next(iter(v)) for v in whole.values()} == {k for x in TEXTS for k in plain_terms(x)}
    if stretch:
        monkeypatch.setattr(ragged, "STRETCH", stretch)
        t = toxicity.words(raw(TEXTS))
        assert {x for _, h, _ in toxicity.terms(t) for x in h.tolist()} == set(whole)


def test_votes_of_lexica_and_patterns():
    t = toxicity.words(raw(["idiot"]))
    keys = np.sort(np.array([h[0] for kind, h, _ in toxicity.terms(t) if kind == 0], np.uint64))
    model = toxicity.Toxicity(keys, np.ones(1, bool))
    v = model.votes(raw(TEXTS))
    first = v[:, : toxicity.PARTS]  # whole words, by thirds of the text
    assert first[0].tolist() == [0, 1, 0]  # you | idiot | idiots: parts too short to be silent
    assert first[-1].tolist() == [1, -1, -1]
    patterns = v[:, -4:-1]
    assert [np.flatnonzero(p).tolist() for p in patterns] == [[], [], [], [], [1], [0, 2], [], [], [2], []]
    assert v[-1, -1] == 1 and v[0, -1] == 0 and v[1].tolist() == [0] * toxicity.VOTERS


def simulated(n=40_000, rate=0.12, seed=1):
    """Nine voters; the first two nearly repeat each other, the last one guesses."""
    r = np.random.default_rng(seed)
    y = r.random(n) < rate
    hit, miss = np.array([0.8, 0.8, 0.9, 0.7, 0.85, 0.75, 0.9, 0.6, 0.5]), np.array([0.05, 0.05, 0.02, 0.1, 0.03, 0.05, 0.2, 0.02, 0.5])
    v = np.where(r.random((n, 9)) < np.where(y[:, None], hit, miss), 1, -1)
    copy = r.random(n) < 0.7
    v[copy, 1] = v[copy, 0]
    v[r.random((n, 9)) < 0.1] = 0
    return y, v, hit, miss


def test_label_model_finds_accuracies_and_correlations_without_labels():
    y, v, hit, miss = simulated()
    a = np.abs(v)
    model = toxicity.LabelModel(0.12, a.T @ a, v.T @ a, v.T @ v)
    assert np.abs(model.hit - hit)[:-1].max() < 0.05 and np.abs(model.miss - miss)[:-1].max() < 0.02
    assert abs(model.hit[-1] - model.miss[-1]) < 0.05
    assert model.edges == [(1, 0)] and abs(model.rho[0] - 0.7) < 0.1
    p = model.posterior(v)
    ordinary = [p[(p > low) & (p <= low + 0.2)].mean() - y[(p > low) & (p <= low + 0.2)].mean() for low in (0.0, 0.2, 0.4, 0.6, 0.8)]
    assert np.abs(ordinary).max() < 0.08  # probabilities mean what they say
    assert ((p > 0.5) == y).mean() > 0.985


def test_posterior_equals_the_sum_over_a_forest():
    y, v, *_ = simulated(4000)
    a = np.abs(v)
    m = toxicity.LabelModel(0.12, a.T @ a, v.T @ a, v.T @ v)
    for row, got in zip(v[:50], m.posterior(v[:50]), strict=True):
        odds = m.rate / (1 - m.rate)
        for j, x in enumerate(row):
            odds *= {1: m.hit[j] / m.miss[j], -1: (1 - m.hit[j]) / (1 - m.miss[j]), 0: 1}[int(x)]
        for (i, j), rho in zip(m.edges, m.rho, strict=True):
            if row[i] and row[j]:
                for sign, e in ((1, m.hit), (-1, m.miss)):
                    both = e[i] * e[j] + rho * (e[i] * (1 - e[i]) * e[j] * (1 - e[j])) ** 0.5
                    both = min(max(both, e[i] + e[j] - 1 + 1e-4, 1e-4), min(e[i], e[j]) - 1e-4)
                    p = {(1, 1): both, (1, -1): e[i] - both, (-1, 1): e[j] - both, (-1, -1): 1 - e[i] - e[j] + both}[int(row[i]), int(row[j])]
                    alone = (e[i] if row[i] > 0 else 1 - e[i]) * (e[j] if row[j] > 0 else 1 - e[j])
                    odds *= (p / alone) ** sign
        assert got == pytest.approx(odds / (1 + odds), rel=1e-6)


def test_linear_reaches_the_optimum():
    r = np.random.default_rng(2)
    x, t = r.random((200, 3)), r.random(200)
    doc, term = np.divmod(np.arange(600), 3)
    w, b = toxicity.linear(doc, term, x.ravel(), t, 3, steps=4000)
    g = 1 / (1 + np.exp(-(x @ w + b))) - t
    assert np.abs(np.append(x.T @ g + 0.5 * w, g.sum())).max() < 0.05


def test_moments_and_counts_equal_plain_ones(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf, "labels"))
    assert len(model.keys)
    texts = [None if x.text is None else x.text.encode() for x in docs.collect()]
    v = model.votes(texts).astype(int)
    a = np.abs(v)
    for got, want in zip(toxicity.moments(docs.repartition(5), model), (a.T @ a, v.T @ a, v.T @ v), strict=True):
        assert (got == want).all()
    some = docs.filter("doc_id < 40").withColumn("y", (F.col("doc_id") % 2).cast("int"))
    counts = {r.term: (r.toxic, r.texts) for r in toxicity._counts(some).collect()}
    want = {}
    for r in some.collect():
        t = toxicity.words(raw([r.text]))
        for h in {x for _, h, _ in toxicity.terms(t) for x in h.view(np.int64).tolist()}:
            x = want.setdefault(h, [0, 0])
            x[0] += r.y
            x[1] += 1
    assert counts == {k: tuple(x) for k, x in want.items()}


def test_scores_equal_plain_sums(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf, "labels"))
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    for r in toxicity.scored(docs, model, ["doc_id", "text"]).collect():
        t = toxicity.words(raw([r.text]))
        n = {}
        for _, h, _ in toxicity.terms(t):
            for x in h.tolist():
                n[x] = n.get(x, 0) + 1
        total = model.bias + sum(weight[k] * (100 * c / max(len(plain_words(r.text)), 20)) ** 0.5 for k, c in n.items() if k in weight)
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = toxicity.op11_toxicity(spark, sf)
    x = out.join(read(spark, sf, "labels"), "doc_id").toPandas()
    held = x[x.held_out]
    assert ((held.toxic == 0) & (held.predicted == 1)).mean() <= 0.02
    assert ((held.toxic == 1) & (held.predicted == 1)).sum() >= 0.6 * (held.toxic == 1).sum()
    assert out.count() == read(spark, sf, "documents").count()


def test_cases(spark):
    docs = documents(spark, hard_rows())
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    one = spark.createDataFrame([(1, 0, 1), (6, 0, 0), (7, 0, 0), (9, None, 1), (None, 1, 1)], none.schema)
    for labels, rate in ((none, 0.5), (one, 1 / 5)):  # documents 1, 6 and 7, one of them three times over
        out = toxicity.scored(docs, toxicity.fit(docs, labels), ["doc_id", "text_"]).toPandas()
        assert len(out) == len(hard_rows()) and np.allclose(out.score, rate)
    both = spark.createDataFrame([(6, 1, 1), (7, 0, 1), (1, 0, 1), (2, 1, 1)], none.schema)
    out = toxicity.scored(docs, toxicity.fit(docs, both), ["doc_id"]).toPandas()
    assert len(out) == len(hard_rows()) and out.score.between(0, 1).all()
    assert out[out.doc_id == 7].score.nunique() == 1
    assert toxicity.scored(documents(spark, []), toxicity.fit(documents(spark, []), none), ["doc_id"]).count() == 0
    assert toxicity.scored(documents(spark, []), toxicity.fit(documents(spark, []), both), ["doc_id"]).count() == 0


def test_labels_of_the_held_out_fold_do_not_matter(spark, sf):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    rest = fold(F.col("doc_id"), 4) != 2
    a = toxicity.fit(docs, labels.filter(rest))
    b = toxicity.fit(docs, labels.withColumn("toxic", F.when(rest, F.col("toxic")).otherwise(1 - F.col("toxic"))).filter(rest))
    assert (a.keys == b.keys).all() and np.allclose(a.weights, b.weights)
