import math
import zlib
from collections import Counter

import numpy as np
from helpers import documents, hard_rows, words
from tessera.llm import language_model as L
from tessera.llm.quality_model import fold


def test_rows_of_the_table_are_distributions():
    r = np.random.default_rng(1)
    pairs = np.arange(400)
    model = L.train(pairs, r.integers(1, 50, 400), classes=20, size=4, steps=30)
    assert np.allclose((10 ** L.log_table(model)).sum(1), 1)


def test_noise_contrastive_estimation_finds_the_conditionals():
    r = np.random.default_rng(2)
    p = r.dirichlet(np.ones(12) * 0.4, 12)
    n = np.round(p * 1e5).astype(int)
    t = 10 ** L.log_table(L.train(np.arange(144), n.ravel(), classes=12, size=12, steps=800, prior=0))
    assert np.abs(t - n / n.sum(1, keepdims=True)).max() < 0.03


def test_base_counts_and_all_probabilities(spark):
    from pyspark.sql import functions as F

    rows = [*hard_rows(), *((100 + i, words(i, 40, 60).upper(), "a") for i in range(120))]
    docs = documents(spark, rows)
    out = L.score(docs, fold(F.col("doc_id"), 7) == 2).collect()
    assert len(out) == len(rows)
    test = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    text = lambda t: L.tokens((t or "").encode())
    c = Counter(w for i, t, _ in rows if not test(i) for w in text(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, _ in rows:
        w = text(t)
        want[i, test(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert want == Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert all(r["score"] < 0 for r in out)


def test_words_sum_to_one(spark, monkeypatch):
    """After one context, the probabilities of all training words and of what is unseen, class by class, sum to 1."""
    monkeypatch.setattr(L, "KNOWN", 1100)
    train = documents(spark, [(i, words(i, 200, 3000), "a") for i in range(40)], extra=False).selectExpr("cast(text as binary) text")
    counts, n, kinds, vocabulary, model = L.learn(train)
    table = 10 ** L.log_table(model)
    context = vocabulary.classes_of([L.END])[1][0]
    total, unseen = 0.0, 0.0
    all_ = {bytes(r["word"]): r["c"] for r in counts.collect()}
    assert (len(all_), sum(all_.values())) == (kinds, n) and kinds > 1100
    rows, classes = vocabulary.classes_of(list(all_))
    for c, k in zip(all_.values(), classes, strict=True):
        total += table[context, k] * ((c + 1) / 10 ** vocabulary.tail_log[k] if k >= L.HEAD else 1)
    for k in range(L.HEAD, L.HEAD + L.TAIL):
        unseen += table[context, k] / 10 ** vocabulary.tail_log[k]
    unused = sum(table[context, k] for k in range(len(all_), L.HEAD))
    assert abs(total + unseen + unused - 1) < 1e-6


def test_better_than_single_words_on_held_out_texts(spark, sf):
    out = L.op7_language_model(spark, sf).filter("held_out").groupBy().sum("score", "base_score").first()
    assert out[0] > out[1]


def test_empty_table(spark):
    from pyspark.sql import functions as F

    assert L.score(documents(spark, []), F.lit(False)).count() == 0
    assert L.score(documents(spark, [(1, "a b", "s")]), F.lit(True)).first()["train_tokens"] == 0


def _bigrams(spark):
    """Over 1024 commoner words; pqa and zqa share a tail class and a count, and each follows its own word or stands two words after its own."""
    rows = [(i, f"f{i % 1040}", "a") for i in range(60 * 1040)]
    rows += [(70_000 + i, "lefty pqa righty zqa " * 4 + "lefty f1 righty f2 " * 4, "a") for i in range(12)]
    rows += [(70_100 + i, "onetwo mid third onefour mid fifth " * 12, "a") for i in range(5)]
    tests = ["lefty pqa", "lefty zqa", "onetwo mid third", "onetwo mid fifth"]
    return documents(spark, rows + [(80_000 + i, t, "a") for i, t in enumerate(tests)], extra=False)


def test_rare_words_and_farther_words_count(spark, monkeypatch):
    from pyspark.sql import functions as F

    def run():
        return {r["doc_id"]: r["score"] for r in L.score(_bigrams(spark), F.col("doc_id") >= 80_000).collect()}

    a = run()
    assert a[80_000] > a[80_001] + 0.1, "a word of a tail class is predicted by the word before"
    assert a[80_002] > a[80_003] + 0.05, "the word two back counts"
    monkeypatch.setattr(L, "KNOWN", 1030)
    b = run()
    assert all(abs(a[i] - b[i]) < 1e-3 for i in a), "the words that are joined score like those that are broadcast"


def test_learned_words_keep_the_mass_of_their_class(spark):
    d = _bigrams(spark).filter("doc_id < 80000").selectExpr("cast(text as binary) text")
    _, _, _, vocabulary, model = L.learn(d)
    at = np.flatnonzero(model.has)
    assert len(at)
    for context in (0, 5, L.HEAD + 3):
        total = Counter()
        k = vocabulary.classes[at]
        for x, p in zip(k, 10 ** model.word_log(k, np.full(len(at), context), model.known[at]), strict=True):
            total[x] += p
        assert all(abs(p / vocabulary.mass[x - L.HEAD] - 1) < 1e-4 for x, p in total.items())
    assert np.allclose(model.weights.sum(1), 1)


def test_partial_counts_may_come_in_many_batches(spark, monkeypatch):
    """Words whose partial counts are summed on the way, as there are more than are summed at once, get the counts and vectors they get otherwise."""
    d = _bigrams(spark).filter("doc_id < 80000").selectExpr("cast(text as binary) text").repartition(6)

    def run():
        counts, _, _, _, model = L.learn(d)
        return {bytes(r["word"]): r["c"] for r in counts.collect()}, {bytes(r["word"]): (r["c"], np.frombuffer(r["v"], np.float32)) for r in model.vectors.collect()}

    counts, a = run()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(L, "BYTES_AT_ONCE", 1)
    try:
        for rows in ("1", "3"):
            spark.conf.set(key, rows)
            _, b = run()
            assert a and a.keys() == b.keys()
            assert all(b[w][0] == counts[w] and np.allclose(a[w][1], b[w][1], atol=1e-3) for w in a)
    finally:
        spark.conf.set(key, before)


def test_scores_equal_a_plain_scorer(spark):
    """Each text's score from the model's parts, word by word in plain Python."""
    from pyspark.sql import functions as F

    rows = [(i, words(i, 60, 1500), "a") for i in range(150)] + hard_rows()
    docs = documents(spark, rows, extra=False)
    held = F.coalesce(F.col("doc_id"), F.lit(0)) % 5 == 0
    got = Counter((r["doc_id"], round(r["score"], 3)) for r in L.score(docs, held).collect())
    _, _, _, vocabulary, model = L.learn(docs.filter(~held).selectExpr("cast(text as binary) text"))
    tables = [10 ** L.log_table(m) for m in model.positions]
    end = vocabulary.classes_of([L.END])[1][0]

    def plain(text):
        total, before = 0.0, [end] * L.POSITIONS
        for w in L.tokens((text or "").encode()):
            (row,), (c,) = vocabulary.classes_of([w])
            p = sum(model.weights[before[0], j] * tables[j][before[j], c] for j in range(L.POSITIONS))
            if c >= L.HEAD:
                own = math.log10(vocabulary.counts[row] + 1) if row >= 0 else 0.0
                if row >= 0 and model.has[row]:
                    v = model.known[row]
                    own = (float(model[1][before[0]] @ v[:-1]) + float(v[-1])) / math.log(10) + model.norm[c - L.HEAD, before[0]]
                total += own - vocabulary.tail_log[c]
            total += math.log10(p)
            before = [c, *before[:-1]]
        return total

    want = Counter((i, round(plain(t), 3)) for i, t, _ in rows)
    by = lambda x: sorted(((i is None, i or 0, s) for i, s in x.elements()))
    assert all(p[:2] == q[:2] and abs(p[2] - q[2]) < 0.02 for p, q in zip(by(got), by(want), strict=True))
