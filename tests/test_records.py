import pytest
from pyspark.sql import functions as F

from tessera.functions.text import fold
from tessera.operators import dialogue, payload, reports
from tessera.sources import catalogue


def test_percentiles_of_a_group_of_nearly_all_rows(spark):
    rows = [("hot", float(i % 500)) for i in range(9000)] + [("hot", 7.0)] * 3000 + [("cold", v) for v in (1.0, 2.0, 3.0, 4.0, 100.0)] + [(None, 5.0), ("none", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(6)
    x = sorted(v for g, v in rows if g == "hot")

    def at(p):
        place = p * (len(x) - 1) / 100
        low = int(place)
        return round(x[low] + (x[min(low + 1, len(x) - 1)] - x[low]) * (place - low), 6)

    out = {r.g: tuple(r)[1:] for r in reports.percentiles(d, "v", "g").collect()}
    assert out["hot"][0] == 12000 and out["hot"][4:] == tuple(at(p) for p in (50, 90, 95, 99))
    assert out["cold"][4:6] == (3.0, 61.6) and out[None][4:] == (5.0,) * 4 and out["none"] == (0,) + (None,) * 7
    assert reports.percentiles(d, "v", at=(50,)).first().n == 12006


def test_breakdown_counts_a_metric_only_where_it_is(spark):
    d = spark.createDataFrame([(1, "a", "x", 1.0, None), (2, "a", None, 0.0, 4.0), (3, None, "x", None, None)], "id long, theme string, product string, m double, k double")
    got = {(r.dimension, r.value, r.metric): (r.n, r["mean"]) for r in reports.breakdown(d, "id", ["theme", "product"], ["m", "k"]).collect()}
    assert got == {("all", "", "m"): (2, 0.5), ("all", "", "k"): (1, 4.0), ("theme", "a", "m"): (2, 0.5), ("theme", "a", "k"): (1, 4.0), ("product", "x", "m"): (1, 1.0), ("product", "—", "m"): (1, 0.0), ("product", "—", "k"): (1, 4.0)}
    one = d.agg(reports.per_unit(F.sum("m"), F.count_if(F.col("m") > 5)).alias("x"), *reports.rates(F.when(F.col("m") > 5, "v"), ("v",))).first()
    assert one.x is None and one.v_rate is None


def test_payloads(spark):
    texts = ['{"id": 1, "metadata": {"p": ["a"], "x": {"y": [1, null]}}, "features": {"p": [], "n": 2}}', '{"metadata": {"p": ["a"], "n": 1}, "features": {"p": ["b", "c"], "n": null}, "z": "é\\"q"}', "{}", "not json", None]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, payload string")
    out = payload.flatten(d, "payload", {"p": ("p", "array<string>"), "n": ("n", "int")}, ("metadata", "features")).orderBy("k").collect()
    assert [(r.p, r.n) for r in out] == [(["a"], 2), (["b", "c"], 1), (None, None), (None, None), (None, None)]
    assert out[0].rest == {"id": "1", "metadata.x": '{"y":[1,null]}'} and out[1].rest == {"z": '"é\\"q"'} and out[2].rest == {}


def test_trees_of_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.yaml").write_text('name: A\nrules:\n  - {pattern: "^x", theme: t, n: 3}\n  - pattern: "y"\n    on: [1, 2]\nwords:\n  alpha: [al, "α"]\n  beta: []\nnone:\n')
    (tmp_path / "sub" / "b.json").write_text('{"rules": [{"pattern": "z", "flag": true}], "words": {"gamma": ["g"]}}')
    (tmp_path / "c.txt").write_text("not read: [")
    x = catalogue.tree_files(spark, str(tmp_path))
    assert sorted((r.file, r.entry, r.pattern, r.theme, r.flag) for r in catalogue.entries(x, "rules", ("pattern", "theme", "flag")).collect()) == [("a.yaml", 0, "^x", "t", None), ("a.yaml", 1, "y", None, None), ("b.json", 0, "z", None, "true")]
    assert {tuple(r) for r in catalogue.vocabulary(x, "words").collect()} == {("alpha", "alpha"), ("alpha", "al"), ("alpha", "α"), ("gamma", "gamma"), ("gamma", "g")}
    assert [r.value for r in x.filter("keys = array('none')").collect()] == [None]
    (tmp_path / "d.yaml").write_text("a: [")
    assert catalogue.tree_files(spark, str(tmp_path), "a.*").count() == 10
    with pytest.raises(Exception, match="d.yaml cannot be read"):
        catalogue.tree_files(spark, str(tmp_path)).collect()


def test_business_questions_and_flags(spark, tmp_path):
    (tmp_path / "q.csv").write_text('produit,requete,reponse_ideale,liens_possibles,thematique\nA,"one\ntwo","**Bouton** et `x_1`","http://a.b/c;mail , https://d",t\nA, ,nothing,,\nB,last,,,\n')
    rows = [tuple(r) for r in catalogue.business_questions(spark, str(tmp_path / "q.csv")).orderBy("id").collect()]
    assert rows == [("t001", "A", "one\ntwo", "**Bouton** et `x_1`", ["http://a.b/c", "https://d"], "t", ["Bouton", "x_1"]), ("t002", "B", "last", None, [], None, [])]
    (tmp_path / "f.csv").write_text("id,raison\n t001 ,why\n,x\n")
    assert [tuple(r) for r in catalogue.review_flags(spark, str(tmp_path / "f.csv")).collect()] == [("t001", "why")]
    assert catalogue.review_flags(spark, str(tmp_path / "missing.csv")).count() == 0


def test_folding_and_search_without_accents(spark):
    d = spark.createDataFrame([(0, "ŞÉLİM œuvre ｆｕｌｌ été ﬂ ß Ő"), (1, None)], "i int, t string")
    assert d.filter("i = 0").select(fold("t").alias("x")).first().x == "selim œuvre full ete ﬂ ß o"
    found = lambda *words: [(r.i, r.at) for r in dialogue.search(d, "t", words).collect()]
    assert found("ÉTÉ", "selim") == [(0, 18)] and found("ete", "absent") == [] and found("x") == [] and found("e", "Full") == [(0, 13)]
