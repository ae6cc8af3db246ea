from pyspark.sql import functions as F

from tessera.operators import context, markdown, profiles, vocabularies

VOCABULARY = {"GED": ("gestion électronique",), "Big": (), "contrat": ("contrats", "avenant")}


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_whole_words_and_exact_acronyms(spark):
    found = lambda text: one(spark, text, lambda c: vocabularies.detected(c, VOCABULARY, ("Big",)))
    assert found("La GED, un big Contrat") == ["GED", "contrat"]
    assert found("ged éged GEDs Big-data contratéx x_contrat") == []
    assert found("Big.\n(AVENANT) Gestion électronique") == ["Big", "contrat"], "an acronym's forms are of exact case too"
    assert found("") == [] and found(None) == []
    assert one(spark, "GED et avenant", lambda c: vocabularies.expansions(vocabularies.detected(c, VOCABULARY), VOCABULARY)) == ["GED", "gestion électronique", "contrat", "contrats", "avenant"]


def test_extracts(spark):
    names = "sid title text api version doc_type first last url path".split()
    rows = [("S1", "A > B", "\n x \n", "Contacts", "2", "reference_api", 3, 5, "https://a", "f.md"), ("S2", "T", "y", None, "1", "note_interne", 4, 4, "", "f.md"), ("S3", "U", "z", "", None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "sid string, title string, text string, api string, version string, doc_type string, first int, last int, url string, path string")
    got = [r.x for r in d.select(context.extract(*(F.col(c) for c in names)).alias("x")).collect()]
    assert got == [
        '<extrait id="S1">\n[S1] Source : A > B (Contacts v2 ; référence technique ; p. 3-5 ; lien : https://a)\n\nx\n</extrait>',
        '<extrait id="S2">\n[S2] Source : T (note interne ; p. 4 ; fichier : f.md)\n\ny\n</extrait>',
        '<extrait id="S3">\n[S3] Source : U\n\nz\n</extrait>',
    ]
    q = spark.createDataFrame([(1,), (2,)], "q int")
    x = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "q int, rank int, extract string")
    assert {tuple(r) for r in context.formatted(q, x, "q", "rank").collect()} == {(1, "a\n\nb"), (2, "(aucun extrait)")}


def test_citations_outside_code_and_headings_without(spark):
    text = "# One [S1]\nsee [S2] and `[S3]` [S2]\n```\n[S4]\n# no\n```\n## Two\n[S10]"
    assert [tuple(c) for c in one(spark, text, lambda c: context.cited(c, F.array(F.lit("S1"), F.lit("S2"))))] == [("S1", True), ("S2", True), ("S10", False)]
    d = markdown.outline(spark.createDataFrame([(1, text)], "k int, t string"), "k", F.col("t"))
    assert [tuple(h) for h in d.select(context.outline(F.col("sections")).alias("x")).first().x] == [(0, 1, "One"), (1, 2, "Two")]


def test_described_vocabulary(spark):
    d = spark.createDataFrame([("g", "b", "two"), ("g", "a", None)], "g string, n string, t string")
    assert vocabularies.described(d, "n", "t", "g").first().lines == "- a : \n- b : two"


def test_partner_profiles_speak_of_what_is_known(spark):
    d = spark.createDataFrame([("Ax", "code apporteur 12.", ["p"] * 9, True, "mensuelle", True), ("By", None, None, None, None, None), ("Cz", "", [], False, "", False)], "n string, c string, p array<string>, s boolean, f string, l boolean")
    f = profiles.partner(*(F.col(c) for c in "ncpsfl"), "X")
    rows = d.select(*(c.alias(k) for k, c in f.items())).collect()
    assert [r.summary for r in rows] == [
        "Fiche d'agrégation du partenaire Ax dans X : le code apporteur 12 ; 9 produit(s) agrégé(s) : p, p, p, p, p, p, p, p… ; prix d'achat moyens transmis ; agrégation mensuelle ; lettre d'autorisation signée requise.",
        "Fiche d'agrégation du partenaire By dans X.", "Fiche d'agrégation du partenaire Cz dans X : prix d'achat moyens non transmis.",
    ]
    assert [len(r.prerequisites) for r in rows] == [1, 0, 0] and rows[1].keywords[0] == "By" and len(rows[0].keywords) == 12


def test_routing_falls_back_and_guards(spark):
    cases = [
        ("ask", None, None), ("ask", None, "{broken"), ("the api", None, '{"intent":"FAQ","corpus":"api","route":"outils","standalone_question":" ask it ","sub_queries":["a","the api","b","c"]}'),
        ("ask", "before", '{"intent":"odd","corpus":"api"}'), ("ask", "the api", '{"intent":"faq","corpus":"api"}'),
    ]
    d = spark.createDataFrame(cases, "q string, h string, a string")
    f = profiles.routed(F.col("q"), F.col("h"), F.col("a"), ["faq"], "api", "api", tools=False)
    got = [tuple(r) for r in d.select(*(c.alias(k) for k, c in f.items())).collect()]
    assert got == [
        ("autre", "", "documentation", ["ask"], True), ("autre", "", "documentation", ["ask"], True), ("faq", "api", "documentation", ["the api", "ask it", "a", "b"], False),
        ("autre", "", "documentation", ["ask"], False), ("faq", "api", "documentation", ["ask"], False),
    ]
    b = profiles.boosted(F.col("n"), F.col("i"), F.col("c"), ["x"], "api")
    assert [r.b for r in spark.createDataFrame([(0, "x", "api"), (0, "x", ""), (0, "y", ""), (1, "y", "")], "n int, i string, c string").select(b.alias("b")).collect()] == [True, False, True, False]
