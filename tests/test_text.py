import uuid

from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_folding_keys_and_slugs(spark):
    assert one(spark, "Éléphant ÇA", T.fold) == "elephant ca"
    assert one(spark, "L’été, c'est 5 %", T.norm) == "l été c est 5 %"
    assert one(spark, "  Élan & Co. (2)", T.slug) == "elan-co-2"
    assert one(spark, "Été!", T.text_key) == one(spark, "ete", T.text_key)
    assert one(spark, None, T.tokens) == []
    assert one(spark, "Un été_2 à x", T.tokens) == ["un", "été_2", "à", "x"]


def test_urls(spark):
    assert one(spark, "http://A.b/c//?q=1#f", T.canonical_url) == "http://A.b/c/"
    assert one(spark, " HTTP://A.b/C/ ", T.same_url) == "https://a.b/c"
    assert one(spark, "https://a.b/c/D/?x", T.url_slug) == "d"
    assert one(spark, "see https://a.b/c. and (http://d.e)", T.links_in) == ["https://a.b/c", "http://d.e"]


def test_uuid5_equals_the_standard_library(spark):
    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    for name in ("", "a", "é|section|x", "z" * 500):
        assert one(spark, name, lambda c: T.uuid5(c, ns)) == str(uuid.uuid5(uuid.UUID(ns), name))


def test_pieces_and_cuts(spark):
    assert one(spark, "", T.n_tokens) == 1 and one(spark, "x" * 41, T.n_tokens) == 10
    assert one(spark, "abcdefghij", lambda c: T.hard_split(c, 1)) == ["abcd", "efgh", "ij"]
    cut = one(spark, "a" * 20_000 + "b" * 10_000, T.head_tail)
    assert len(cut) == 24_005 and cut.startswith("a" * 20_000 + "\n[…]\n") and cut.endswith("b" * 4_000)
    assert one(spark, "a > b › c » 12", T.breadcrumb_parts) == ["a", "b", "c", "12"]
    assert one(spark, "Short. This sentence is long enough to be kept. # not this heading at all here.", lambda c: T.sentences(c)) == ["This sentence is long enough to be kept."]
    assert one(spark, "a  \n\n\n\nb \n", T.squeeze_lines) == "a\n\nb\n"
