from pyspark.sql import functions as F

from tessera.sources import files


def test_markdown_folder_and_front_matter(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "readme.md").write_text("root readme")
    (root / "sub" / "readme.md").write_text("kept")
    (root / "a.md").write_text("﻿---\ntitle: \"A: b\"\ntags: [x, y]\nbroken\n---\n# H\nbody\n")
    (root / "b.txt").write_text("no")
    rows = files.markdown_folder(spark, str(root))
    fields, body = files.split_front_matter(F.col("raw"))
    got = {r["source_path"]: r for r in rows.select("source_path", fields.alias("f"), body.alias("b")).collect()}
    assert set(got) == {"a.md", "sub/readme.md"}
    assert got["a.md"]["f"] == {"title": "A: b", "tags": "[x, y]"} and got["a.md"]["b"] == "# H\nbody\n"
    assert got["sub/readme.md"]["f"] == {} and got["sub/readme.md"]["b"] == "kept"


def test_markdown_out_and_in(spark, tmp_path):
    rows = spark.createDataFrame([("n1", {"b": "2", "a": "1"}, "text\nmore"), ("n2", {}, "")], "name string, front map<string,string>, body string")
    files.write_markdown(rows, str(tmp_path / "out"))
    back = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "out"), wholetext=True)
    assert sorted(r["value"] for r in back.collect()) == ["---\n\n---\n\n\n", "---\na: 1\nb: 2\n---\n\ntext\nmore\n"]


def test_export_csv_with_line_feeds_and_quotes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "q"\nb, c;d'), (2, "é" * 9000), (3, "")], "k long, t string")
    files.write_export(rows, str(tmp_path / "csv"))
    assert sorted(map(tuple, files.read_export(spark, str(tmp_path / "csv"), "k long, t string").fillna("").collect())) == sorted(map(tuple, rows.collect()))


def test_cache_keys_differ_by_every_part(spark):
    d = spark.createDataFrame([("x",), ("y",)], "p string")
    keys = [r["k"] for args in (("a", "m"), ("b", "m"), ("a", "n")) for r in d.select(files.cache_key(*args, F.col("p")).alias("k")).collect()]
    assert len(set(keys)) == 6
