import re

from pyspark.sql import functions as F

from tessera.operators import chunking, features, markdown, metrics, rules

DOC = """intro line

## First
text one
```
# not a heading
```
### Deep
<!-- Page 2 -->
text two
## First
text three

# Top
last"""


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_headings_close_their_level_and_deeper_ones(spark):
    x = chunking.lines(docs(spark, DOC), "doc_id", F.col("text")).orderBy("pos").collect()
    path = {r["line"]: r["path"] for r in x}
    assert path["intro line"] == [] and path["text one"] == ["First"] and path["# not a heading"] == ["First"]
    assert path["text two"] == ["First", "Deep"] and path["text three"] == ["First"] and path["last"] == ["Top"]
    assert [r["page"] for r in x if r["line"] in ("text one", "text two", "last")] == [None, 2, 2]


def test_tree(spark):
    t = chunking.tree(docs(spark, DOC, "", None, "plain\n\n" + "word " * 900), "doc_id", F.col("text"), 50, 10).collect()
    ids = [r["node_id"] for r in t]
    assert len(ids) == len(set(ids)), "equal paths of one document stay apart"
    by = {r["node_id"]: r for r in t}
    for r in t:
        assert (r["parent_id"] is None) == (r["level"] == "document")
        assert r["parent_id"] is None or by[r["parent_id"]]["level"] in ("document", "section")
        if r["level"] == "chunk":
            assert r["token_count"] <= 50 and r["prev_id"] is None or by[r["prev_id"]]["next_id"] == r["node_id"]
    firsts = [r for r in t if r["level"] == "section" and r["path"] == ["First"]]
    assert len(firsts) == 2
    assert next(r["text"] for r in t if r["level"] == "document" and r["doc_id"] == 0) == "intro line\n\n- First\n  - Deep\n- First\n- Top"
    assert {r["doc_id"] for r in t if r["level"] == "document"} == {0, 1, 2, 3}


def packed(spark, text, most, overlap):
    x = markdown.sections(docs(spark, text), "doc_id", F.col("text"))
    return [tuple(c) for r in x.orderBy("section").select(chunking.pack(chunking.cut_blocks(F.col("blocks"), most), most, overlap).alias("c")).collect() for c in r["c"]]


def test_packing_covers_every_block_within_the_size(spark):
    text = "\n\n".join(f"block {i} " + "x" * (i * 7 % 90) for i in range(60))
    out = [t for t, *_ in packed(spark, text, 60, 10)]
    assert all(max(1, len(c) // 4) <= 60 for c in out)
    for i in range(60):
        assert any(re.search(rf"block {i}\b", c) for c in out)
    assert packed(spark, "# only a heading", 60, 10) == []
    assert [c for r in markdown.sections(docs(spark, "#### deep"), "doc_id", F.col("text"), 3).select(chunking.pack(F.col("blocks"), 60, 10).alias("c")).collect() for c in r["c"]] == []


def test_overlap_carries_as_many_whole_blocks_as_fit(spark):
    parts = [c * 38 for c in "abcdefgh"]  # four and a half to a chunk of 40 tokens
    out = [t.split("\n\n") for t, *_ in packed(spark, "\n\n".join(parts), 40, 20)]
    assert [[b[0] for b in c] for c in out] == [list("abcd"), list("cdef"), list("efgh")]
    assert [[b[0] for b in t.split("\n\n")] for t, *_ in packed(spark, "\n\n".join(parts), 40, 30)] == [list("abcd"), list("bcde"), list("cdef"), list("defg"), list("efgh")]
    assert [[b[0] for b in t.split("\n\n")] for t, *_ in packed(spark, "\n\n".join(parts), 40, 0)] == [list("abcd"), list("efgh")]
    assert [t for t, *_ in packed(spark, "a" * 100 + "\n\n" + "b" * 100, 40, 5)] == ["a" * 100, "a" * 20 + "\n\n" + "b" * 100]
    assert [t for t, *_ in packed(spark, "one\n\n---\n\ntwo", 40, 5)] == ["one", "two"]


def test_blocks_are_whole(spark):
    text = "\n".join(["para", "| a |", "<!-- Page 3 -->", "| b |", "- one", "", "  more", "* two", "", "after", "<!-- Page 4 -->", "page four", "```", "x", "", "# no heading", "<!-- Page 9 -->", "~~~", "***", "1. n", "\tstill", "#### four", "", "end"])
    (row,) = markdown.sections(docs(spark, text), "doc_id", F.col("text"), 3).collect()
    assert [(b.kind, b.page, b.text) for b in row.blocks] == [
        ("text", None, "para"), ("table", None, "| a |\n| b |"), ("list", 3, "- one\n\n  more\n* two"), ("text", 3, "after"), ("text", 4, "page four"), ("code", 4, "```\nx\n\n# no heading\n<!-- Page 9 -->\n~~~"),
        ("break", 4, "***"), ("list", 4, "1. n\n\tstill"), ("heading", 4, "#### four"), ("text", 4, "end"),
    ]
    assert (row.first_page, row.last_page, row.n_lines, row.section, row["last"]) == (3, 4, 24, -1, -1)


def test_large_blocks_are_cut_at_lines(spark):
    rows = "\n".join(f"| {i:03} {'x' * 30} |" for i in range(200))
    out = [t for t, *_ in packed(spark, rows + "\n" + "y" * 1000, 50, 0)]
    assert all(len(c) // 4 <= 50 for c in out)
    assert "\n".join(out).replace("\n\n", "\n").split("\n")[:200] == rows.split("\n")


def test_rendering_of_six_levels_and_a_long_section(spark):
    long = "\n".join(f"line {i}" for i in range(10_000))
    text = "\n".join(f"{'#' * k} h{k}\nbody {k}" for k in range(1, 7)) + "\n## tail\n" + long + "\n# other\nend"
    x = markdown.sections(docs(spark, text, "", None), "doc_id", F.col("text"))
    got = {r.title: r.rendered for r in markdown.render(x, "doc_id", 100).filter("doc_id = 0").collect()}
    whole = {r.title: r.rendered for r in markdown.render(x, "doc_id", 10**6).filter("doc_id = 0").collect()}
    assert whole["h3"] == "\n\n".join(f"{'#' * k} h{k}\n\nbody {k}" for k in range(3, 7))
    assert whole["h1"] == "\n\n".join(f"{'#' * k} h{k}\n\nbody {k}" for k in range(1, 7)) + "\n\n## tail\n\n" + long
    assert got["h6"] == whole["h6"] == "###### h6\n\nbody 6" and got["other"] == "# other\n\nend"
    assert got["h1"] == whole["h1"][:400] + "\n[…]" and got["tail"] == whole["tail"][:400] + "\n[…]"
    assert {(r.doc_id, r.section, r.depth) for r in x.collect() if r.doc_id} == {(1, -1, 0), (2, -1, 0)}


def test_rendering_is_cut_where_the_next_section_begins_just_behind_the_limit(spark):
    """603 characters count as 150 tokens and fit; with a subsection after them, the whole does not, nor does it where that begins with the next character."""
    for n in range(600, 608):
        docs = spark.createDataFrame([(1, "# T\n" + "x" * (n - 5) + "\n## U")], "k int, md string")
        got = markdown.render(markdown.sections(docs, "k", F.col("md")), "k", 150).filter("level = 1").first()["rendered"]
        whole = "# T\n\n" + "x" * (n - 5) + "\n\n## U"
        assert len(whole) == n + 6 and got == whole[:600] + "\n[…]", n
    at = markdown.render(markdown.sections(spark.createDataFrame([(1, "# T\n" + "x" * 592 + "\n## U")], "k int, md string"), "k", F.col("md")), "k", 150)
    assert at.filter("level = 1").first()["rendered"] == "# T\n\n" + "x" * 592 + "\n\n## U"


def test_annotation(spark):
    text = "intro\n# Guide\n## GET /users/all\nx\n### Notes\ny\n## Errors\nz\n# POST /users\nw"
    x = markdown.sections(docs(spark, text), "doc_id", F.col("text")).select("doc_id", "section", "path")
    r = spark.createDataFrame([(0, "^Errors$", None, "kind", "errors"), (1, "^Errors$", None, "theme_hint", "fail"), (2, "Notes", "en", "shared", "true"), (3, "Notes", "fr", "theme", "never")], "rule_pos int, pattern string, corpus string, slot string, value string")
    resources = [("path", "/users", "users"), ("path", "/users/all", "people"), ("chapter", "Guide", "guide")]
    out = markdown.annotate(x, ["doc_id", "section"], r, resources, ["people", "guide"], F.lit("misc"), F.lit("en")).orderBy("section").collect()
    got = [(r["section"], r["endpoint"], r["resource"], r["chapter"], r["kind"], r["shared"], r["theme"], r["theme_forced"]) for r in out]
    assert got == [
        (-1, None, None, None, "document", False, "misc", False), (1, None, "guide", "Guide", "content", False, "guide", False), (2, "/users/all", "people", "Guide > GET /users/all", "endpoint", False, "people", True),
        (4, "/users/all", "people", "Guide > GET /users/all", "endpoint", True, "people", True), (6, None, "guide", "Guide > Errors", "errors", False, "fail", False), (8, "/users", "users", "POST /users", "endpoint", False, "misc", False),
    ]


def test_chunks_are_in_their_parents(spark):
    t = chunking.tree(docs(spark, DOC), "doc_id", F.col("text"), 50, 10)
    p = t.select(F.col("node_id").alias("up"), F.col("text").alias("whole"))
    x = t.filter("level = 'chunk'").join(p, F.col("parent_id") == F.col("up")).select(chunking.within_parent(F.col("text"), F.col("whole")).alias("w"), chunking.within_parent(F.lit("elsewhere"), F.col("whole")).alias("e"))
    assert {tuple(r) for r in x.collect()} == {(True, False)}


def test_precedence_distinguishes_absent_null_and_empty(spark):
    d = spark.createDataFrame([(True, "low", True, None), (True, "low", True, ""), (True, "low", False, "x")], "p1 boolean, v1 string, p2 boolean, v2 string")
    out = [r["x"] for r in d.select(rules.overlay((F.col("p1"), F.col("v1")), (F.col("p2"), F.col("v2"))).alias("x")).collect()]
    assert out == [None, "", "low"]


def test_longest_names_win(spark):
    names = spark.createDataFrame([("a", "credit"), ("b", "credit mutuel"), ("c", "mutuel plus")], "entity string, alias string")
    rows = spark.createDataFrame([(1, "le Crédit Mutuel"), (2, "le credit"), (3, "credits")], "id long, t string")
    assert sorted(map(tuple, rules.longest_matches(rows, "id", F.col("t"), names).collect())) == [(1, "b"), (2, "a")]


def _one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_names_are_whole_words_or_long(spark):
    names = spark.createDataFrame([("swiss", "SwissLife Banque"), ("ax", "Ax")], "entity string, alias string")
    rows = spark.createDataFrame([(1, "avec Swiss Life Banque."), (2, "taxes"), (3, "AX, voilà")], "id long, t string")
    assert sorted(map(tuple, rules.longest_matches(rows, "id", F.col("t"), names).collect())) == [(1, "swiss"), (3, "ax")]


def test_features_of_a_reference_page(spark):
    text = "#### HEAD\n#### GET\n- **POST**: x\nMéthode : **put**\nOPTIONS /v1/users/{id} and `/v1/x` with `page_size`\n```Python\nA_B\n```\n| FAMILLE | PARENT (PP) | GET |\n| x | « CLOS » |\n- PASSEPORT\nHTTP 404, 3.500 and 2000; code 204"
    f = {k: _one(spark, text, lambda c, k=k: features.structural(c)[k]) for k in features.structural(F.col("t"))}
    assert f["methods"] == ["OPTIONS", "GET", "POST", "PUT"] and f["endpoints"] == ["/v1/users/{id}", "/v1/x"]
    assert f["parameters"] == ["page_size"] and f["code_languages"] == ["python"]
    assert f["constants"] == ["A_B", "CLOS", "FAMILLE", "PARENT", "PASSEPORT"]
    assert (f["has_table"], f["has_list"], f["has_code"]) == (True, True, True)
    assert _one(spark, text, features.status_codes) == ["404", "204"]


def test_overlap_words_and_key_terms(spark):
    text = "Le **Menu Été** : voir https://a.b/c [S1]\nSource : guide\nla `valeur` de $X_1$ et **note**, **menu ete**"
    assert _one(spark, text, features.overlap_words) == ["menu", "ete", "voir", "valeur", "$x_1$", "note", "menu", "ete"]
    assert _one(spark, text, features.key_terms) == ["Menu Été", "valeur", "$X_1$"]


def test_targets_by_document_page_and_section(spark):
    cases = [
        (("d", "u", "A > Droits"), ("d", None, None), True), (("d", "u", "A > Droits"), ("d", None, " droits "), True), (("d", "u", "A > B"), ("d", None, "droits"), False), (("e", "u", "A"), ("d", "u", None), False),
        (("e", "http://X.y/p/", None), (None, "https://x.y/p", "none"), True), (("e", None, None), (None, "https://x.y/p", None), False), (("e", None, "Zone"), (None, None, "zone"), True), ((None, None, None), (None, None, None), True),
    ]
    d = spark.createDataFrame([(*h, *t, w) for h, t, w in cases], "a string, b string, c string, x string, y string, z string, want boolean")
    got = d.select(metrics.matches_target(*(F.col(c) for c in "abcxyz")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
