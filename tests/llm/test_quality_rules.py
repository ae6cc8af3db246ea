import re
from collections import Counter

from helpers import documents, hard_rows, words
from tessera.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    seen, n, chars = set(), 0, 0
    for line in text.split("\n"):
        k = re.sub(r"[\x20\x09-\x0D]", "", line)
        if k and line in seen:
            n, chars = n + 1, chars + len(k)
        seen.add(line)
    out |= {"n_dup_lines": n, "dup_line_chars": chars}
    for k in (3, *Q.NGRAM_LIMITS):
        grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        c = Counter(grams)
        cov = {j for i, g in enumerate(grams) if c[g] > 1 for j in range(i, i + k)}
        if k == 3:
            out["n_repeat_words"] = len(cov)
        else:
            out[f"dup_chars_{k}"] = sum(len(w[j]) for j in cov)
    return out


def test_counts_equal_a_plain_version(spark):
    rows = [*hard_rows(), (20, "x y z " * 30, "a"), (21, "same line here\n" * 9 + words(5, 70), "a")]
    out = Q.repetition(documents(spark, rows)).drop("text_").collect()
    assert len(out) == len(rows)
    by = Counter()
    for r in out:
        e = brute(r["text"])
        assert {k: r[k] for k in e} == e, r["doc_id"]
        failed = e["n_words"] < 50 or 100 * e["n_repeat_words"] > 50 * e["n_words"]
        over = 100 * e["dup_line_chars"] > Q.LINE_LIMIT * e["word_chars"] or any(100 * e[f"dup_chars_{k}"] > v * e["word_chars"] for k, v in Q.NGRAM_LIMITS.items())
        assert (r["base_failed"], r["kept"]) == (failed, not failed and not over)
        by[r["kept"]] += 1
    assert by[True] and by[False]


def test_kept_rows_keep_their_columns(spark):
    d = documents(spark, hard_rows())
    out = Q.keep_good(d)
    assert out.columns == d.columns
    assert {r["doc_id"] for r in out.collect()} == {6, 7, 8, None}  # documents 9 and 11 repeat themselves, 10 is its line twice


def test_empty_table(spark):
    assert Q.repetition(documents(spark, [])).count() == 0


def test_documents_that_fall_by_coverage_alone(spark):
    """Few but long words repeat: the base rule counts words and lets them pass, coverage counts characters."""
    long = " ".join(f"{'abcdefghij'[i]}{'x' * 18}{i}" for i in range(10))  # ten words of 20 characters
    short = lambda n, k: " ".join(f"{'qrstuvw'[k]}{i}" for i in range(n))
    rows = [
        (1, f"{long} {short(40, 0)} {long} {short(40, 1)}", "a"),  # a window of ten words, twice
        (2, f"{short(40, 0)}\n{long[:150]}\n{short(40, 1)}\n{long[:150]}", "a"),  # a line, twice
        (3, f"{long} {short(40, 0)} {short(40, 1)}", "a"),  # clean
    ]
    out = {r["doc_id"]: r for r in Q.repetition(documents(spark, rows)).collect()}
    assert [out[i]["base_failed"] for i in (1, 2, 3)] == [False] * 3
    assert [out[i]["kept"] for i in (1, 2, 3)] == [False, False, True]
    assert 100 * out[1]["n_repeat_words"] < 30 * out[1]["n_words"] and out[2]["n_dup_lines"] == 1


def test_long_texts_are_measured_in_stretches(monkeypatch):
    from tessera.llm import ragged

    texts = [words(8, 3000, 300) + "\n" + words(9, 40) + "\n" + words(8, 3000, 300), "short", None, words(9, 40) * 5]
    whole = Q.measure(texts)
    monkeypatch.setattr(ragged, "STRETCH", 256)
    parts = Q.measure(texts)
    assert all((whole[k] == parts[k]).all() for k in whole)
