"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths find the windows that a text repeats; the code points
of all words inside such windows, and of lines that repeat an earlier line, are measured against the
code points of all its words. Everything is counted inside one document, so the scan needs no shuffle.

Cases: a null or empty text has no words (all counts 0, rejected by the base rule); texts of any length
are measured whole, a longer one simply fills a slice alone; repeated rows and ties get equal results
row by row; an empty table gives an empty result; columns named like results are taken from the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices
from .ragged import Texts, covered, mix, ngrams, repeated

#: Percent of a text's word code points that repeated n-grams of each length may cover.
NGRAM_LIMITS = {5: 40, 7: 35, 10: 30}
#: Percent of a text's word code points that lines equal to an earlier line may hold.
LINE_LIMIT = 30
MIN_WORDS, MAX_REPEAT = 50, 50
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in NGRAM_LIMITS)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measure(texts: list[str | bytes | None]) -> dict[str, np.ndarray]:
    """The counts of RESULT for each text."""
    t = Texts(texts)
    n, doc, total = t.n, t.wdoc, len(t.wdoc)
    chars = t.word_points()
    out = {"n_words": t.n_words.astype(np.int64), "word_chars": _sum(doc, chars, n)}
    out["n_symbols"] = t.count_bytes(_SYMBOL)
    b, e, ldoc, first, last = t.lines()
    key = mix(t.hashes(b, e) + ldoc.astype(np.uint64))
    again = np.flatnonzero(repeated(key))
    if len(again):  # the first of equal lines stays out
        again = np.setdiff1d(again, again[np.unique(key[again], return_index=True)[1]], assume_unique=True)
    before = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    out["n_dup_lines"] = np.bincount(ldoc[again], minlength=n)
    out["dup_line_chars"] = _sum(ldoc[again], before[last[again]] - before[first[again]], n)
    words = t.words()
    for k in (3, *NGRAM_LIMITS):
        h, inside = ngrams(words, doc, k)
        h += doc[: len(h)].astype(np.uint64)
        begin = np.flatnonzero(inside)
        begin = begin[repeated(mix(h[begin] if len(begin) < len(h) else h))]
        cov = covered(begin, k, total)
        if k == 3:
            out["n_repeat_words"] = np.bincount(doc[cov], minlength=n)
        else:
            out[f"dup_chars_{k}"] = _sum(doc[cov], chars[cov], n)
    return out


def _sum(doc: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=x, minlength=n).astype(np.int64)


def repetition(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with the counts of RESULT, base_failed and kept. keep: columns of docs to carry (default: all but clashing ones)."""
    names = [f.split()[0] for f in RESULT.split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in {*names, "base_failed", "kept"}]
    carry = bound_batches(docs).select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("binary").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carry.schema if f.name != "__text"), RESULT])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in slices(batches, [*keep, "__text"], "__text"):
            m = measure(part["__text"].to_pylist())
            part = part.select(keep)
            for name in names:
                part = part.append_column(name, pa.array(m[name], pa.int64()))
            yield from part.combine_chunks().to_batches()

    out = carry.mapInArrow(run, schema)
    over = F.col("dup_line_chars") * 100 > F.col("word_chars") * LINE_LIMIT
    for k, limit in NGRAM_LIMITS.items():
        over = over | (F.col(f"dup_chars_{k}") * 100 > F.col("word_chars") * limit)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, with docs' columns, that the rules keep."""
    tagged = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{text}`").alias("__in"))
    return repetition(tagged, "__in", ["__row"]).filter("kept").select("__row.*")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return repetition(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def oracle() -> str:
    """DuckDB SQL for op3_quality_rules: windows as joined words, coverage as a moving maximum."""
    cov = []
    for k in (3, *NGRAM_LIMITS):
        cov.append(f"""g{k} AS (SELECT doc_id, p, CASE WHEN p + {k - 1} <= n THEN array_to_string(ws[p:p+{k - 1}], ' ') END AS g FROM w),
        c{k} AS (SELECT doc_id, p, max(d) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS cov
                 FROM (SELECT doc_id, p, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS d FROM g{k})),
        s{k} AS (SELECT doc_id, sum(cov)::BIGINT AS words, sum(cov * length(w.word))::BIGINT AS chars FROM c{k} JOIN w USING (doc_id, p) GROUP BY doc_id)""")
    over = " OR ".join([f"100 * dup_line_chars > {LINE_LIMIT} * word_chars", *(f"100 * dup_chars_{k} > {v} * word_chars" for k, v in NGRAM_LIMITS.items())])
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, ws, len(ws) AS n, unnest(generate_series(1, len(ws))) AS p, unnest(ws) AS word FROM t),
b AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY doc_id),
l AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]')) AS chars, count(*) AS c
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) GROUP BY ALL),
d AS (SELECT doc_id, sum(c - 1)::BIGINT AS n_dup_lines, sum((c - 1) * chars)::BIGINT AS dup_line_chars FROM l WHERE chars > 0 GROUP BY doc_id),
{", ".join(cov)},
r AS (SELECT t.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(s3.words, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
        {", ".join(f"coalesce(s{k}.chars, 0)::BIGINT AS dup_chars_{k}" for k in NGRAM_LIMITS)}
      FROM t LEFT JOIN b USING (doc_id) LEFT JOIN d USING (doc_id) {" ".join(f"LEFT JOIN s{k} USING (doc_id)" for k in (3, *NGRAM_LIMITS))})
SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND NOT ({over}) AS kept FROM r"""
