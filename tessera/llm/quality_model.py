"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after the other and fits a shallow tree to the gradient on that
feature's bins, adding it to the feature's lookup table; afterwards the most promising pairs of features get
two-dimensional tables the same way. A score is a sum of table entries by vectorised bin lookups.
The tables are fitted on at most SAMPLE different labelled rows, chosen by hash; the texts of all documents are scored where they lie.

Cases: a null or empty text has all features 0 and is scored like any other; texts are measured whole; null labels
are not learned from; if the labels hold one class or none, every score is the smoothed rate; repeated rows score
equally; an empty table gives no rows; only doc_id and text of the documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, read, slices
from .ragged import Texts, covered, mix, ngrams, repeated

#: The most labelled rows that a model is fitted on.
SAMPLE = 20_000
FEATURES = ("log_words", "word_length", "symbols", "stops", "digits", "capitals", "distinct_words", "repeated_3grams", "equal_lines", "line_words", "short_words", "longest_word", "bare_symbols", "wide_chars")
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 6, 120, 60, 0.1


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = {"symbols": _class(b"#*$%&|<>"), "stops": _class(b".,;:!?"), "digits": _class(b"0123456789"), "capitals": _class(bytes(range(65, 91)))}


def features(texts: list[str | bytes | None]) -> np.ndarray:
    """A row of FEATURES for each text."""
    t = Texts(texts)
    n, doc, chars = t.n, t.wdoc, t.word_points()
    words = np.maximum(t.n_words, 1)
    count = lambda of: np.bincount(of, minlength=n)
    letters = np.maximum(np.bincount(doc, weights=chars, minlength=n), 1)
    f = {k: t.count_bytes(c) / letters for k, c in _CLASSES.items()}
    f["wide_chars"] = t.count_bytes(np.arange(256) >= 0xC0) / letters
    f["log_words"] = np.log1p(t.n_words)
    f["word_length"] = letters / words
    h = t.words()
    own = mix(h + doc.astype(np.uint64))
    f["distinct_words"] = 1 - count(doc[repeated(own)]) / words
    g, inside = ngrams(h, doc, 3)
    begin = np.flatnonzero(inside)
    begin = begin[repeated(mix(g[begin] + doc[begin].astype(np.uint64)))]
    f["repeated_3grams"] = count(doc[covered(begin, 3, len(doc))]) / words
    b, e, line, _, _ = t.lines()
    lines = np.maximum(count(line), 1)
    f["equal_lines"] = count(line[repeated(mix(t.hashes(b, e) + line.astype(np.uint64)))]) / lines
    f["line_words"] = np.log1p(t.n_words / lines)
    f["short_words"] = count(doc[chars <= 3]) / words
    longest = np.zeros(n)
    np.maximum.at(longest, doc, chars)
    f["longest_word"] = np.log1p(longest)
    first = _CLASSES["symbols"][t.buf[t.w0]] & (t.w1 - t.w0 == 1)
    f["bare_symbols"] = count(doc[first]) / words
    out = np.column_stack([f[k] for k in FEATURES])
    out[t.n_words == 0] = 0
    return out


def _halves(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The best cut of ordered bins and its gain."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a * a / (b + ridge) + (g.sum() - a) ** 2 / (h.sum() - b + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _step(g: np.ndarray, h: np.ndarray, leaves: int = 4, ridge: float = 5.0) -> np.ndarray:
    """A shallow tree over ordered bins: the value of each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_halves(g[a:b], h[a:b], ridge), a, b) for a, b in parts]
        gain, at, a, b = max(cuts)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _step2(g: np.ndarray, h: np.ndarray, ridge: float = 5.0) -> tuple[np.ndarray, float]:
    """A tree of depth two over a grid, its root on the better axis, and its gain."""
    best, gain = np.zeros_like(g), -1.0
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        for cut in range(1, len(gg)):
            out, won = np.zeros_like(gg), 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                a, b = gg[rows].sum(0), hh[rows].sum(0)
                v = _step(a, b, 2, ridge)
                out[rows] = v
                won -= float((a * v).sum())
            if won > gain:
                best, gain = (out.T if turn else out).copy(), won
    return best, gain


class Additive:
    """bias, a table per feature and tables of pairs, with the bin edges of both."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        y = y.astype(float)
        rate = (y.sum() + 1) / (len(y) + 2)
        self.bias = float(np.log(rate / (1 - rate)))
        k = len(FEATURES)
        cut = lambda c, n: np.unique(np.quantile(c, np.arange(1, n) / n)) if len(c) else np.zeros(0)
        self.edges = [cut(x[:, j], BINS) for j in range(k)]
        self.pair_edges = [cut(x[:, j], PAIR_BINS) for j in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []
        if y.min(initial=1) == y.max(initial=0):
            return
        b, total = self._bins(x, self.edges), np.full(len(y), self.bias)
        for _ in range(ROUNDS):
            for j, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-total))
                s = RATE * _step(np.bincount(b[j], p - y, len(table)), np.bincount(b[j], p * (1 - p), len(table)))
                table += s
                total += s[b[j]]
        b = self._bins(x, self.pair_edges)
        p = 1 / (1 + np.exp(-total))
        grid = lambda i, j, w: np.bincount(b[i] * (len(self.pair_edges[j]) + 1) + b[j], w, (len(self.pair_edges[i]) + 1) * (len(self.pair_edges[j]) + 1)).reshape(len(self.pair_edges[i]) + 1, -1)
        gains = sorted(((_step2(grid(i, j, p - y), grid(i, j, p * (1 - p)))[1], i, j) for i in range(k) for j in range(i)), reverse=True)
        self.pairs = [(i, j) for _, i, j in gains[:PAIRS]]
        self.grids = [np.zeros((len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1)) for i, j in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (i, j), table in zip(self.pairs, self.grids, strict=True):
                p = 1 / (1 + np.exp(-total))
                s = RATE * _step2(grid(i, j, p - y), grid(i, j, p * (1 - p)))[0]
                table += s
                total += s[b[i], b[j]]

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for table, b in zip(self.tables, self._bins(x, self.edges), strict=True):
            total += table[b]
        if self.pairs:
            b = self._bins(x, self.pair_edges)
            for (i, j), table in zip(self.pairs, self.grids, strict=True):
                total += table[b[i], b[j]]
        return 1 / (1 + np.exp(-total))


def measured(docs: DataFrame, keep: list[str], text: str = "text", model: Additive | None = None) -> DataFrame:
    """keep with features array<double>, or with the model's score."""
    carry = bound_batches(docs).select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("binary").alias("__text"))
    result = "features array<double>" if model is None else "score double"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carry.schema if f.name != "__text"), result])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in slices(batches, [*keep, "__text"], "__text"):
            x = features(part["__text"].to_pylist())
            new = pa.array(list(x), pa.list_(pa.float64())) if model is None else pa.array(model.score(x))
            yield from part.select(keep).append_column(result.split()[0], new).combine_chunks().to_batches()

    return carry.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Additive:
    """Learn from the labelled rows given: at most `most` different (doc_id, text, label), the least by hash; so repeated rows count once."""
    chosen = labels.filter(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("__y")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "__y").limit(most)
    key = ["doc_id", "__h", "__y"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("__h"), "text").join(F.broadcast(chosen), "doc_id")
    rows = measured(rows, key).groupBy(*key).agg(F.first("features").alias("features"))  # equal texts have equal features
    rows = rows.orderBy(F.xxhash64(*key), *key).limit(most).toPandas()
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, rows["__y"].to_numpy(float)))  # the fit does not depend on the order of arrival
    return Additive(x[order], rows["__y"].to_numpy(float)[order])


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of doc_id as text, modulo `of`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def op9_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 4) != 2))
    out = measured(docs, ["doc_id"], model=model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
