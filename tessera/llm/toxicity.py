"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model of their votes, and a linear classifier trained on its posterior labels.

A term is a whole word or a word's first 3 to 8 bytes, in lower case. Terms that the labelled sample finds far more often in toxic texts make the lexica,
one for each family of terms; every lexicon votes once in each third of a text, pattern voters on the whole text. A voter
says toxic, clean or nothing. The label model sees only how votes vary together over all documents: the covariance of two voters
that are independent given the class is the product of what each gains from the class, so a rank-one fit gives every accuracy; pairs that
vary together far beyond it are correlated, stay out of the fit and enter the posterior along a spanning forest. Posteriors of the sample, in which the
annotator is one voter more, train a logistic regression on the rates of terms, by which whole texts are scored where they lie.

The sample is bounded by SAMPLE rows and chosen by hash; votes are counted over all documents.

Cases: a null or empty text has no terms and scores like any text without; texts are read whole; null labels are not learned from; if the
labels hold one class or none, every score is the smoothed rate; repeated rows score equally and are learned from once; an empty table gives no rows; of the documents only
doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop, durable, read, slices
from .quality_model import fold
from .ragged import Texts

#: The most labelled rows that are learned from, and the most terms of the lexica together.
SAMPLE, TERMS = 20_000, 2048
#: Bytes of the word beginnings that are terms; 0 stands for the whole word. A term's kind is its place in this list.
KINDS = (0, 3, 4, 5, 6, 7, 8)
FAMILY = np.array([0, 1, 1, 2, 2, 3, 3])
FAMILIES, PARTS = 4, 3
#: A term is kept from this likelihood ratio on (a chance of 1 in 1000), and votes if this share of the texts with it is toxic.
RATIO, SHARE = 10.8, 0.4
#: Words that a part of a text must have for its silence to count, and words that rates are at least taken over.
LEAST, SHORT = 8, 20
PATTERNS = ("shouting", "masked", "stretched", "often")
VOTERS = FAMILIES * PARTS + len(PATTERNS)

_LOWER = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_RAW = np.arange(256)
_LETTER = ((_RAW | 32) >= 97) & ((_RAW | 32) <= 122) & (_RAW < 128)
_CAPITAL = (_RAW >= 65) & (_RAW <= 90)
_MASK = np.isin(_RAW, list(b"*@$#"))


def words(texts: list[bytes | None]) -> Texts:
    """Runs of letters, in lower case, as words."""
    return Texts([(x or b"").decode("utf-8", "replace").lower().encode("utf-8", "surrogatepass").translate(_LOWER) for x in texts])


def terms(t: Texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each kind: kind, terms in the order of words, and their words. The last three bits of a term are its kind."""
    size = t.w1 - t.w0
    for kind, n in enumerate(KINDS):
        at = np.flatnonzero(size >= n)
        begin = t.w0[at]
        h = t.hashes(begin, begin + n if n else t.w1)
        yield kind, (h >> np.uint64(3) << np.uint64(3) | np.uint64(kind)), at


def find(t: Texts, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in keys (sorted) of all terms found, and their words."""
    found, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(keys):
        for _, h, at in terms(t):
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = np.flatnonzero(keys[i] == h)
            found.append(i[hit])
            where.append(at[hit])
    return np.concatenate(found), np.concatenate(where)


def patterns(texts: list[bytes | None]) -> np.ndarray:
    """1 for each text and pattern that is there: half of at least eight letters are capitals beside an exclamation mark; a mark inside a word; a letter four times in a row."""
    out = np.zeros((len(texts), 3), np.int8)
    for i, x in enumerate(texts):
        b = np.frombuffer(x or b"", np.uint8)
        if len(b) < 3:
            continue
        letter = _LETTER[b]
        n = int(letter.sum())
        out[i, 0] = n >= 8 and 2 * int(_CAPITAL[b].sum()) >= n and b"!" in x
        out[i, 1] = bool((letter[:-2] & _MASK[b[1:-1]] & letter[2:]).any())
        same = letter[1:] & (b[1:] == b[:-1])
        out[i, 2] = bool((same[:-2] & same[1:-1] & same[2:]).any())
    return out


def votes(texts: list[bytes | None], t: Texts, found: np.ndarray, where: np.ndarray, keys: np.ndarray, says: np.ndarray) -> np.ndarray:
    """1 (toxic), -1 (clean) or 0 for each text and voter; says: which keys belong to a lexicon."""
    n, begin = t.n, np.concatenate([[0], np.cumsum(t.n_words)])
    part = lambda w: (w - begin[t.wdoc[w]]) * PARTS // t.n_words[t.wdoc[w]]
    at = says[found] if len(found) else np.zeros(0, bool)
    i, w = found[at], where[at]
    family = FAMILY[(keys[i] & np.uint64(7)).astype(int)] if len(i) else np.zeros(0, int)
    hits = np.bincount((t.wdoc[w] * FAMILIES + family) * PARTS + part(w), minlength=n * FAMILIES * PARTS).reshape(n, FAMILIES, PARTS)
    every = np.arange(len(t.w0))
    size = np.bincount(t.wdoc * PARTS + part(every), minlength=n * PARTS).reshape(n, 1, PARTS)
    lexica = np.where(hits > 0, 1, np.where(size >= LEAST, -1, 0)).reshape(n, -1)
    whole = np.bincount(t.wdoc[np.unique(w)], minlength=n)
    often = np.where(whole >= 3, 1, np.where((whole == 0) & (t.n_words >= PARTS * LEAST), -1, 0))
    return np.column_stack([lexica, patterns(texts), often]).astype(np.int8)


class LabelModel:
    """Accuracies and correlations of voters from the moments of their votes over unlabelled texts."""

    def __init__(self, rate: float, pairs: np.ndarray, sums: np.ndarray, products: np.ndarray, rounds: int = 4, away: float = 0.1):
        """pairs[i, j]: texts on which both vote; sums[i, j]: sum of the votes of i on these; products[i, j]: sum of products. rate: share of toxic texts."""
        m = len(pairs)
        self.rate = rate
        both = np.maximum(pairs, 1)
        cov = np.where(pairs >= 30, products / both - (sums / both) * (sums / both).T, 0.0)
        mean = np.diag(sums) / np.diag(both)
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        others = ~np.eye(m, dtype=bool) & (pairs >= 30)
        keep = others.copy()
        for _ in range(rounds):
            z = np.where(spread > 1e-4, 0.3 * spread, 0.0)
            for _ in range(400):  # alternating least squares of cov ~ z zᵀ over the pairs kept
                z = 0.5 * z + 0.5 * np.where(keep, cov, 0) @ z / np.maximum(np.where(keep, z * z, 0).sum(1), 1e-9)
            z = z if z.sum() >= 0 else -z
            rest = np.where(others, cov - np.outer(z, z), 0)
            relative = rest / np.outer(spread, spread)
            now = others & (np.abs(relative) <= away)
            poor = now.sum(1) < 3  # a voter with no independent partners left is fitted to all
            now[poor] = others[poor]
            keep = now & now.T
        gain = np.clip(z, 0, None) / np.sqrt(rate * (1 - rate))  # a voter that speaks against the others says nothing
        active = (np.diag(pairs) >= 30) & (gain > 0)
        self.hit = np.where(active, np.clip((1 + mean + (1 - rate) * gain) / 2, 0.01, 0.995), 0.5)  # P(toxic vote | toxic)
        self.miss = np.where(active, np.clip((1 + mean - rate * gain) / 2, 0.005, 0.99), 0.5)  # P(toxic vote | clean)
        self.edges = self._forest(np.where(active[:, None] & active, relative, 0), away)
        sd = [2 * np.sqrt(e * (1 - e)) for e in (self.hit, self.miss)]
        self.rho = [rest[a, b] / (rate * sd[0][a] * sd[0][b] + (1 - rate) * sd[1][a] * sd[1][b]) for a, b in self.edges]

    @staticmethod
    def _forest(relative: np.ndarray, away: float) -> list[tuple[int, int]]:
        """The pairs of a spanning forest of the strongest correlations."""
        root = list(range(len(relative)))

        def top(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        out = []
        pairs = [(abs(relative[a, b]), a, b) for a in range(len(relative)) for b in range(a) if abs(relative[a, b]) > away]
        for _, a, b in sorted(pairs, reverse=True):
            if top(a) != top(b):
                root[top(a)] = top(b)
                out.append((a, b))
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes) of each row."""
        odds = np.full(len(votes), np.log(self.rate / (1 - self.rate)))
        for sign, e in ((1, self.hit), (-1, self.miss)):
            one = np.where(votes > 0, np.log(e), np.where(votes < 0, np.log(1 - e), 0.0))
            odds += sign * one.sum(1)
            for (a, b), rho in zip(self.edges, self.rho, strict=True):
                pa, pb = e[a], e[b]
                joint = np.clip(pa * pb + rho * np.sqrt(pa * (1 - pa) * pb * (1 - pb)), max(0, pa + pb - 1) + 1e-4, min(pa, pb) - 1e-4)
                cell = np.log(np.array([[1 - pa - pb + joint, pb - joint], [pa - joint, joint]])) - np.log(np.outer([1 - pa, pa], [1 - pb, pb]))
                both = (votes[:, a] != 0) & (votes[:, b] != 0)
                odds += sign * np.where(both, cell[(votes[:, a] > 0).astype(int), (votes[:, b] > 0).astype(int)], 0.0)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def with_annotator(posterior: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Posteriors after the annotator's vote, whose accuracy is its agreement with the other voters."""
    hit = (posterior @ label + 1) / (posterior.sum() + 2)
    miss = ((1 - posterior) @ label + 1) / ((1 - posterior).sum() + 2)
    odds = np.log(posterior / (1 - posterior)) + np.where(label == 1, np.log(hit / miss), np.log((1 - hit) / (1 - miss)))
    return 1 / (1 + np.exp(-odds))


def linear(doc: np.ndarray, term: np.ndarray, value: np.ndarray, target: np.ndarray, width: int, ridge: float = 0.5, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, sparse rows given as triples."""
    rate = float(np.clip(target.mean(), 1e-6, 1 - 1e-6))
    w, b = np.zeros(width), float(np.log(rate / (1 - rate)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for k in range(1, steps + 1):
        s = np.bincount(doc, w[term] * value, len(target)) + b
        g = 1 / (1 + np.exp(-s)) - target
        grad = np.append(np.bincount(term, g[doc] * value, width) + ridge * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.03 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def rates(t: Texts, found: np.ndarray, where: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, terms and values: the square root of how often a term comes in a hundred words."""
    pair, count = np.unique(t.wdoc[where].astype(np.int64) * max(width, 1) + found, return_counts=True)
    doc = pair // max(width, 1)
    return doc, pair % max(width, 1), np.sqrt(100 * count / np.maximum(t.n_words[doc], SHORT))


class Toxicity:
    """keys: the terms, sorted; says: those in a lexicon; after train(): the label model, weights and bias."""

    def __init__(self, keys: np.ndarray, says: np.ndarray, bias: float = 0.0):
        self.keys, self.says, self.weights, self.bias, self.labels = keys, says, np.zeros(len(keys)), bias, None

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        t = words(texts)
        doc, term, value = rates(t, *find(t, self.keys), len(self.keys))
        return 1 / (1 + np.exp(-np.clip(np.bincount(doc, self.weights[term] * value, t.n) + self.bias, -700, 700)))

    def votes(self, texts: list[bytes | None]) -> np.ndarray:
        t = words(texts)
        return votes(texts, t, *find(t, self.keys), self.keys, self.says)


def _arrow(rows: DataFrame, keep: list[str], work, schema: str, text: str = "text") -> DataFrame:
    """work(texts, table of the columns kept) -> record batch, for slices of the rows."""
    carry = bound_batches(rows).select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("binary").alias("__text"))

    def run(batches: Iterator) -> Iterator:
        for part in slices(batches, [*keep, "__text"], "__text"):
            yield from work(part["__text"].to_pylist(), part.select(keep))

    return carry.mapInArrow(run, schema)


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """row, y, text: at most `most` different labelled (doc_id, text, label), the least by hash; stored."""
    chosen = labels.filter(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    key = F.xxhash64("doc_id", "h", "y")
    keys = texts.select("doc_id", "h").join(F.broadcast(chosen), "doc_id").distinct().orderBy(key, "doc_id", "h", "y").limit(most)
    rows = texts.join(F.broadcast(keys), ["doc_id", "h"]).groupBy("doc_id", "h", "y").agg(F.first("text").alias("text"))
    return durable(rows.select(key.alias("row"), "y", "text"), "toxicity-sample")


def _counts(rows: DataFrame) -> DataFrame:
    """term, toxic, texts: in how many texts of the sample a term is."""

    def work(texts, kept):
        import pyarrow as pa

        t, y = words(texts), kept["y"].to_numpy()
        for _, h, at in terms(t):
            o = np.argsort(h, kind="stable")
            h, doc = h[o], t.wdoc[at[o]]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[new], doc[new]
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
            if len(begin):
                toxic = np.add.reduceat((y[doc] == 1).astype(np.int64), begin)
                yield pa.record_batch([pa.array(h[begin].view(np.int64)), pa.array(toxic), pa.array(np.diff(np.append(begin, len(h))))], names=["term", "toxic", "texts"])

    return _arrow(rows, ["y"], work, "term long, toxic long, texts long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts"))


def lexica(rows: DataFrame, toxic: int, total: int, most: int = TERMS) -> Toxicity:
    """The terms with the largest likelihood ratios among those that are more frequent in toxic texts."""
    a, b, n1, n0 = F.col("toxic"), F.col("texts") - F.col("toxic"), float(toxic), float(total - toxic)
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    with_, without = F.col("texts") / total, (total - F.col("texts")) / total
    ratio = 2 * (part(a, with_ * n1) + part(b, with_ * n0) + part(n1 - a, without * n1) + part(n0 - b, without * n0))
    found = _counts(rows).filter(a * n0 > b * n1).withColumn("ratio", ratio).filter(F.col("ratio") >= RATIO)
    share = (a + 0.5 * toxic / total) / (F.col("texts") + 0.5)
    best = found.orderBy(F.desc("ratio"), "term").limit(most).select("term", (share >= SHARE).alias("says")).toPandas()
    keys = best["term"].to_numpy(np.int64).view(np.uint64)
    o = np.argsort(keys)
    return Toxicity(keys[o], best["says"].to_numpy(bool)[o])


def moments(docs: DataFrame, model: Toxicity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all documents, for each pair of voters: texts on which both vote, sums of the first's votes on these, sums of products."""

    def work(texts, kept):
        import pyarrow as pa

        v = model.votes(texts).astype(np.int64)
        a = np.abs(v)
        yield pa.record_batch([pa.array(np.arange(3 * VOTERS * VOTERS, dtype=np.int32)), pa.array(np.stack([a.T @ a, v.T @ a, v.T @ v]).ravel())], names=["cell", "total"])

    cells = _arrow(docs.select("text"), [], work, "cell int, total long").groupBy("cell").agg(F.sum("total").alias("total")).toPandas()
    out = np.zeros(3 * VOTERS * VOTERS)
    out[cells["cell"].to_numpy(int)] = cells["total"].to_numpy(float)
    return tuple(out.reshape(3, VOTERS, VOTERS))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Toxicity:
    rows = sample(docs, labels, label, most)
    toxic, total = (int(x or 0) for x in rows.agg(F.sum("y"), F.count("y")).first())
    rate = (toxic + 1) / (total + 2)
    if not 0 < toxic < total:
        return Toxicity(np.zeros(0, np.uint64), np.zeros(0, bool), float(np.log(rate / (1 - rate))))
    model = lexica(rows, toxic, total)
    model.labels = LabelModel(rate, *moments(docs, model))

    def work(texts, kept):
        import pyarrow as pa

        t = words(texts)
        found, where = find(t, model.keys)
        doc, term, value = rates(t, found, where, len(model.keys))
        cut = np.searchsorted(doc, np.arange(t.n + 1))
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, kind))
        v = votes(texts, t, found, where, model.keys, model.says)
        yield pa.record_batch([*(c.combine_chunks() for c in kept.columns), lists(term, pa.int32()), lists(value, pa.float64()), pa.array(list(v.astype(np.int32)), pa.list_(pa.int32()))], names=["row", "y", "terms", "rates", "votes"])

    seen = _arrow(rows, ["row", "y"], work, "row long, y int, terms array<int>, rates array<double>, votes array<int>").toPandas().sort_values(["row", "y"])
    drop(rows)
    size = seen["terms"].map(len).to_numpy()
    flat = lambda c, kind: np.concatenate([np.zeros(0, kind), *seen[c]]).astype(kind)
    target = with_annotator(model.labels.posterior(np.stack(seen["votes"].to_list())), seen["y"].to_numpy(float))
    model.weights, model.bias = linear(np.repeat(np.arange(len(seen)), size), flat("terms", int), flat("rates", float), target, len(model.keys))
    return model


def scored(docs: DataFrame, model: Toxicity, keep: list[str]) -> DataFrame:
    """keep and score, the probability of a toxic text."""

    def work(texts, kept):
        import pyarrow as pa

        yield from kept.append_column("score", pa.array(model.score(texts))).combine_chunks().to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return _arrow(docs, keep, work, f"{fields}, score double")


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 4) != 2))
    out = scored(docs, model, ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
