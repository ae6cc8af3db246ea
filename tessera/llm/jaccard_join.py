"""N-gram Jaccard join with Bayesian candidate pruning.

A text's n-grams are runs of N words (a shorter text is one n-gram). Texts with the same words collapse into one first,
numbered by a long. MinHash bands of ROWS values propose candidates: at similarity 0.8 a pair escapes all BANDS bands with
probability (1 - 0.8^6)^42 < 3e-6. A pair is a candidate if it shares a bucket, at every size of table and group. Texts joined by
buckets, directly or in a chain, form a candidate component (texts are read again and meet the components by shuffle, with one plan at every size); its n-gram sets go to one task, which compares the MinHash
values of candidates by and by, drops a pair as soon as the posterior probability of reaching the threshold (uniform prior) is
below TOLERANCE, and counts the n-grams of the rest exactly. A component over BLOCK texts is worked by its buckets instead,
and a bucket over BLOCK in pairs of blocks; a pair then counts where its first common band is. Both ways find the same pairs.
Tasks return a link count and one edge to a root per text, never pairs. Hot buckets, components, classes and texts
meet their partners by broadcast (common.join_unique).

Cases: texts without words (null, empty, white space) have no n-grams, no links, and are their own class; copies link to each
other and share all links of their text; texts of any length are taken whole; repeated rows count as copies; ids may be null
or repeat (a class is named by its smallest id, a class of null ids by null); an empty table gives no rows; other
columns are ignored by links() and kept by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, durable, groups, join_unique, read, slices
from .components import components
from .ragged import Texts, mix, ngrams

N, THRESHOLD = 5, 0.8
BANDS, ROWS = 42, 6
HASHES = BANDS * ROWS
CHUNK = 36
TOLERANCE = 1e-7
BLOCK = 1500
#: N-grams hashed at once: a few cache blocks.
AT_ONCE = 1 << 15
_rng = np.random.default_rng(99)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64)


def names(text: Column) -> list[Column]:
    """x1, x2: two hashes that together name a text byte for byte, cheap enough to be taken again in each scan."""
    return [F.xxhash64(text).alias("x1"), F.xxhash64(F.lit(7), text).alias("x2")]


def digests(t: Texts, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes that together name the word sequence of each text, whatever white space is between the words: 0, 0 without words."""
    first = np.cumsum(t.n_words) - t.n_words
    place = (np.arange(len(words)) - np.repeat(first, t.n_words)).astype(np.uint64)
    out = []
    for by in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
        x, some = mix(words + place * by), np.flatnonzero(t.n_words)
        d = np.zeros(t.n, np.uint64)
        d[some] = np.add.reduceat(x, first[some]) if len(some) else 0
        out.append(d.view(np.int64))
    return out[0], out[1]


def shingles(t: Texts, words: np.ndarray, n: int = N) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    h, inside = ngrams(words, t.wdoc, n)
    h, doc = h[inside], t.wdoc[: len(h)][inside]
    bounds = np.searchsorted(doc, np.arange(t.n + 1))
    out = [np.unique(h[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    for i in np.flatnonzero((t.n_words > 0) & (t.n_words < n)):
        own = words[np.searchsorted(t.wdoc, i) :][: t.n_words[i]]
        out[i] = ngrams(own, np.zeros(len(own)), len(own))[0]
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[set, hash] MinHash values, some n-grams at a time; sets must not be empty."""
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.full((HASHES, len(sets)), (1 << 64) - 1, np.uint64)
    for a in range(0, len(x), AT_ONCE):
        part = x[a : a + AT_ONCE]
        held = slice(max(0, int(np.searchsorted(begin, a, "right")) - 1), int(np.searchsorted(begin, a + len(part), "left")))
        cut, y = np.maximum(begin[held] - a, 0), np.empty_like(part)
        for i in range(HASHES):
            np.multiply(part, _A[i], out=y)
            y += _B[i]
            np.minimum(out[i, held], np.minimum.reduceat(y, cut), out=out[i, held])
    return np.ascontiguousarray((out >> np.uint64(32)).astype(np.uint32).T)


def bands(sig: np.ndarray) -> np.ndarray:
    """[set, band] bucket keys."""
    key = np.zeros((len(sig), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j::ROWS])
    return key.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After k values: the fewest matches with P(similarity >= threshold | matches) >= tolerance.

    With a uniform prior that posterior is P(Binomial(k + 1, threshold) <= matches).
    """
    from math import comb

    out = {}
    for k in range(CHUNK, HASHES + 1, CHUNK):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out[k] = m
    return out


def similar_pairs(sets: list[np.ndarray], sig: np.ndarray, side: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[int, np.ndarray]]:
    """(i, partners j) of all pairs at or over the threshold; side: pairs join different sides, unless all are on one."""
    few = least_matches(threshold)
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    sets, sig, side, size = [sets[i] for i in order], sig[order], side[order], size[order]
    cross = len(np.unique(side)) > 1
    # Only n-grams of two or more sets can be common: the rest need no column.
    all_, back = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    common = np.bincount(back) > 1
    column = np.cumsum(common) - 1
    row, back = row[common[back]], column[back[common[back]]]
    width = int(common.sum())
    dense = len(sets) * width <= 1 << 25
    if dense:
        x = np.zeros((len(sets), width), np.float32)
        x[row, back] = 1
    for i in range(len(sets) - 1):
        end = np.searchsorted(size, np.floor(size[i] / threshold + 1e-9), "right")
        j = np.arange(i + 1, end)
        if cross:
            j = j[side[j] != side[i]]
        same = np.zeros(len(j), np.int64)
        for k in range(0, HASHES, CHUNK):
            if not len(j):
                break
            same = same + (sig[j, k : k + CHUNK] == sig[i, k : k + CHUNK]).sum(1)
            ok = same >= few[k + CHUNK]
            j, same = j[ok], same[ok]
        if not len(j):
            continue
        if dense:
            both = np.rint(x[j] @ x[i]).astype(np.int64)
        else:
            both = np.array([np.isin(sets[y], sets[i], assume_unique=True).sum() for y in j])
        j = j[both >= threshold * (size[i] + size[j] - both) - 1e-9]
        if len(j):
            yield int(order[i]), order[j]


def linked(sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Root and summed partner weight of each set. A pair counts if it has a common band; band >= 0: if its first common one is that."""
    n = len(sets)
    root, links = np.arange(n), np.zeros(n, np.int64)
    sig = signatures(sets)
    key = bands(sig)
    for i, j in similar_pairs(sets, sig, side):
        common = key[j] == key[i]
        j = j[common.any(1) & ((band < 0) | (common.argmax(1) == band))]
        if not len(j):
            continue
        links[i] += weight[j].sum()
        links[j] += weight[i]
        roots = np.unique(np.append(root[j], root[i]))
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]
    return root, links


def _rows(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Each row's doc_id, keep, x1, x2 (its text), d1, d2 (its word sequence), n (n-grams), words (their number) and bands."""
    d = docs.select("doc_id", *keep, *names(F.col(text)), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in slices(batches, ["doc_id", *keep, "x1", "x2", "text"], "text"):
            t = Texts(part["text"].to_pylist())
            words = t.words()
            sets = shingles(t, words)
            n = np.array([len(s) for s in sets], np.int64)
            key = np.zeros((0, BANDS), np.int64) if not n.any() else bands(signatures([s for s in sets if len(s)]))
            out = part.select(["doc_id", *keep, "x1", "x2"])
            for name, x in zip(("d1", "d2"), digests(t, words), strict=True):
                out = out.append_column(name, pa.array(x))
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            out = out.append_column("n", pa.array(n)).append_column("words", pa.array(t.n_words, pa.int64())).append_column("bands", pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.ravel())))
            yield from out.combine_chunks().to_batches()

    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    return d.mapInArrow(run, f"{kept}, x1 long, x2 long, d1 long, d2 long, n long, words long, bands array<long>")


def _compare(work: DataFrame) -> DataFrame:
    """work: g, i, j, side, band, t, m, grams. Returns t, root, links of texts with a link in their group."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, parts in groups(batches, 3):
            rows = pa.Table.from_batches(parts)
            t = rows["t"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))  # rows of one id and text are one
            rows, t = (rows.take(pa.array(first)), t[first]) if len(first) < len(t) else (rows, t)
            sets = [np.frombuffer(x, np.uint64) for x in rows["grams"].to_pylist()]
            root, links = linked(sets, rows["m"].to_numpy(), rows["side"].to_numpy(), rows["band"][0].as_py())
            hit = np.flatnonzero(links)
            yield pa.record_batch([pa.array(t[hit]), pa.array(t[root[hit]]), pa.array(links[hit])], names=["t", "root", "links"])

    parts = work.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "t")
    return parts.select("g", "i", "j", "side", "band", "t", "m", "grams").mapInArrow(run, "t long, root long, links long")


def classes(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows (see _rows), and for each distinct word sequence: t, d1, d2, rep (doc_id, x1, x2 of the row with the smallest id), m (rows),
    n, class_id (smallest id of its class), class_name (a long that names the class), links (linked rows of other sequences) and of (sequences in its class)."""
    rows = durable(_rows(bound_batches(docs), text, keep), "jaccard-rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x1", "x2"))
    texts = rows.groupBy("d1", "d2").agg(least.alias("rep"), F.count(F.lit(1)).alias("m"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    texts = durable(texts.withColumn("t", F.monotonically_increasing_id()), "jaccard-texts")
    n_texts = texts.count()
    keys = texts.select("t", F.posexplode("bands").alias("band", "key"))
    buckets = keys.groupBy("key").agg(F.min("t").alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    keys = durable(join_unique(keys, durable(buckets, "jaccard-buckets"), ["key"], "size", n_texts * BANDS), "jaccard-keys")
    parts = durable(components(keys.select(F.col("t").alias("a"), F.col("first").alias("b")), "jaccard-near"), "jaccard-candidates")
    size = parts.groupBy("root").agg(F.count(F.lit(1)).alias("of"))
    parts = durable(join_unique(parts, size, ["root"], "of", n_texts), "jaccard-parts")
    small = parts.filter(F.col("of") <= BLOCK).select(F.col("node").alias("t"), F.xxhash64("root").alias("g"), F.lit(-1).alias("band"), "of")
    large = keys.join(parts.filter(F.col("of") > BLOCK).select(F.col("node").alias("t")), "t").select("t", F.xxhash64("key", "band").alias("g"), "band", F.col("size").alias("of"))
    work = small.unionByName(large).withColumn("blocks", F.ceil(F.col("of") / BLOCK).cast("int")).withColumn("side", F.pmod(F.xxhash64("t"), "blocks").cast("int"))
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.select("t", "g", "band", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    of_row = lambda *row: [F.xxhash64(*row).alias("k1"), F.xxhash64(F.lit(7), *row).alias("k2")]
    need = texts.join(parts.select(F.col("node").alias("t")), "t").select("t", "m", *of_row("rep.x1", "rep.x2", "rep.doc_id"))
    need = durable(need, "jaccard-need")
    d = docs.select("doc_id", *names(F.col(text)), F.col(text).cast("binary").alias("text")).select(*of_row("x1", "x2", "doc_id"), "text")
    d = join_unique(d, need, ["k1", "k2"], "m", rows.count()).select("t", "m", "text")

    def grams(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in slices(batches, ["t", "m", "text"], "text"):
            of = Texts(part["text"].to_pylist())
            sets = shingles(of, of.words())
            yield from part.select(["t", "m"]).append_column("grams", pa.array([s.tobytes() for s in sets], pa.binary())).combine_chunks().to_batches()

    found = durable(_compare(work.join(d.mapInArrow(grams, "t long, m long, grams binary"), "t")), "jaccard-links")
    roots = components(found.select(F.col("t").alias("a"), F.col("root").alias("b")), "jaccard-stars")
    links = found.groupBy("t").agg(F.sum("links").alias("links"))
    out = texts.drop("bands").join(roots.withColumnRenamed("node", "t"), "t", "left").join(links, "t", "left")
    out = durable(out.withColumn("root", F.coalesce("root", "t")).withColumn("links", F.coalesce("links", F.lit(0))), "jaccard-linked")
    named = out.groupBy("root").agg(F.min("rep.doc_id").alias("class_id"), F.min(F.xxhash64("d1", "d2")).alias("class_name"), F.count(F.lit(1)).alias("of"))
    return rows, durable(join_unique(out, named, ["root"], "of", n_texts), "jaccard-classes")


def links(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row's doc_id, class_id (smallest id of its class) and n_links (other rows at or over the threshold)."""
    rows, c = classes(docs, text)
    d = join_unique(rows.select("doc_id", "d1", "d2"), c.select("d1", "d2", "class_id", "m", "n", "links"), ["d1", "d2"], "m", rows.count())
    some = F.col("n") > 0
    return d.select("doc_id", F.when(some, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(some, F.col("m") - 1 + F.col("links")).otherwise(0).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs without all but one row of each class: that of the smallest id. Texts without words all stay."""
    rows, c = classes(docs, text)
    other = F.coalesce(F.col("rep.doc_id") != F.col("class_id"), F.lit(False))
    best = c.filter("n > 0").groupBy("root").agg(F.min(F.struct(other, "d1", "d2", F.col("rep").alias("rep"))).alias("x"))
    stay = durable(best.select(F.col("x.rep.x1").alias("__x1"), F.col("x.rep.x2").alias("__x2"), F.col("x.rep.doc_id").alias("__id")), "jaccard-stay")
    of = lambda a, b, i: (a == F.col("__x1")) & (b == F.col("__x2")) & i.eqNullSafe(F.col("__id"))
    kept = docs.join(stay, of(*names(F.col(f"`{text}`")), F.col("doc_id")))
    again = rows.groupBy("x1", "x2", "doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not again.join(stay, of(F.col("x1"), F.col("x2"), F.col("doc_id")), "left_semi").isEmpty():  # rows of one id and text: one of them
        kept = kept.dropDuplicates(["__x1", "__x2", "__id"])
    empty = docs.filter(~F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(empty)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return links(read(spark, sf_dir, "documents").select("doc_id", "text"))


def oracle() -> str:
    """DuckDB SQL for op8_jaccard_join: all pairs that share an n-gram, and the closure of the links."""
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(1, len(w) - {N - 1})), lambda i: array_to_string(w[i:i+{N - 1}], ' '))) AS g FROM t WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {THRESHOLD} * (x.n + y.n - c) - 1e-9),
r AS (SELECT doc_id, doc_id AS near FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.near)
SELECT doc_id, min(near) AS class_id, (SELECT count(*) FROM l WHERE l.a = r.doc_id)::BIGINT AS n_links FROM r GROUP BY doc_id"""
