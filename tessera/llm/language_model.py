"""Language-model scores of a log-bilinear model trained by noise-contrastive estimation.

A word is predicted in two factors. First its class: the HEAD commonest words are classes of their own, all others share
TAIL classes by a hash of their last two bytes. For each of POSITIONS places before the word, score(context, class) =
r(class) . q(context) + b(class), so one matrix product gives all scores and their row-wise softmax the normalised probabilities;
the places are mixed with weights that depend on the class just before. Then the word inside its tail class: every word that
occurs LEAST times in training, however many there are, has a vector of its own over the same q(context), with a softmax
inside the class. All that is learned comes from counts over all training texts, made on the executors; numpy maximises the
noise-contrastive objective over them with unigram noise, its expectation summed exactly for classes and over sampled contexts for
words inside their class. Rarer words share
what the learned ones leave of their class, each with (c + 1) / (words + kinds + 1) of it, the rest being for unseen words, so the
probabilities of all words sum to 1.

Counts and vectors of all words stay distributed: the commonest KNOWN are broadcast (a fixed bound), the others are joined.
Texts are looked up in that table once and stored as numbers, which the later passes read. What tasks have counted travels as one
row for each word (or place and context) with all its counts, not as a row for each count.

Cases: a null or empty text is its end token alone; texts are scored whole; repeated rows score equally, row by row;
with no training rows every count is 0 and the model uniform; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, durable, read, slices

HEAD, TAIL, KNOWN = 1024, 128, 262_144
SIZE, NOISE, STEPS, LEARN = 32, 10, 240, 0.05
#: Unigram tokens that each context is taken to have been followed by besides its own: a prior for rare contexts.
PRIOR = 50.0
#: The end of a text as a token: a separator, so never a word.
END = b"\n"
HELD = 300_000
#: Places before a word that predict its class, and the mixes of them of which each class just before takes the likeliest.
POSITIONS = 3
MIXES = np.array([(1, 0, 0), (0.9, 0.07, 0.03), (0.8, 0.13, 0.07), (0.7, 0.2, 0.1), (0.6, 0.25, 0.15), (0.5, 0.3, 0.2), (0.4, 0.35, 0.25), (0.34, 0.33, 0.33)])
#: Occurrences in training from which a word outside the head has a vector; how these are fitted, and words in one matrix.
LEAST, WORD_STEPS, WORD_LEARN, AT_ONCE = 10, 24, 0.15, 4096
#: Contexts that stand for all in the noise of words inside their class.
CONTEXTS = 192
#: From this many contexts a word on, a table of all contexts is cheaper than a list of those seen; both give the same.
DENSE = 24
#: Bytes of partial counts that are summed at once.
BYTES_AT_ONCE = 16 << 20
#: Slots (a power of two) of the filter that spares learned words outside the table from the company of words too rare to be learned. A full filter lets all pass.
SLOTS = 1 << 23


def tokens(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z only), then the end."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


def tail_class(word: bytes) -> int:
    return HEAD + zlib.crc32(word[-2:]) % TAIL


def tail_class_column(word: Column) -> Column:
    return (F.crc32(F.substring(word, -2, 2)) % TAIL + HEAD).cast("int")


def count_words(texts: DataFrame) -> DataFrame:
    """word binary, c long over the column text (binary): counted per task first, then summed."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()
        told = lambda: pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
        for part in slices(batches, ["text"], "text"):
            for t in part["text"].to_pylist():
                seen.update(tokens(t))
            if len(seen) > HELD:
                yield told()
                seen.clear()
        if seen:
            yield told()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The commonest words with their counts, the class of each, and the sums of the tail classes. mass: of c + 1 of each tail class's learned words."""

    def __init__(self, words: list[bytes], counts: list[int], tail_words: np.ndarray, tail_kinds: np.ndarray, mass: np.ndarray):
        self.at = {w: i for i, w in enumerate(words)}
        self.mass = mass
        self.more = len(words) == KNOWN and counts[-1] >= LEAST  # there may be learned words besides these
        self.counts = np.array([*counts, 0], np.float64)
        self.classes = np.array([*(i if i < HEAD else tail_class(w) for i, w in enumerate(words)), 0], np.int64)
        self.tail_log = np.zeros(HEAD + TAIL)
        self.tail_log[HEAD:] = np.log10(tail_words + tail_kinds + 1)

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Row in the table of each token; -1 - i if it is not there and in tail class i."""
        out = np.fromiter(map(self.at.get, words, repeat(-1)), np.int32, len(words))
        other = np.flatnonzero(out < 0)
        out[other] = [HEAD - 1 - tail_class(words[i]) for i in other.tolist()]
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row in the table (-1: not there) and class of each token."""
        rows = np.maximum(ids, -1)
        classes = self.classes[rows]
        other = np.flatnonzero(ids < 0)
        classes[other] = HEAD - 1 - ids[other]
        return rows, classes

    def classes_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.decode(self.ids(words))


def contexts(classes: np.ndarray, size: np.ndarray, end: int) -> np.ndarray:
    """[position, token] class at each place before a token of its text; before a text's begin stands the end."""
    at = np.arange(len(classes)) - np.repeat(np.cumsum(size) - size, size)
    out = np.full((POSITIONS, len(classes)), end)
    for j in range(POSITIONS):
        there = np.flatnonzero(at > j)
        out[j, there] = classes[there - j - 1]
    return out


def encode(docs: DataFrame, keep: list[str], vocabulary: Vocabulary) -> DataFrame:
    """keep with ids (Vocabulary.ids of a text's tokens, as int32) and lacks (its words that are not in the table, in order, with a space between)."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep), "ids binary, lacks binary"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in slices(batches, [*keep, "text"], "text"):
            ids, lacks = [], []
            for t in part["text"].to_pylist():
                words = tokens(t)
                own = vocabulary.ids(words)
                ids.append(own.tobytes())
                lacks.append(b" ".join([words[i] for i in np.flatnonzero(own < 0).tolist()]))
            yield from part.select(keep).append_column("ids", pa.array(ids, pa.binary())).append_column("lacks", pa.array(lacks, pa.binary())).combine_chunks().to_batches()

    return docs.mapInArrow(run, schema)


def read_tokens(part, vocabulary: Vocabulary) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text; all words that the table lacks; then of each token: its row, its class and the classes before it."""
    raw = part["ids"].to_pylist()
    size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    rows, c = vocabulary.decode(np.frombuffer(b"".join(raw), np.int32))
    lacks = b" ".join(filter(None, part["lacks"].to_pylist()))
    return size, lacks.split(b" ") if lacks else [], rows, c, contexts(c, size, int(vocabulary.classes_of([END])[1][0]))


def count_pairs(encoded: DataFrame, vocabulary: Vocabulary, n_learned: int) -> np.ndarray:
    """[position, context, class]: how often a class follows a context at a place. Each task sends what it has counted once, a row for each place and context."""
    k = HEAD + TAIL

    def told(which, rows) -> Iterator:
        import pyarrow as pa

        for i in range(0, len(which), 256):
            seen = [np.stack([at := np.flatnonzero(x), x[at]]).tobytes() for x in rows[i : i + 256]]
            yield pa.record_batch([pa.array(which[i : i + 256], pa.int32()), pa.array(seen, pa.binary())], names=["part", "seen"])

    def run(batches: Iterator) -> Iterator:
        seen = np.zeros((POSITIONS, k * k), np.int64)
        for part in slices(batches, ["ids", "lacks"], "ids"):
            _, _, _, c, before = read_tokens(part, vocabulary)
            for j in range(POSITIONS):
                np.add.at(seen[j], before[j] * k + c, 1)
        seen = seen.reshape(POSITIONS * k, k)
        which = np.flatnonzero(seen.any(1))
        for i in range(0, len(which), 256):
            yield from told(which[i : i + 256], seen[which[i : i + 256]])

    def total(batches: Iterator) -> Iterator:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch["part"].to_pylist(), batch["seen"].to_pylist(), strict=True):
                at, n = np.frombuffer(raw, np.int64).reshape(2, -1)
                sums.setdefault(part, np.zeros(k, np.int64))[at] += n
        yield from told(list(sums), list(sums.values()))

    found = encoded.mapInArrow(run, "part int, seen binary").repartition(min(POSITIONS * k, max(8, n_learned // 4096)), "part").mapInArrow(total, "part int, seen binary").toArrow()
    out = np.zeros((POSITIONS * k, k), np.int64)
    for part, raw in zip(found["part"].to_pylist(), found["seen"].to_pylist(), strict=True):
        at, n = np.frombuffer(raw, np.int64).reshape(2, -1)
        out[part, at] = n
    return out.reshape(POSITIONS, k, k)


def slots_of(counts: DataFrame, below: int) -> np.ndarray:
    """For each slot: whether some word that occurs LEAST times, and no more than below, has its crc32 there. A filter of SLOTS bits, whatever the number of words."""
    at = F.pmod(F.crc32("word"), F.lit(SLOTS))
    bits = counts.filter(F.col("c").between(LEAST, below)).select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    out = np.zeros((SLOTS // 32768, 4096), np.uint8)
    for r in bits.collect():
        out[r["b"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def count_contexts(encoded: DataFrame, vocabulary: Vocabulary, models: list[tuple], slots: np.ndarray) -> DataFrame:
    """word binary, seen binary: of a word outside the head, how often it follows which class (int64, times * classes + class). With word null, context int, mix int, n double: the log likelihood of each mix after a class."""
    k = HEAD + TAIL
    learned = (vocabulary.counts >= LEAST) & (vocabulary.classes >= HEAD)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("word", pa.binary()), ("seen", pa.binary()), ("context", pa.int32()), ("mix", pa.int32()), ("n", pa.float64())])
        table = pa.array(list(vocabulary.at), pa.binary())
        tables = [(10 ** log_table(m)).astype(np.float32) for m in models]
        likely = np.zeros((len(MIXES), k))
        keys, more, held, other = [], [], 0, {}

        def told(names, keys: list) -> Iterator:
            if not keys:
                return
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            word, context = key // k, key % k
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            offsets, seen = np.append(begin, len(key)).astype(np.int32), n * k + context
            for i in range(0, len(begin), 4096):
                at = offsets[i : i + 4097]
                raw = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at - at[0]) * np.int32(8)), pa.py_buffer(seen[at[0] : at[-1]])])
                none = [pa.nulls(len(raw), f.type) for f in list(schema)[2:]]
                yield pa.record_batch([names.take(pa.array(word[at[:-1]])), raw, *none], schema=schema)

        for part in slices(batches, ["ids", "lacks"], "ids"):
            _, lacks, rows, c, before = read_tokens(part, vocabulary)
            p = np.stack([t[b, c] for t, b in zip(tables, before, strict=True)])
            for g, mix in enumerate(MIXES.astype(np.float32)):
                likely[g] += np.bincount(before[0], np.log(mix @ p), k)
            at = np.flatnonzero((rows >= 0) & learned[rows])
            keys.append(rows[at].astype(np.int64) * k + before[0, at])
            held += len(at)
            if vocabulary.more:
                slot = np.fromiter(map(zlib.crc32, lacks), np.int64, len(lacks)) % SLOTS
                may = np.flatnonzero((slots[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                number = np.fromiter((other.setdefault(lacks[i], len(other)) for i in may.tolist()), np.int64, len(may))
                more.append(number * k + before[0, np.flatnonzero(rows < 0)[may]])
                held += len(may)
            if held > 2_000_000:
                yield from told(table, keys)
                yield from told(pa.array(list(other), pa.binary()), more)
                keys, more, held, other = [], [], 0, {}
        yield from told(table, keys)
        yield from told(pa.array(list(other), pa.binary()), more)
        size = likely.size
        yield pa.record_batch([pa.nulls(size, pa.binary()), pa.nulls(size, pa.binary()), pa.array(np.tile(np.arange(k), len(MIXES)), pa.int32()), pa.array(np.repeat(np.arange(len(MIXES)), k), pa.int32()), pa.array(likely.ravel())], schema=schema)

    return encoded.mapInArrow(run, "word binary, seen binary, context int, mix int, n double")


def train(pairs: np.ndarray, n: np.ndarray, classes: int = HEAD + TAIL, size: int = SIZE, steps: int = STEPS, prior: float = PRIOR, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word vectors, context vectors and biases by noise-contrastive estimation (Adam, all counts in each step)."""
    data = np.zeros(classes * classes, np.float32)
    data[pairs] = n
    data = data.reshape(classes, classes)
    noise = data.sum(0) + 1
    noise /= noise.sum()
    data += (prior * noise).astype(np.float32)
    data /= data.sum()
    context = data.sum(1)
    rng = np.random.default_rng(seed)
    r, q = (rng.standard_normal((classes, size)).astype(np.float32) * 0.1 for _ in range(2))
    b = np.log(noise).astype(np.float32)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (r, q, b)]
    shift = np.log(NOISE * noise).astype(np.float32)
    weight = (NOISE * context[:, None] * noise).astype(np.float32)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(q @ r.T + b - shift, -30, 30)))  # that a word comes from the data
        g = weight * p - data * (1 - p)
        for x, dx, (m, v) in zip((r, q, b), (g.T @ q, g @ r, g.sum(0)), state, strict=True):
            dx = dx * 1e3
            m += 0.1 * (dx - m)
            v += 0.01 * (dx * dx - v)
            x -= LEARN * min(1.0, 3 * (1 - t / (steps + 1))) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return r, q, b


def log_table(model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of each class (column) after each context (row)."""
    r, q, b = model
    s = (q @ r.T + b).astype(np.float64)
    s -= s.max(1, keepdims=True)
    return (s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)


def sampled_contexts(follow: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """CONTEXTS contexts, half by frequency and half at large, and weights that make sums over them estimates of sums over all."""
    often = follow.sum(1) + 1.0
    chance = 0.5 * often / often.sum() + 0.5 / len(often)
    pick = np.random.default_rng(seed).choice(len(often), CONTEXTS, p=chance)
    return pick, (1 / (CONTEXTS * chance[pick])).astype(np.float32)


def fit_words(own: np.ndarray, c: np.ndarray, begin: np.ndarray, contexts: np.ndarray, times: np.ndarray, follow: np.ndarray, mass: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and biases of words inside their classes (own), by noise-contrastive estimation: word w was seen times[i] after contexts[i], i from begin[w] on;
    its noise are its class's unigrams after sampled contexts. follow: how often each class follows each context; mass: of the classes."""
    share = ((c + 1) / mass[own]).astype(np.float32)
    scale = (1 / (c + PRIOR * len(q) * share)).astype(np.float32)
    pick, weight = sampled_contexts(follow)
    near, prior = q[pick], weight[:, None] * (PRIOR * share * scale)
    both = weight[:, None] * (follow[pick][:, own] + np.float32(PRIOR)) * (NOISE * share * scale) + prior  # the gradient is noise * p - data * (1 - p)
    word = np.repeat(np.arange(len(c)), np.diff(np.append(begin, len(contexts))))
    seen, at = times * scale[word], word * len(q) + contexts
    if dense := len(contexts) >= DENSE * len(c):
        pulls = np.zeros((len(c), len(q)), np.float32)
    else:
        there = q[contexts]
    shift = np.log(NOISE * share)
    r, b = np.zeros((len(c), q.shape[1]), np.float32), np.log(share)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (r, b)]
    chance = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for t in range(1, WORD_STEPS + 1):
        lift = b - shift
        g = both * chance(near @ r.T + lift) - prior
        s = seen * (chance(((r @ q.T).ravel()[at] if dense else np.einsum("ij,ij->i", there, r[word])) + lift[word]) - 1)
        if dense:
            pulls.ravel()[at] = s
        dr = g.T @ near + (pulls @ q if dense else np.add.reduceat(s[:, None] * there, begin))
        for x, dx, (m, v) in zip((r, b), (dr, g.sum(0) + np.add.reduceat(s, begin)), state, strict=True):
            m += 0.1 * (dx - m)
            v += 0.01 * (dx * dx - v)
            x -= WORD_LEARN * min(1.0, 2 * (1 - t / (WORD_STEPS + 1))) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return r, b


def word_vectors(words: DataFrame, follow: np.ndarray, mass: np.ndarray, q: np.ndarray) -> DataFrame:
    """words: word, seen (partial counts, see count_contexts). Returns word, c, v (vector and bias as float32) of words that occur LEAST times; and rows of class, z (partial sums of its normaliser after each context).

    Dealt and sorted by word, so that counts are summed here, BYTES_AT_ONCE at a time; a word with more partial counts than that is summed on the way.
    """
    k = HEAD + TAIL

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        z = np.zeros((TAIL, k))

        def summed() -> Iterator:
            """Words (in order, each whole) with their partial counts."""
            held: list = []
            size = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append(batch)
                size += batch.nbytes
                if size >= BYTES_AT_ONCE:
                    t = pa.Table.from_batches(held)
                    last = t["word"][-1]
                    cut = t.num_rows - pc.sum(pc.equal(t["word"], last)).as_py()
                    if cut:
                        yield t.slice(0, cut)
                    x = np.frombuffer(b"".join(t["seen"].slice(cut).to_pylist()), np.int64)  # the last word may go on
                    n = np.rint(np.bincount(x % k, x // k)).astype(np.int64)
                    at = np.flatnonzero(n)
                    held = [pa.record_batch([pa.array([last.as_py()], pa.binary()), pa.array([(n[at] * k + at).tobytes()], pa.binary())], schema=batch.schema)]  # in Spark's schema word is not null, and batches of one table must agree
                    size = held[0].nbytes
            if held:
                yield pa.Table.from_batches(held)

        for t in summed():
            code = t["word"].combine_chunks().dictionary_encode()  # sorted, so codes ascend
            raw = t["seen"].to_pylist()
            x = np.frombuffer(b"".join(raw), np.int64)
            at = np.repeat(code.indices.to_numpy(zero_copy_only=False).astype(np.int64) * k, np.fromiter(map(len, raw), np.int64, len(raw)) // 8) + x % k
            key, where = np.unique(at, return_inverse=True)
            n = np.bincount(where, x // k)
            of = key // k
            c_all = np.rint(np.bincount(of, n)).astype(np.int64)
            learned = np.flatnonzero(c_all >= LEAST)
            first, stop = np.searchsorted(of, np.arange(len(c_all))), np.searchsorted(of, np.arange(len(c_all)), "right")
            learned = learned[np.argsort(stop[learned] - first[learned], kind="stable")]  # words of like many contexts together
            for some in (learned[i : i + AT_ONCE] for i in range(0, len(learned), AT_ONCE)):
                take = np.concatenate([np.arange(a, b) for a, b in zip(first[some], stop[some], strict=True)])
                size = stop[some] - first[some]
                word, c = code.dictionary.take(pa.array(some)), c_all[some]
                own = np.array([tail_class(w) - HEAD for w in word.to_pylist()])
                r, b = fit_words(own, c, np.cumsum(size) - size, key[take] % k, n[take].astype(np.float32), follow, mass, q)
                order = np.argsort(own, kind="stable")
                kinds, begin = np.unique(own[order], return_index=True)
                for x, rows in zip(kinds, np.split(order, begin[1:]), strict=True):
                    z[x] += np.exp(q @ r[rows].T + b[rows]).sum(1, dtype=np.float64)
                v = np.column_stack([r, b]).astype(np.float32)
                yield pa.record_batch([word, pa.array(c), pa.array([x.tobytes() for x in v], pa.binary()), pa.nulls(len(c), pa.int32()), pa.nulls(len(c), pa.list_(pa.float64()))], names=["word", "c", "v", "class", "z"])
        some = np.flatnonzero(z.any(1))
        yield pa.record_batch([pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.array(some.astype(np.int32)), pa.array(list(z[some]), pa.list_(pa.float64()))], names=["word", "c", "v", "class", "z"])

    return words.mapInArrow(run, "word binary, c long, v binary, class int, z array<double>")


class Model(tuple):
    """(r, q, b) of the class just before a word; with it:

    positions: such models of all places; weights: [class just before, place]; norm: [tail class, context] log10 of a class's mass of
    learned words over its normaliser; known: vectors of the vocabulary's rows, at has; vectors: those of all learned words.
    """

    def word_log(self, tail: np.ndarray, context: np.ndarray, v: np.ndarray) -> np.ndarray:
        """log10 of (c + 1) as the learned second factor has it, for words of vector v after a context."""
        return ((self[1][context] * v[:, :-1]).sum(1) + v[:, -1]) / np.log(10) + self.norm[tail - HEAD, context]

    def class_logs(self):
        """A function of contexts [position, token] and classes: log10 probability of each class."""
        tables = [(10 ** log_table(m)).astype(np.float32) for m in self.positions]
        return lambda before, c: np.log10(sum(self.weights[before[0], j] * t[before[j], c] for j, t in enumerate(tables)))

    def without_table(self, known: bool = True) -> Model:
        """A copy that tasks can get."""
        out = Model(self)
        out.positions, out.weights, out.norm = self.positions, self.weights, self.norm
        if known:
            out.known, out.has = self.known, self.has
        return out


def score_texts(docs: DataFrame, keep: list[str], vocabulary: Vocabulary, model: Model) -> DataFrame:
    """docs: keep, ids, lacks (see encode). keep with n_tokens, what the table knows (known, base, score), and the words it lacks with the class before and their counts."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep), "row long, n_tokens long, known long, base double, score double, words array<binary>, contexts array<int>, times array<int>"])
    model = model.without_table()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        class_log, log_c = model.class_logs(), np.log10(vocabulary.counts + 1)
        row = TaskContext.get().partitionId() << 40
        in_tail = np.where(vocabulary.classes >= HEAD, log_c, 0)  # head words need no count inside their class
        for part in slices(batches, [*keep, "ids", "lacks"], "ids"):
            size, words, rows, c, before = read_tokens(part, vocabulary)
            begin = np.cumsum(size) - size
            there = rows >= 0
            score = class_log(before, c) + np.where(there, in_tail[rows], 0) - vocabulary.tail_log[c]
            at = np.flatnonzero(there & model.has[rows])
            score[at] += model.word_log(c[at], before[0, at], model.known[rows[at]]) - in_tail[rows[at]]
            lacks = np.flatnonzero(~there)
            other: list[Counter] = [Counter() for _ in size]
            for w, d, x in zip(words, (np.searchsorted(begin, lacks, "right") - 1).tolist(), (before[0, lacks] if vocabulary.more else 0 * lacks).tolist(), strict=True):
                other[d][w, x] += 1
            out = part.select(keep)
            for name, x in (
                ("row", pa.array(row + np.arange(len(size)))),
                ("n_tokens", pa.array(size)),
                ("known", pa.array(np.add.reduceat((there & (vocabulary.counts[rows] > 0)).astype(np.int64), begin))),
                ("base", pa.array(np.add.reduceat(np.where(there, log_c[rows], 0), begin))),
                ("score", pa.array(np.add.reduceat(score, begin))),
                ("words", pa.array([[w for w, _ in x] for x in other], pa.list_(pa.binary()))),
                ("contexts", pa.array([[c for _, c in x] for x in other], pa.list_(pa.int32()))),
                ("times", pa.array([list(x.values()) for x in other], pa.list_(pa.int32()))),
            ):
                out = out.append_column(name, x)
            row += len(size)
            yield from out.combine_chunks().to_batches()

    return docs.mapInArrow(run, schema)


def learned_logs(rare: DataFrame, model: Model) -> DataFrame:
    """rare: row, times, c, class, context, v. Returns row, times, and sums of log10 of a word's count + 1 (base) and of what it has inside its class before the class's sum (logs)."""
    small = model.without_table(known=False)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            base = np.log10(batch["c"].to_numpy() + 1)
            logs, times = base.copy(), batch["times"].to_numpy()
            has = np.flatnonzero(batch["v"].is_valid().to_numpy(zero_copy_only=False))
            v = np.frombuffer(b"".join(batch["v"].drop_null().to_pylist()), np.float32).reshape(len(has), SIZE + 1)
            logs[has] = small.word_log(batch["class"].to_numpy()[has], batch["context"].to_numpy()[has], v)
            yield pa.record_batch([batch["row"], batch["times"], pa.array(base * times), pa.array(logs * times)], names=["row", "times", "base", "logs"])

    return rare.select("row", "times", "c", "class", "context", "v").mapInArrow(run, "row long, times int, base double, logs double")


def learn_words(texts: DataFrame) -> tuple[DataFrame, int, int, int, Vocabulary]:
    """counts (word, c), all tokens, kinds of tokens, kinds that occur LEAST times, and the vocabulary."""
    counts = durable(count_words(texts), "lm-counts")
    n, kinds, n_learned = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") >= LEAST)).first()
    top = counts.orderBy(F.desc("c"), "word").limit(KNOWN).toArrow()
    words, c = top["word"].to_pylist(), top["c"].to_pylist()
    tail = counts.groupBy(tail_class_column(F.col("word")).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("kinds"), F.sum(F.when(F.col("c") >= LEAST, F.col("c") + 1).otherwise(0)).alias("mass")).collect()
    tail_words, tail_kinds, mass = np.zeros(TAIL), np.zeros(TAIL), np.zeros(TAIL)
    for k, x, y, m in tail:
        tail_words[k - HEAD], tail_kinds[k - HEAD], mass[k - HEAD] = x, y, m
    for w, x in zip(words[:HEAD], c[:HEAD], strict=True):
        tail_words[tail_class(w) - HEAD] -= x
        tail_kinds[tail_class(w) - HEAD] -= 1
        mass[tail_class(w) - HEAD] -= x + 1 if x >= LEAST else 0
    vocabulary = Vocabulary(words, c, tail_words, tail_kinds, mass)
    return counts, n, kinds, n_learned, vocabulary


def learn_model(encoded: DataFrame, counts: DataFrame, n_learned: int, vocabulary: Vocabulary) -> Model:
    """The model of the training texts (see encode)."""
    pairs, k = count_pairs(encoded, vocabulary, n_learned), HEAD + TAIL
    positions = [train(at := np.flatnonzero(x), x.ravel()[at]) for x in pairs]
    model = Model(positions[0])
    model.positions = positions
    slots = slots_of(counts, int(vocabulary.counts[-2])) if vocabulary.more else np.zeros(0, np.uint8)
    found = durable(count_contexts(encoded, vocabulary, positions, slots), "lm-contexts")
    likely = np.zeros((k, len(MIXES)))
    mixes = found.filter("word IS NULL").groupBy("context", "mix").agg(F.sum("n").alias("n")).toArrow()
    likely[mixes["context"].to_numpy(), mixes["mix"].to_numpy()] = mixes["n"].to_numpy()
    model.weights = MIXES[likely.argmax(1)]
    follow, mass = pairs[0, :, HEAD:].astype(np.float32), vocabulary.mass
    each = found.filter("word IS NOT NULL").select("word", "seen").repartition(max(8, n_learned // 8192), "word")
    got = durable(word_vectors(each.sortWithinPartitions("word"), follow, mass, model[1]), "lm-vectors")
    model.vectors = got.filter("word IS NOT NULL").select("word", "c", "v")
    z = got.filter("class IS NOT NULL").select("class", F.posexplode("z").alias("context", "z")).groupBy("class", "context").agg(F.sum("z").alias("z")).toArrow()
    model.norm = np.zeros((TAIL, k))
    model.norm[z["class"].to_numpy(), z["context"].to_numpy()] = np.log10(mass[z["class"].to_numpy()]) - np.log10(z["z"].to_numpy())
    rows = len(vocabulary.counts)
    model.known, model.has = np.zeros((rows, SIZE + 1), np.float32), np.zeros(rows, bool)
    near = model.vectors.filter(F.col("c") >= (int(vocabulary.counts[-2]) if rows > 1 else 0)).select("word", "v").toArrow()
    for w, v in zip(near["word"].to_pylist(), near["v"].to_pylist(), strict=True):
        if (i := vocabulary.at.get(w)) is not None:
            model.known[i], model.has[i] = np.frombuffer(v, np.float32), True
    return model


def learn(texts: DataFrame) -> tuple[DataFrame, int, int, Vocabulary, Model]:
    """counts (word, c), all tokens, kinds of tokens, and the vocabulary and model for score_texts."""
    counts, n, kinds, n_learned, vocabulary = learn_words(texts)
    return counts, n, kinds, vocabulary, learn_model(durable(encode(texts, [], vocabulary), "lm-texts"), counts, n_learned, vocabulary)


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text)."""
    d = bound_batches(docs).select("doc_id", held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    counts, n, kinds, n_learned, vocabulary = learn_words(d.filter(~F.col("held_out")).select("text"))
    encoded = durable(encode(d, ["doc_id", "held_out"], vocabulary), "lm-texts")
    model = learn_model(encoded.filter(~F.col("held_out")), counts, n_learned, vocabulary)
    known = durable(score_texts(encoded, ["doc_id", "held_out"], vocabulary, model), "lm-scores")
    rare = known.select("row", F.explode(F.arrays_zip("words", "contexts", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.contexts").alias("context"), F.col("x.times").alias("times"))
    rare = rare.join(counts, "word")
    each = F.log10(F.col("c") + 1)
    by = rare.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * each).alias("logs"), F.sum(F.col("times") * each).alias("own"))
    if vocabulary.more:
        rare = rare.join(model.vectors.select("word", "v"), "word", "left").withColumn("class", tail_class_column(F.col("word")))
        by = learned_logs(rare, model).groupBy("row").agg(F.sum("times").alias("more"), F.sum("base").alias("logs"), F.sum("logs").alias("own"))
    all_ = known.drop("words", "contexts", "times").join(by, "row", "left")
    more, logs, own = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0)), F.coalesce("own", F.lit(0.0))
    base = F.col("base") + logs - F.col("n_tokens") * F.log10(F.lit(float(n + kinds + 1)))
    return all_.select("doc_id", "held_out", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + own).alias("score"))


def op7_language_model(spark, sf_dir: str) -> DataFrame:
    from .quality_model import fold

    return score(read(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 7) == 2)
