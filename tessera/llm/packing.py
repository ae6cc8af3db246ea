"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Documents are dealt by hash into shards of about SHARD documents, each packed alone, longest first; equal rows travel as one with their
number, ALIKE at most, so that many equal rows spread over many shards. A shard's
bins are ordered by residual in a segment tree whose nodes hold the AND of the bins' bitmaps (one bit
per source, one per duplicate cluster): a zero bit says that some bin below lacks that source or cluster.
The search begins at the residual that just fits and goes on from successor to successor until the tightest
bin compatible in both is found; only if there is none, a new bin opens. Bins never share a source or a cluster.
A document longer than a bin gives full pieces, each a bin of its own, and a last piece that is packed.
Packing shuffles only ids, sizes and hashes, never texts; pack_documents() adds the text of each piece afterwards. op2's clusters are the near-duplicate classes of jaccard_join.

Cases: null or empty text is an item of 0 words (placed by the same rule); null sources are one source; repeated
rows share a cluster and so never a bin; ties go by key; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard_join
from .common import durable, join_unique, n_words, read, slices
from .ragged import Texts

CAPACITY = 2048
SHARD, ALIKE = 8192, 64
RESULT = "piece long, n_pieces long, start long, piece_size long, bin_id long"


class Bins:
    """Open bins of one shard, by residual."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        self.tree = [-1] * (2 * self.leaves)
        self.at: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.count = 0

    def _refresh(self, residual: int) -> None:
        both = -1
        for bits in self.at[residual]:
            both &= bits
        i = self.leaves + residual
        while i and self.tree[i] != both:
            self.tree[i] = both
            i >>= 1
            both = self.tree[2 * i] & self.tree[2 * i + 1] if i else 0

    def _find(self, size: int, need: int) -> tuple[int, int] | None:
        """The tightest residual >= size with a bin that has none of the bits of need, and that bin's bitmap."""
        i, tree, leaves = self.leaves + size, self.tree, self.leaves
        while True:
            if not tree[i] & need:
                if i < leaves:
                    i *= 2
                    continue
                for bits in self.at[i - leaves]:
                    if not bits & need:
                        return i - leaves, bits
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1

    def put(self, size: int, need: int) -> int:
        found = self._find(size, need)
        if found is None:
            which, residual, bits = self.count, self.capacity, 0
            self.count += 1
        else:
            residual, bits = found
            alike = self.at[residual][bits]
            which = alike.pop()
            if not alike:
                del self.at[residual][bits]
                self._refresh(residual)
        residual -= size
        self.at[residual].setdefault(bits | need, []).append(which)
        self._refresh(residual)
        return which


def pack(items: Iterable[tuple[int, object, object]], capacity: int = CAPACITY) -> list[list[tuple[int, int, int, int, int]]]:
    """For each (size, source, cluster), in this order: its (piece, n_pieces, start, size, bin)."""
    items, bins = list(items), Bins(capacity)
    bit: dict = {}
    twice = {c for c, n in Counter(c for _, _, c in items).items() if n > 1}
    out = []
    for size, source, cluster in items:
        need = 1 << bit.setdefault(("source", source), len(bit))
        if cluster in twice:
            need |= 1 << bit.setdefault(("cluster", cluster), len(bit))
        full, rest = divmod(size, capacity)
        pieces = full + (rest > 0 or not full)
        out.append([(k, pieces, k * capacity, min(capacity, size - k * capacity), bins.put(min(capacity, size - k * capacity), need)) for k in range(pieces)])
    return out


def best_fit(docs: DataFrame, size: Column, cluster: Column, capacity: int = CAPACITY, shard: int = SHARD, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """keep (columns that can be grouped by), with RESULT: one row per piece. bin_id holds the shard in its upper half."""
    kept = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("source").alias("__source"), size.cast("long").alias("__size"), cluster.cast("long").alias("__cluster"))
    n = max(1, -(-docs.count() // shard))
    kept = kept.groupBy(*(f"`{c}`" for c in kept.columns)).agg(F.count(F.lit(1)).alias("__m")).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__m") - 1) / ALIKE))))
    kept = kept.withColumn("__m", F.least(F.lit(ALIKE), F.col("__m") - F.col("__k") * ALIKE)).withColumn("__key", F.xxhash64("doc_id", "__source", "__size", "__cluster", "__k"))
    kept = kept.withColumn("__shard", F.pmod(F.xxhash64("__key", F.lit(2)), F.lit(n)))
    names = [f.split()[0] for f in RESULT.split(", ")]
    schema = ", ".join([*(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep), RESULT])

    def run(shard_rows):
        import numpy as np
        import pyarrow as pa

        order = np.lexsort((shard_rows["__key"].to_numpy(), -shard_rows["__size"].to_numpy()))
        rows = shard_rows.take(pa.array(np.repeat(order, shard_rows["__m"].to_numpy()[order])))
        placed = pack(zip(*(rows[c].to_pylist() for c in ("__size", "__source", "__cluster")), strict=True), capacity)
        out = rows.select(list(keep)).take(pa.array(np.repeat(np.arange(len(placed)), [len(p) for p in placed])))
        numbers = np.array([x for p in placed for x in p], np.int64).reshape(-1, len(names))
        numbers[:, names.index("bin_id")] += rows["__shard"][0].as_py() << 32
        for name, x in zip(names, numbers.T, strict=True):
            out = out.append_column(name, pa.array(x))
        return out

    return kept.groupBy("__shard").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, source, RESULT and text: documents packed by words, with the text of each piece (all pieces of a document together are its text); equal texts are one duplicate cluster."""
    d = durable(docs.select("doc_id", "source", "text").withColumn("__row", F.monotonically_increasing_id()), "packing-documents")
    placed = best_fit(d, n_words(F.col("text")), F.xxhash64("text"), capacity, keep=("__row", "doc_id", "source"))
    names = [f.split()[0] for f in RESULT.split(", ")]
    each = placed.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("__pieces"))
    d = d.join(each, "__row").select("doc_id", "source", F.col("text").cast("binary").alias("__text"), "__pieces")

    def run(batches: Iterable) -> Iterable:
        import pyarrow as pa

        for part in slices(batches, ["doc_id", "source", "__text", "__pieces"], "__text"):
            texts, pieces, of, out = part["__text"].to_pylist(), part["__pieces"].to_pylist(), [], []
            for i, (raw, own) in enumerate(zip(texts, pieces, strict=True)):
                begin = Texts([raw]).w0 if len(own) > 1 else []
                for x in own:
                    a = int(begin[x["start"]]) if x["piece"] else 0
                    b = int(begin[x["start"] + x["piece_size"]]) if x["piece"] + 1 < len(own) else None
                    of.append(i)
                    out.append((*(x[c] for c in names), None if raw is None else raw[a:b].decode("utf-8", "replace")))
            rows = part.select(["doc_id", "source"]).take(pa.array(of, pa.int64()))
            for k, name in enumerate([*names, "text"]):
                rows = rows.append_column(name, pa.array([x[k] for x in out], pa.string() if name == "text" else pa.int64()))
            yield from rows.combine_chunks().to_batches()

    return d.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source {docs.schema['source'].dataType.simpleString()}, {RESULT}, text string")


def pack_apart(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Documents packed by words; a near-duplicate class of op8 is one duplicate cluster. Texts without words are clusters by equality."""
    rows, classes = jaccard_join.classes(docs, keep=("source",))
    d = join_unique(rows.select("doc_id", "source", "words", "n", "x1", "d1", "d2"), classes.select("d1", "d2", "m", "class_name"), ["d1", "d2"], "m", rows.count())
    cluster = F.when(F.col("n") > 0, F.col("class_name")).otherwise(F.col("x1"))
    d = durable(d.select("doc_id", "source", F.col("words").alias("__words"), cluster.alias("__cluster")), "packing-items")
    return best_fit(d, F.col("__words"), F.col("__cluster"), capacity)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_apart(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
