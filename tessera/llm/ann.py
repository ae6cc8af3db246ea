"""Approximate nearest neighbours with a hash-prefix forest.

Rows are dealt by hash into shards of about SHARD vectors; a shard holds TREES sorted arrays of BITS-bit hash
strings (signs of projections on random orthogonal directions). A query descends in every tree to its longest
matching prefix and ascends in all trees at once, one bit at a time, until SHARE of the shard's rows are candidates and k
others are among them, if it has so many; these are scored exactly. Every row is indexed, every query visits every shard, and a shard's
rows are sorted before its queries, so a task holds one forest and streams the queries past it.
Vectors without cluster structure leave no other way to a recall of 0.9 than a fixed share of all rows,
so the work grows with rows times queries; SHARE trades one for the other.

Cases: rows with a null id, or whose vector is null, zero, of another dimension than most (the lower one on a tie), or holds null or non-finite
components, take no part; equal scores go to the smaller id; a repeated id counts once, with its best score, and
is asked once, with its smallest vector; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, read

TREES, BITS, SHARE, SHARD, AT_ONCE = 32, 32, 0.4, 16384, 256


class Forest:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int = TREES, share: float = SHARE, seed: int = 5):
        self.ids, self.v = ids, vectors
        self.norm = np.sqrt((vectors * vectors).sum(1))
        self.least = int(np.ceil(share * len(ids)))
        rng, d = np.random.default_rng(seed), vectors.shape[1]
        unit = vectors / self.norm[:, None]
        self.middle = unit.mean(0)
        self.planes = [np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-BITS // d))], axis=1)[:, :BITS] for _ in range(trees)]
        self.order, self.keys = [], []
        for p in self.planes:
            key = self._hash(unit, p)
            o = np.argsort(key, kind="stable")
            self.order.append(o)
            self.keys.append(key[o])

    def _hash(self, unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
        return np.packbits((unit - self.middle) @ planes > 0, axis=1).view(">u4").ravel().astype(np.uint64)

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[tree, prefix length, query]: the rows, in the tree's order, that share a prefix of that length."""
        unit = queries / np.sqrt((queries * queries).sum(1))[:, None]
        shape = (len(self.planes), BITS + 1, len(queries))
        lo, hi = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
        for t, p in enumerate(self.planes):
            key = self._hash(unit, p)
            for x in range(BITS + 1):
                low = np.uint64(BITS - x)
                begin = key >> low << low
                lo[t, x] = np.searchsorted(self.keys[t], begin, "left")
                hi[t, x] = np.searchsorted(self.keys[t], begin + (np.uint64(1) << low), "left")
        return lo, hi

    def candidates(self, lo: np.ndarray, hi: np.ndarray, own: int, k: int) -> np.ndarray:
        """Rows for one query, from its ranges [tree, prefix length]: the share, with k ids that are not its own."""
        total = (hi - lo).sum(0)
        x = int(np.flatnonzero(total >= min(self.least, total[0])).max())
        hit = np.zeros(len(self.ids), bool)
        while True:
            for t in np.flatnonzero(hi[:, x] > lo[:, x]):
                hit[self.order[t][lo[t, x] : hi[t, x]]] = True
            if x == 0 or np.count_nonzero(hit) >= self.least:
                rows = np.flatnonzero(hit)
                if x == 0 or len(np.setdiff1d(self.ids[rows], own)) >= k:
                    return rows
            x -= 1

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        norm = np.sqrt((queries * queries).sum(1))
        lo, hi = self.ranges(queries)
        for i, q in enumerate(queries):
            rows = self.candidates(lo[:, :, i], hi[:, :, i], ids[i], k)
            rows = rows[self.ids[rows] != ids[i]]
            score = (self.v[rows] * q).sum(1) / (self.norm[rows] * norm[i])
            best = np.lexsort((self.ids[rows], -score))
            _, first = np.unique(self.ids[rows[best]], return_index=True)
            best = best[np.sort(first)[:k]]
            yield int(ids[i]), self.ids[rows[best]], score[best]


def usable(v: Column, dim: Column | int) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)


def nearest(rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", share: float = SHARE, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that is a query, among all other rows."""
    d = bound_batches(rows).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q")).filter("id IS NOT NULL AND v IS NOT NULL")
    sizes = d.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    head = sizes.agg(F.max_by("dim", F.struct("n", -F.col("dim"))), F.coalesce(F.sum("n"), F.lit(0))).first()
    dim, n = head[0] or 1, max(1, -(-head[1] // shard))
    d = d.filter(usable(F.col("v"), dim))
    scale = F.array_max(F.transform("v", F.abs))  # a cosine does not change, and no square overflows
    d = d.withColumn("v", F.when((scale > 1e100) | (scale < 1e-100), F.transform("v", lambda x: x / scale)).otherwise(F.col("v")))
    index = d.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("shard"), F.lit(0).alias("kind"), "id", "v")
    asked = d.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"), "id", "v")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, held, forest = None, [], None
        for batch in batches:
            shards, kinds, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            v = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if a == b:
                    continue
                if shards[a] != now:
                    now, held, forest = shards[a], [], None
                if kinds[a] == 0:
                    held.append((ids[a:b], v[a:b]))
                    continue
                if forest is None and held:
                    forest, held = Forest(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), share=share), []
                for c in range(a, b, AT_ONCE) if forest else ():
                    for q, found, score in forest.search(ids[c : min(b, c + AT_ONCE)], v[c : min(b, c + AT_ONCE)], k):
                        yield pa.record_batch([pa.array(np.full(len(found), q)), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    parts = index.unionByName(asked).repartition(n, "shard").sortWithinPartitions("shard", "kind")
    found = parts.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_prefix_forest(spark, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
