"""Dense vectors: hashed bag-of-words embeddings and exact cosine search of many queries, in blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import bound_batches
from ..sources.files import fingerprint, named, stored

DIM = 64


def hashed_embedding(docs: DataFrame, key: str, text: Column, dim: int = DIM, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, carry, embedding array<double>: how many words fall into each bucket of their MD5 (dim divides 256). Texts without words have none."""
    bucket = lambda w: (F.conv(F.right(F.md5(w), F.lit(2)), 16, 10).cast("int") % dim).cast("int")
    kept = [key, *carry]
    rows = bound_batches(docs.select(*kept, F.transform(tokens(text), bucket).alias("b")))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n, b = batch.num_rows, batch.column(len(kept))
            size = np.diff(b.offsets.to_numpy())
            counts = np.bincount(np.repeat(np.arange(n), size) * dim + b.flatten().to_numpy(zero_copy_only=False), minlength=n * dim)
            whole = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim), pa.int32()), pa.array(counts.astype(float)))
            yield pa.record_batch([*(batch.column(i) for i in range(len(kept))), whole], names=[*kept, "embedding"]).filter(pa.array(size > 0))

    fields = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in kept)
    return rows.mapInArrow(run, f"{fields}, embedding array<double>")


def hashed_index(docs: DataFrame, key: str, text: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """hashed_embedding of a collection, computed and written once per application and collection."""
    from .lexical import spread

    plan = docs.select(key, text.alias("text"), *carry)
    build = lambda at: stored(hashed_embedding(spread(plan), key, F.col("text"), carry=carry), f"{at}/vectors")
    return docs.sparkSession.read.parquet(named(docs.sparkSession, fingerprint(plan, "hashed", key, *carry), build) + "/vectors")


def cosine(u: Column, v: Column) -> Column:
    """Cosine of two arrays, 0 where one has no length."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.when(norm == 0, 0.0).otherwise(dot(u, v) / norm)


def cosine_top_k(rows: DataFrame, queries: DataFrame, k: int, same: bool = False, block: int = 65_536, at_once: int = 64) -> DataFrame:
    """query, id, score, rank (by score rounded to 6 digits, then id). rows: id, v, g; queries: query (of any type that can be grouped by; a number if same), v, g.

    Every query meets every row of its group (g null in the query: all rows). Rows are dealt into blocks of about
    `block`; queries visit each block, and a task keeps one block and streams the queries past it.
    same: a query does not find the row of its own id. Vectors that are null, of another length than most or with null or non-finite components take no part.
    """
    dim = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).filter("dim > 0").agg(F.max_by("dim", F.struct("n", -F.col("dim")))).first()[0] or 1
    whole = lambda x, key: x.filter(F.col(key).isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))))
    rows, queries = whole(rows, "id"), whole(queries, "query")
    n = max(1, -(-rows.count() // block))
    kind = queries.schema["query"].dataType
    r = rows.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"), F.lit(0).alias("kind"), F.col("id").cast("long"), F.lit(None).cast(kind).alias("query"), F.col("v").cast("array<double>").alias("v"), F.col("g").cast("string").alias("g"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block")
    q = queries.select(every, F.lit(1).alias("kind"), (F.col("query") if same else F.lit(0)).cast("long").alias("id"), "query", F.col("v").cast("array<double>").alias("v"), F.col("g").cast("string").alias("g"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        now, held, x = None, [], None
        for batch in batches:
            blocks, kinds, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            vectors = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            groups = np.array(["" if g is None else f"={g}" for g in batch.column(5).to_pylist()], object)
            cuts = (np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if a == b:
                    continue
                if blocks[a] != now:
                    now, held, x = blocks[a], [], None
                if kinds[a] == 0:
                    held.append((ids[a:b], vectors[a:b], groups[a:b]))
                    continue
                if x is None and held:
                    key, x, of = (np.concatenate(part) for part in zip(*held, strict=True))
                    norm, held = np.sqrt((x * x).sum(1)), []
                for c in range(a, b, at_once) if x is not None else ():
                    asked = slice(c, min(b, c + at_once))
                    size = np.outer(np.sqrt((vectors[asked] ** 2).sum(1)), norm)
                    score = np.round(np.divide(vectors[asked] @ x.T, size, out=np.zeros_like(size), where=size > 0), 6)
                    for i, q, g, row in zip(range(asked.start, asked.stop), ids[asked], groups[asked], score, strict=True):
                        ok = np.ones(len(x), bool) if g == "" else of == g
                        at = np.flatnonzero(ok & (key != q) if same else ok)
                        if len(at) > k:  # all that reach the k-th score, then ties by id
                            at = at[row[at] >= np.partition(row[at], len(at) - k)[len(at) - k]]
                        at = at[np.lexsort((key[at], -row[at]))][:k]
                        yield pa.record_batch([batch.column(3).take(pa.array(np.full(len(at), i))), pa.array(key[at]), pa.array(row[at])], names=["query", "id", "score"])

    from .lexical import top_k

    found = bound_batches(r.unionByName(q)).repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(run, f"query {kind.simpleString()}, id long, score double")
    return top_k(found, "query", "id", k)
