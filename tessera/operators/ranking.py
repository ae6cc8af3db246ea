"""Operators on ranked hits: fusion, de-duplication, keep-max, rescue, diversity, parents and numbered sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The constant of the published reciprocal-rank fusion.
RRF_K = 60


def fuse(lists: DataFrame, query: str, key: str, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists that hold a key; lists has query, key and rank."""
    return lists.groupBy(query, key).agg(F.round(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))), 6).alias("score"))


def keep_first(hits: DataFrame, query: str, by: Column, order: str = "rank") -> DataFrame:
    """The first hit of each (query, by), in order."""
    w = Window.partitionBy(query, by).orderBy(order)
    return hits.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def keep_max(hits: DataFrame, query: str, key: str, score: str = "score", position: str = "position") -> DataFrame:
    """Each key's best score over several lists; equal scores keep the first seen."""
    rest = [c for c in hits.columns if c not in (query, key)]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(position)))
    return hits.groupBy(query, key).agg(best.alias("__x")).select(query, key, "__x.*")


def rescue(hits: DataFrame, kept: DataFrame, query: str, doc: str, n: int) -> DataFrame:
    """The best hit of each of the n best documents of which nothing was kept."""
    best = keep_first(hits, query, F.col(doc))
    top = best.withColumn("doc_rank", F.row_number().over(Window.partitionBy(query).orderBy("rank"))).filter(F.col("doc_rank") <= n)
    return top.join(kept.select(query, doc).distinct(), [query, doc], "left_anti")


def diversify(hits: DataFrame, query: str, top_n: int, per_doc: int, threshold: float) -> DataFrame:
    """Walk down each query's ranking: stop below the threshold or at top_n, skip texts seen, keep per_doc of a document.

    hits: query, rank, key, doc, text_key, score; candidates of a query are few (the output of a top-k), so one fold holds them.
    A hit refused by the cap does not mark its text as seen.
    """
    item = F.struct("rank", "key", "doc", "text_key", "score")
    lists = hits.groupBy(query).agg(F.sort_array(F.collect_list(item)).alias("xs"))
    kind = lists.schema["xs"].dataType.simpleString()

    def step(kept: Column, x: Column) -> Column:
        of_doc = F.size(F.filter(kept, lambda k: k["doc"] == x["doc"]))
        seen = F.exists(kept, lambda k: k["text_key"] == x["text_key"])
        ok = (x["score"] >= threshold) & (F.size(kept) < top_n) & ~seen & (of_doc < per_doc)
        return F.when(ok, F.concat(kept, F.array(x))).otherwise(kept)

    out = lists.select(query, F.posexplode(F.aggregate("xs", F.array().cast(kind), step)).alias("at", "x"))
    return out.select(query, (F.col("at") + 1).alias("position"), "x.*")


def with_parents(hits: DataFrame, nodes: DataFrame, parent: str = "parent_id", level: str = "section") -> DataFrame:
    """Hits with their parent's text and size, where the parent is a node of that level. Run it after the top-k, on few hits."""
    p = nodes.filter(F.col("level") == level).select(F.col("node_id").alias(parent), F.col("text").alias("parent_text"), F.col("token_count").alias("parent_tokens"))
    return hits.join(p, parent, "left")


def number_sources(context: DataFrame, query: str, key: str, parent: Column, order: str = "position") -> DataFrame:
    """query, source (S1, S2 ... by first use of a parent), first position, members in order."""
    by = context.withColumn("__p", parent).groupBy(query, "__p").agg(F.min(order).alias("first"), F.array_sort(F.collect_list(F.struct(order, key))).alias("xs"))
    n = F.row_number().over(Window.partitionBy(query).orderBy("first"))
    return by.select(query, F.concat(F.lit("S"), n).alias("source"), "first", F.transform("xs", lambda x: x[key]).alias("members"))
