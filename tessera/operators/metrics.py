"""Retrieval, answer, refusal, latency and cost metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import same_url

KS = (1, 3, 5, 10)


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def relevance(ranked: DataFrame, targets: DataFrame, query: str) -> DataFrame:
    """query, target, rank: which hits meet which targets (matches_target), only those of one query being compared.

    ranked: query, rank, doc_id, url, breadcrumb, a cut list; targets: query, target, target_doc, target_url, section.
    """
    hit = matches_target(*(F.col(c) for c in ("doc_id", "url", "breadcrumb", "target_doc", "target_url", "section")))
    return ranked.join(targets, query).filter(hit).select(query, "target", "rank")


def retrieval(ranked: DataFrame, targets: DataFrame, query: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row per query with targets: recall, precision, hit and nDCG at each k, and MRR over the whole list.

    ranked and targets as in relevance(): a target may be met by several hits, and a hit may meet several targets.
    Recall counts targets; precision divides by the length of the cut list; nDCG gains only where a rank covers a
    target for the first time, so it cannot pass 1; MRR is 0 if nothing is met.
    """
    size = ranked.groupBy(query).agg(F.max("rank").alias("listed"))
    want = targets.groupBy(query).agg(F.countDistinct("target").alias("wanted"))
    met = relevance(ranked, targets, query)
    first = met.groupBy(query, "target").agg(F.min("rank").alias("rank"))
    at = lambda c, k: F.count_if(F.col("rank") <= k).alias(f"{c}_{k}")
    covered = first.groupBy(query).agg(*(at("covered", k) for k in ks), F.min("rank").alias("best"))
    gains = first.select(query, "rank").distinct().groupBy(query).agg(*(F.sum(F.when(F.col("rank") <= k, _gain(F.col("rank")))).alias(f"dcg_{k}") for k in ks))
    right = met.select(query, "rank").distinct().groupBy(query).agg(*(at("right", k) for k in ks))
    out = want.join(size, query, "left").join(covered, query, "left").join(gains, query, "left").join(right, query, "left").na.fill(0)
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("wanted").cast("int"))), F.lit(0.0), lambda s, i: s + _gain(i))
    columns: list[Column] = []
    for k in ks:
        columns += [
            F.round(F.col(f"covered_{k}") / F.col("wanted"), 6).alias(f"recall_{k}"),
            F.round(F.when(F.col("listed") > 0, F.col(f"right_{k}") / F.least(F.lit(k), F.col("listed"))).otherwise(0.0), 6).alias(f"precision_{k}"),
            F.when(F.col(f"covered_{k}") > 0, 1.0).otherwise(0.0).alias(f"hit_{k}"),
            F.round(F.col(f"dcg_{k}") / ideal(k), 6).alias(f"ndcg_{k}"),
        ]
    return out.select(query, *columns, F.round(F.when(F.col("best") > 0, 1 / F.col("best")).otherwise(0.0), 6).alias("mrr"))


def long_form(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, metric, value: every other column as a row; nulls are left out, so averages skip missing metrics."""
    names = [c for c in rows.columns if c not in keys]
    return rows.unpivot(list(keys), names, "metric", "value").filter("value IS NOT NULL")


def refusals(rows: DataFrame, *by: str) -> DataFrame:
    """From answerable and refused: accuracy, precision and recall of refusing, false refusals and hallucinations; null where undefined."""
    answerable, refused = F.col("answerable"), F.col("refused")
    n = F.count(F.lit(1))
    hit, missed, wrong = F.count_if(~answerable & refused), F.count_if(~answerable & ~refused), F.count_if(answerable & refused)
    part = lambda a, b: F.round(F.try_divide(a, F.nullif(b, F.lit(0))), 6)
    return rows.groupBy(*by).agg(
        part(n - missed - wrong, n).alias("accuracy"), part(hit, hit + wrong).alias("precision"), part(hit, hit + missed).alias("recall"),
        part(wrong, F.count_if(answerable)).alias("false_refusal_rate"), part(missed, F.count_if(~answerable)).alias("hallucination_rate"),
    )


def token_f1(rows: DataFrame, key: str, answer: Column, reference: Column) -> DataFrame:
    """F1 of the words two texts share, repeats counted; null if either has none, 0 if they share none."""
    r = rows.select(key, answer.alias("a"), reference.alias("r"))
    count = lambda c: r.select(key, F.explode(c).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("n"))
    both = count("a").alias("x").join(count("r").alias("y"), [key, "w"]).groupBy(key).agg(F.sum(F.least("x.n", "y.n")).alias("shared"))
    out = r.join(both, key, "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    p, q = F.col("shared") / F.size("a"), F.col("shared") / F.size("r")
    f1 = F.when((F.size("a") == 0) | (F.size("r") == 0), None).when(F.col("shared") == 0, 0.0).otherwise(F.round(2 * p * q / (p + q), 6))
    return out.select(key, f1.alias("token_f1"))


def keyword_coverage(answer: Column, keywords: Column) -> Column:
    """Share of the keywords that the answer contains, null without keywords; both already folded."""
    return F.round(F.try_divide(F.size(F.filter(keywords, lambda k: F.contains(answer, k))), F.nullif(F.size(keywords), F.lit(0))), 6)


def rouge_l(rows: DataFrame, key: str, answer: Column, reference: Column) -> DataFrame:
    """F1 of the longest common subsequence of words (arrays of strings), by numpy rows of the usual table, a task's batch at a time."""
    from collections.abc import Iterator

    r = rows.select(key, answer.alias("a"), reference.alias("r"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not a or not b:
                    out.append(None)
                    continue
                ids: dict[str, int] = {}
                x, y = (np.array([ids.setdefault(w, len(ids)) for w in side]) for side in (a, b))
                last = np.zeros(len(y) + 1, np.int64)
                for w in x:
                    last[1:] = np.maximum.accumulate(np.where(y == w, last[:-1] + 1, last[1:]))
                p, q = last[-1] / len(x), last[-1] / len(y)
                out.append(round(2 * p * q / (p + q), 6) if last[-1] else 0.0)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.float64())], names=[key, "rouge_l"])

    return r.mapInArrow(run, f"{key} {r.schema[key].dataType.simpleString()}, rouge_l double")


def paths(events: DataFrame, key: str, order: str, step: str, least: int = 1) -> DataFrame:
    """How often each sequence of steps occurs over the keys."""
    one = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, step))).alias("xs"))
    path = F.array_join(F.transform("xs", lambda x: x[step]), " → ")
    return one.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def first_in(order: Column, *by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(order))


def matches_target(doc_id: Column, url: Column, breadcrumb: Column, target_doc: Column, target_url: Column, section: Column) -> Column:
    """Whether a hit is what a target asks for: its document, or, for a target without one, its page by compared URL; and then, of a target with a document or neither, the section in the breadcrumb."""
    none = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    here = none(section) | F.contains(F.lower(F.coalesce(breadcrumb, F.lit(""))), F.lower(F.trim(section)))
    bare = lambda c: same_url(F.regexp_replace(c, "[#?].*$", ""))
    page = F.coalesce(bare(url) == bare(target_url), F.lit(False)) & ~none(url)
    return F.when(~none(target_doc), F.coalesce(doc_id == target_doc, F.lit(False)) & here).when(~none(target_url), page).otherwise(here)
