"""Conversations: history windows, turn logs, event folds, reducers, requests and the bounded corrective loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold

RESET = "<reset>"


def history(messages: DataFrame, key: str, order: str, n: int, most: int = 1500) -> DataFrame:
    """Each message with the n messages before and with it, each cut at `most` characters."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)
    said = F.concat(F.col("role"), F.lit(": "), F.left(F.coalesce("text", F.lit("")), F.lit(most)))
    return messages.withColumn("history", F.array_join(F.collect_list(said).over(w), "\n"))


def open_turns(messages: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The messages after their key's last reset as rows, numbered by __i; nothing is gathered, whatever their number."""
    resets = messages.filter(F.col(value) == RESET).groupBy(F.col(key).alias("__key")).agg(F.max(order).alias("__last"))
    x = messages.join(resets, F.col(key) == F.col("__key"), "left").filter(F.col("__last").isNull() | (F.col(order) > F.col("__last"))).select(messages.columns)
    return x.withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def reduce_turns(messages: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """open_turns as one text per key, which Spark's 2 GB a row bound: a key with more after its last reset needs open_turns itself."""
    x = open_turns(messages, key, order, value)
    return x.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", value))), lambda s: s[value]), ",").alias("items"), F.count(F.lit(1)).alias("n"))


def fold_events(events: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """Steps of a thread: a start opens a running step of its name, an end closes the latest running one of that name.

    kind: name:start, name:end, or token. Returns key, running, done and tokens, by matching parentheses per name.
    """
    name, what = F.substring_index(kind, ":", 1), F.substring_index(kind, ":", -1)
    x = events.select(key, order, name.alias("name"), what.alias("what")).withColumn("d", F.when(F.col("what") == "start", 1).when(F.col("what") == "end", -1).otherwise(0))
    w = Window.partitionBy(key, "name").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("depth", F.sum("d").over(w))
    by = x.groupBy(key, "name").agg(F.sum("d").alias("net"), F.least(F.min("depth"), F.lit(0)).alias("unmatched"), F.count_if(F.col("what") == "end").alias("ends"), F.count_if(F.col("what") == "token").alias("tokens"))
    return by.groupBy(key).agg(F.sum(F.col("net") - F.col("unmatched")).alias("running"), F.sum(F.col("ends") + F.col("unmatched")).alias("done"), F.sum("tokens").alias("tokens"))


def corrective_loop(requests: DataFrame, search: Callable[[DataFrame, int], DataFrame], good: Column, rewrite: Callable[[DataFrame, int], DataFrame], passes: int = 3) -> DataFrame:
    """Search, grade and rewrite whole batches of requests, at most `passes` times: each pass takes what is not good yet.

    search(open, pass) adds the columns that `good` grades; rewrite(open, pass) changes the requests left. Returns every request with attempts and sufficient.
    """
    done, open_ = [], requests
    for i in range(passes):
        found = search(open_, i).withColumn("attempts", F.lit(i + 1)).withColumn("sufficient", F.coalesce(good, F.lit(False)))
        last = i == passes - 1
        done.append(found if last else found.filter("sufficient"))
        if not last:
            open_ = rewrite(found.filter("NOT sufficient"), i).select(requests.columns)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def search(turns: DataFrame, text: str, words: tuple[str, ...], least: int = 2) -> DataFrame:
    """Turns that hold every word of two letters or more, compared by a collation without case and accents, with the place of the first (at). No such word finds nothing."""
    asked = [w for w in words if len(w) >= least]
    if not asked:
        return turns.withColumn("at", F.lit(0)).filter("false")
    plain = F.collate(F.col(text), "UNICODE_CI_AI")
    every = F.lit(True)
    for w in asked:
        every = every & F.contains(plain, F.collate(F.lit(w), "UNICODE_CI_AI"))
    return turns.filter(every).withColumn("at", F.instr(fold(F.col(text)), fold(F.lit(asked[0]))))
