"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every document of a source is wanted target / source_size times. The whole part is given to all; the
fractional parts are rounded dependently: documents meet in cells (a hash of the document, about CELL
to a cell, so a hot source has many cells), each cell pairs them from the longest to the shortest and moves
words at random within a pair, as much probability times length to one side as from the other, until one side is 0 or 1: each expectation
stays exact, and so do the words taken. What is left of each cell, at most one document, meets the others of its source in the next,
CELL times smaller level, and so on: a reduction tree of depth log(n) / log(CELL). The last one of a source is rounded by a coin with its
probability; what that adds or takes too much is then given back by other documents, the longest that fits first and last
the shortest that brings the total nearer: SPARE documents of each size class of a source (a power of two) stand by for it, chosen by hash.
So a source misses its target by less than about its shortest documents. Coins are hashes of the pair, so reruns agree.

Cases: null text has 0 words; documents without words get a coin each; null sources are one source, last in order; rows equal in doc_id, source and text
are one unit, chosen or not together; a source without words has target 0; an empty table gives no rows;
other columns do not matter, and mix() returns exactly the columns of its input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, join_unique, n_words, read

CELL, SPARE = 64, 8
WEIGHTS = (5, 2, 1)
_EPS = 1e-9


def units(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Distinct documents with their number of equal rows: doc_id, source, h (hash of the text), size, m."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(text).alias("h"), n_words(F.col(text)).alias("size"))
    return d.groupBy("doc_id", "source", "h", "size").agg(F.count(F.lit(1)).alias("m"))


def running(t: DataFrame, order: list, sums: list[str], name: str) -> tuple[DataFrame, dict]:
    """t with at (place in the order, from 1) and before_<c> (sum of the integers c of all rows before); and the totals.

    Rows are sorted by range over all tasks; only one row of sums for each of these goes to the driver.
    """
    t = durable(t.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)
    heads = t.groupBy("__part").agg(F.count(F.lit(1)).alias("at"), *(F.sum(c).cast("long").alias(c) for c in sums)).orderBy("__part").collect()
    offsets, total = [], dict.fromkeys(["at", *sums], 0)
    for r in heads:
        offsets.append((r["__part"], *total.values()))
        total = {c: n + r[c] for c, n in total.items()}
    o = t.sparkSession.createDataFrame(offsets, "__part int, " + ", ".join(f"__{c} long" for c in total))
    w = Window.partitionBy("__part").orderBy(*order)
    t = t.join(F.broadcast(o), "__part").withColumn("at", F.col("__at") + F.row_number().over(w))
    t = t.withColumns({f"before_{c}": F.col(f"__{c}") + F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in sums})
    return t.drop("__part", *(f"__{c}" for c in total)), total


def targets(of: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n_units, target. Sources below their cap share by weight what capped ones leave.

    Ordered by cap over weight, the capped sources come first; the level is that of the first source it leaves uncapped.
    """
    t = of.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    t, _ = running(t, [F.col("source").asc_nulls_last()], [], "mix-sources")
    t = t.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("at") - 1) % len(WEIGHTS) + 1).cast("int"))).withColumn("cap", most * F.col("source_size").cast("double"))
    t, total = running(t.withColumnRenamed("at", "i"), [F.col("cap") / F.col("w"), F.col("i")], ["source_size", "w"], "mix-caps")
    level = (share * total["source_size"] - most * F.col("before_source_size")) / (total["w"] - F.col("before_w"))
    level = t.agg(F.min_by(level, F.when(level * F.col("w") <= F.col("cap"), F.col("at")))).first()[0]
    return t.select("source", "source_size", "n_units", (F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("w"))).alias("target"))


def _coin(a: Column, b: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(a, b, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def _pivotal(items: Column, item_type: str, seed: int) -> Column:
    """struct(left, done): the undecided item or null, and the decided ones (p is 0 or 1). Items have words > 0."""
    empty = F.struct(F.lit(None).cast(item_type).alias("left"), F.array().cast(f"array<{item_type}>").alias("done"))
    whole = lambda x: (x["p"] == 0) | (x["p"] == 1)
    exact = lambda x, p: x.withField("p", F.when(p < _EPS, 0.0).when(p > 1 - _EPS, 1.0).otherwise(p))

    def moved(a: Column, x: Column) -> Column:
        """The pair after words have moved: up to a or down from it, by chance so that neither expectation changes."""
        up = F.least((1 - a["p"]) * a["words"], x["p"] * x["words"])
        down = F.least(a["p"] * a["words"], (1 - x["p"]) * x["words"])
        gain = _let(F.struct(up.alias("up"), down.alias("down")), lambda m: F.when(_coin(a["key"], x["key"], seed) * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"]))
        return _let(gain, lambda g: F.array(exact(a, a["p"] + g / a["words"]), exact(x, x["p"] - g / x["words"])))

    def step(acc: Column, x: Column) -> Column:
        both = F.when(acc["left"].isNull(), F.array(exact(x, x["p"]))).otherwise(moved(acc["left"], x))
        return _let(both, lambda b: F.struct(F.get(F.filter(b, lambda y: ~whole(y)), F.lit(0)).alias("left"), F.concat(acc["done"], F.filter(b, whole)).alias("done")))

    return F.aggregate(items, empty, step)


def _given_back(done: DataFrame) -> DataFrame:
    """source, key, change (1 or -1): the documents whose copies change so that their source comes near its target. done: see copies(), with p, words, key and open (has a fractional part)."""
    taken = F.sum(F.col("words") * (F.col("base") + F.col("p")))
    over = durable(done.groupBy("source", "target").agg(taken.alias("taken"), F.count(F.lit(1)).alias("n")).withColumn("over", F.col("taken") - F.col("target")).select(*_source_key(), "over", "n"), "mix-over")
    d = join_unique(done.filter("open AND words > 0").select(*_source_key(), "key", "words", "p"), over, ["none", "name"], "n", done.count())
    d = d.filter(((F.col("over") > 0) & (F.col("p") == 1)) | ((F.col("over") < 0) & (F.col("p") == 0)))
    d = d.withColumn("class", F.floor(F.log2("words")))
    d = d.withColumn("i", F.row_number().over(Window.partitionBy("none", "name", "class").orderBy(F.xxhash64("key"), "key"))).filter(F.col("i") <= SPARE)
    d = d.groupBy("none", "name", "over").agg(F.sort_array(F.collect_list(F.struct("words", "key")), asc=False).alias("xs"))
    empty = F.struct(F.abs("over").alias("e"), F.array().cast("array<struct<words:bigint,key:bigint>>").alias("out"))
    fits = F.aggregate("xs", empty, lambda acc, x: F.when(x["words"] <= acc["e"], F.struct((acc["e"] - x["words"]).alias("e"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc))
    d = d.withColumn("f", fits).withColumn("last", F.array_min(F.filter("xs", lambda x: (x["words"] < 2 * F.col("f.e")) & ~F.array_contains(F.col("f.out"), x))))
    change = F.when(F.col("over") > 0, -1).otherwise(1)
    return d.select("none", "name", change.alias("change"), F.explode(F.when(F.col("last").isNull(), F.col("f.out")).otherwise(F.concat("f.out", F.array("last")))).alias("x")).select("none", "name", "x.key", "change")


def _source_key() -> list[Column]:
    """A source as two columns without nulls."""
    return [F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")]


def copies(of: DataFrame, to: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, h, size, m, source_size, target, copies (0, 1 or 2). of: units(); to: targets(); both durable."""
    most = to.agg(F.max("n_units")).first()[0]
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    d = join_unique(of.select("*", *_source_key()), to.select("source_size", "n_units", "target", *_source_key()), ["none", "name"], "n_units", of.count()).drop("none", "name")
    d = d.withColumn("want", wanted).withColumn("base", F.floor(F.col("want") + _EPS).cast("int")).withColumn("key", F.xxhash64("doc_id", "h", "size")).withColumn("words", F.col("size") * F.col("m"))
    d = d.withColumn("p", F.greatest(F.lit(0.0), F.col("want") - F.col("base"))).withColumn("open", F.col("p") > _EPS)
    fields = ["words", "key", "doc_id", "h", "m", "size", "source_size", "target", "base", "open", "p"]
    level = d.filter("words > 0").select("source", F.ceil(F.col("n_units") / CELL).cast("long").alias("cells"), F.struct(*fields).alias("x"))
    item_type = level.schema["x"].dataType.simpleString()
    coin = F.when(_coin(F.col("x.key"), F.lit(0).cast("long"), seed) < F.col("x.p"), 1.0).otherwise(0.0)
    alone = lambda x: x.select("source", F.col("x").withField("p", coin).alias("x"))
    done, cells, step = [alone(d.filter("words = 0").select("source", F.struct(*fields).alias("x")))], -(-(most or 0) // CELL), 0
    while True:
        groups = level.groupBy("source", "cells", F.pmod(F.xxhash64("x.key", F.lit(step)), "cells").alias("cell")).agg(F.sort_array(F.collect_list("x"), asc=False).alias("xs"))
        folded = durable(groups.select("source", "cells", _pivotal(F.col("xs"), item_type, seed + step).alias("f")), f"mix-{step}")
        done.append(folded.select("source", F.explode("f.done").alias("x")))
        level = folded.filter("f.left IS NOT NULL").select("source", F.ceil(F.col("cells") / CELL).cast("long").alias("cells"), F.col("f.left").alias("x"))
        if cells <= 1:
            break
        cells, step = -(-cells // CELL), step + 1
    out = alone(level)
    for part in done:
        out = out.unionByName(part)
    out = durable(out.select("source", "x.*"), "mix-rounded")
    back = durable(_given_back(out), "mix-back")
    out = out.select("*", *_source_key()).join(back, ["none", "name", "key"], "left")
    number = (F.col("base") + F.col("p")).cast("int") + F.coalesce("change", F.lit(0))
    return out.select("doc_id", "source", "h", "size", "m", "source_size", "target", number.alias("copies"))


def plan(docs: DataFrame, seed: int = 7) -> DataFrame:
    of = durable(units(docs), "mix-units")
    return copies(of, durable(targets(of), "mix-targets"), seed)


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    def name(h: Column) -> list[Column]:  # two hashes name a unit
        of = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("source").isNull(), F.col("source"), h]
        return [F.xxhash64(*of).alias("__k1"), F.xxhash64(F.lit(7), *of).alias("__k2")]

    p = durable(plan(docs, seed).select(*name(F.col("h")), F.col("m").alias("__m"), F.col("copies").alias("__copies")), "mix-plan")
    mixed = join_unique(docs.select("*", *name(F.xxhash64("text"))), p, ["__k1", "__k2"], "__m", p.count()).filter("__copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_mix(spark, sf_dir: str) -> DataFrame:
    p = plan(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rows = p.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")
