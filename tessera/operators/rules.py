"""Rule tables: precedence of sources, first matching patterns, section rules and vocabulary checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold

#: Letters and digits from which a name is compared without its spaces too: a fixed value.
LONG = 8


def overlay(*sources: tuple[Column, Column]) -> Column:
    """Sources from lowest to highest as (present, value): the highest present one decides, even if its value is null or empty."""
    out: Column = F.lit(None)
    for present, value in sources:
        out = F.when(present, value).otherwise(out)
    return out


def first_match(rows: DataFrame, key: list[str], name: Column, rules: DataFrame) -> DataFrame:
    """key, slot, value: for each slot the first rule (by pos) whose pattern the name matches.

    rules (pos, pattern, slot, value) is a configuration table, written by hand and a few hundred rows long.
    """
    hit = rows.withColumn("__n", name).join(F.broadcast(rules), F.expr("__n RLIKE pattern"))
    return hit.groupBy(*key, "slot").agg(F.min_by("value", "pos").alias("value"))


def section_rules(targets: DataFrame, key: list[str], rules: DataFrame) -> DataFrame:
    """key, slot, value: targets (key, target_pos, target, corpus), most specific first, meet rules (rule_pos, pattern, corpus or null, slot, value).

    The first value per slot wins; a slot and its hint share one place.
    """
    r = rules.withColumnRenamed("corpus", "only")
    hit = targets.join(F.broadcast(r), F.expr("target RLIKE pattern AND (only IS NULL OR only = corpus)"))
    slot = F.regexp_replace("slot", "_hint$", "")
    return hit.groupBy(*key, slot.alias("slot")).agg(F.min_by(F.struct("value", F.col("slot").endswith("_hint").alias("hint")), F.struct("target_pos", "rule_pos")).alias("x")).select(*key, "slot", "x.value", "x.hint")


def longest_matches(rows: DataFrame, key: str, text: Column, names: DataFrame) -> DataFrame:
    """key, entity: names (entity, alias) whose whole words occur in a text, without those inside a longer match of the same text.

    Text and aliases meet without case, accents and marks; an alias of LONG letters and digits is also found where white space stands elsewhere.
    names is a written list, a few thousand rows long.
    """
    plain = lambda c: F.trim(F.regexp_replace(fold(c), r"[^a-z0-9]+", " "))
    solid = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    n = names.select("entity", plain(F.col("alias")).alias("alias")).filter("alias <> ''")
    t = rows.select(key, F.concat(F.lit(" "), plain(text), F.lit(" ")).alias("__t"))
    word = F.contains("__t", F.concat(F.lit(" "), F.col("alias"), F.lit(" ")))
    hit = t.join(F.broadcast(n), word | ((F.length(solid(F.col("alias"))) >= LONG) & F.contains(solid(F.col("__t")), solid(F.col("alias"))))).select(key, "entity", solid(F.col("alias")).alias("alias"))
    longer = hit.select(F.col(key).alias("__k"), F.col("alias").alias("longer"))
    inside = (F.col(key) == F.col("__k")) & (F.length("longer") > F.length("alias")) & F.expr("contains(longer, alias)")
    return hit.join(longer, inside, "left_anti").select(key, "entity").distinct()


def occurrence(by: list[str], order: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(order))
