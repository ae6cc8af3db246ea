"""Reports over many dimensions in one pass, and exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch, stored

#: Shown for a value that is not there.
DASH = "—"


def breakdown(rows: DataFrame, key: str, dimensions: list[str], metrics: list[str]) -> DataFrame:
    """dimension, value, metric, n, mean: every metric by every dimension and over all (dimension `all`), the rows shuffled once.

    A metric that a row does not have does not count for it, so each has its own n; a missing value of a dimension is shown as a dash.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(DASH)).alias(c) for c in dimensions]
    long = rows.select(key, *shown, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot([key, *dimensions], metrics, "metric", "x").filter("x IS NOT NULL")
    sets = [["metric"], *([d, "metric"] for d in dimensions)]
    out = long.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in [*dimensions, "metric"])).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean"))
    which, value = F.lit("all"), F.lit("")
    for d in dimensions:
        which, value = F.when(F.col(d).isNotNull(), d).otherwise(which), F.when(F.col(d).isNotNull(), F.col(d)).otherwise(value)
    return out.select(which.alias("dimension"), value.alias("value"), "metric", "n", "mean")


def rates(verdict: Column, names: tuple[str, ...]) -> list[Column]:
    """The share of each verdict among the rows that have one, null if none has."""
    n = F.count(verdict)
    return [F.round(F.try_divide(F.count_if(verdict == v), F.nullif(n, F.lit(0))), 6).alias(f"{v}_rate") for v in names]


def per_unit(total: Column, units: Column) -> Column:
    """Cost of one unit, null where there is none."""
    return F.round(F.try_divide(total, F.nullif(units, F.lit(0))), 8)


def percentiles(rows: DataFrame, value: str, *by: str, at: tuple[int, ...] = (50, 90, 95, 99)) -> DataFrame:
    """n, mean, min, max and exact, linearly interpolated percentiles of each group; nulls do not count.

    Values are range-partitioned, equal ones too, and counted by partition; only the partitions that hold a rank asked for are numbered, so a
    group of nearly all rows is as many tasks as it has partitions.
    """
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    x = rows.select(group.alias("__g"), F.col(value).alias("__v"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    path = scratch(rows.sparkSession, "percentiles")
    ordered = x.filter("__v IS NOT NULL").repartitionByRange("__g", "__v", "salt").withColumn("part", F.spark_partition_id()).drop("salt")
    ordered = stored(ordered, f"{path}/ordered")
    runs = ordered.groupBy("__g", "part").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("__g")
    runs = runs.withColumn("n", F.sum("k").over(w)).withColumn("before", F.coalesce(F.sum("k").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = lambda p: F.col("n").cast("double") * p / 100 - p / 100
    ranks = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), (place(p) - F.floor(place(p))).alias("part_of"), F.lit(i).alias("side"), (F.floor(place(p)) if i == 0 else F.ceil(place(p))).alias("rank")) for p in at for i in (0, 1))))
    wanted = runs.select("__g", "part", "before", "k", ranks.alias("r")).select("__g", "part", "before", "k", "r.*").filter("rank >= before AND rank < before + k")
    wanted = stored(wanted, f"{path}/wanted")
    held = ordered.join(wanted.select("__g", "part", "before").distinct(), ["__g", "part"])
    numbered = held.withColumn("rank", F.row_number().over(Window.partitionBy("__g", "part").orderBy("__v")) - 1 + F.col("before")).select("__g", "rank", "__v")
    found = wanted.join(numbered, ["__g", "rank"]).groupBy("__g", "p").agg(F.max(F.when(F.col("side") == 0, F.col("__v"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("__v"))).alias("high"), F.first("part_of").alias("f"))
    one = F.round(F.col("low") + (F.col("high") - F.col("low")) * F.col("f"), 6)
    found = found.groupBy("__g").agg(*(F.max(F.when(F.col("p") == p, one)).alias(f"p{p}") for p in at))
    plain = rows.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")).withColumn("__g", group)
    return plain.join(found, "__g", "left").select(*by, "n", "mean", "min", "max", *(f"p{p}" for p in at))
