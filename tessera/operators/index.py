"""Incremental index as a table of Parquet partitions: diff by hash, upsert by partition overwrite, deletes, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def diff(source: DataFrame, existing: DataFrame, key: str, digest: str, force: bool = False) -> DataFrame:
    """key, action: new, changed, unchanged or pruned."""
    s = source.select(key, F.col(digest).alias("__new"))
    e = existing.select(key, F.col(digest).alias("__old")).withColumn("__there", F.lit(True))
    x = s.withColumn("__here", F.lit(True)).join(e, key, "full_outer")
    action = F.when(F.col("__here").isNull(), "pruned").when(F.col("__there").isNull(), "new")
    action = action.when(F.col("__new").eqNullSafe(F.col("__old")) & F.lit(not force), "unchanged").otherwise("changed")
    return x.select(key, action.alias("action"))


class Table:
    """Rows by a bucket of their key. Writes replace whole buckets, so a write is seen entirely or not at all per bucket."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        rows.select("*", self._bucket()).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(self.path)

    def upsert(self, rows: DataFrame, delete: DataFrame | None = None) -> None:
        """New rows replace those of the same key; keys in delete go. Only the buckets touched are rewritten."""
        new = rows.select("*", self._bucket())
        keys = new.select(self.key, "bucket")
        if delete is not None:
            keys = keys.unionByName(delete.select(self.key, self._bucket()))
        keys = keys.distinct()
        touched = self.read().join(keys.select("bucket").distinct(), "bucket", "left_semi")
        kept = touched.join(keys.select(self.key), self.key, "left_anti").select(new.columns)
        out = kept.unionByName(new).repartition("bucket")
        held = {b for (b,) in touched.select("bucket").distinct().collect()}  # at most `buckets` numbers
        staged = f"{self.path}__staged"
        out.write.mode("overwrite").parquet(staged)  # the table cannot be read and replaced in one plan
        done = self.spark.read.parquet(staged)
        done.write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        left = {b for (b,) in done.select("bucket").distinct().collect()}
        for b in sorted(held - left):  # buckets that lost their last row
            empty = self.spark.read.parquet(self.path).filter("false").drop("bucket")
            empty.write.mode("overwrite").parquet(f"{self.path}/bucket={b}")

    def get(self, keys: DataFrame) -> DataFrame:
        return self.read().join(keys.select(self.key).distinct(), self.key, "left_semi")
