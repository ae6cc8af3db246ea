"""Catalogues, vocabularies, business questions and review flags from files of any file system that Spark reads."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import _folder, read_export


def _load(text: str):
    """A YAML text, or, where no YAML library is at hand, a JSON text, which is YAML too."""
    try:
        import yaml
    except ModuleNotFoundError:
        return json.loads(text)
    return yaml.safe_load(text)


def _leaves(value, path: tuple[str, ...] = (), at: tuple[int, ...] = ()) -> Iterator[tuple[list[str], list[int], str | None]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, (*path, str(k)), at)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _leaves(v, path, (*at, i))
    else:
        yield list(path), list(at), None if value is None else json.dumps(value, ensure_ascii=False) if isinstance(value, bool) else str(value)


def tree_files(spark: SparkSession, path: str, pattern: str = "*.{yaml,yml,json}") -> DataFrame:
    """file, keys (the names on the way to a value), at (the places in lists on the way), value: every scalar of the YAML or JSON files below a folder.

    A file is one row until it is read where it lies; the pattern leaves files out before anything is read. A file that is not valid fails by its name.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    rows = files.select(F.col("_metadata.file_name").alias("file"), "value")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = list(_leaves(_load(text)))
                except Exception as wrong:
                    raise ValueError(f"{name} cannot be read: {wrong}") from wrong
                keys, at, value = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
                yield pa.record_batch([pa.array([name] * len(found), pa.string()), pa.array(keys, pa.list_(pa.string())), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.string())], names=["file", "keys", "at", "value"])

    return rows.mapInArrow(run, "file string, keys array<string>, at array<int>, value string")


def entries(leaves: DataFrame, under: str, columns: tuple[str, ...]) -> DataFrame:
    """file, entry, columns: the list of maps under a top key, one row each in the order of the file; a missing or nested key is null."""
    x = leaves.filter((F.element_at("keys", 1) == under) & (F.size("keys") == 2) & (F.size("at") == 1))
    x = x.select("file", F.element_at("at", 1).alias("entry"), F.element_at("keys", 2).alias("key"), "value")
    return x.groupBy("file", "entry").agg(*(F.first(F.when(F.col("key") == c, F.col("value")), ignorenulls=True).alias(c) for c in columns))


def vocabulary(leaves: DataFrame, under: str) -> DataFrame:
    """term, alias: a map of terms to lists of aliases under a top key; every term is an alias of itself."""
    x = leaves.filter((F.element_at("keys", 1) == under) & (F.size("keys") == 2)).select(F.element_at("keys", 2).alias("term"), F.col("value").alias("alias"))
    return x.filter("alias IS NOT NULL").unionByName(x.select("term", F.col("term").alias("alias"))).distinct()


BUSINESS = "produit string, requete string, reponse_ideale string, liens_possibles string, thematique string"


def business_questions(spark: SparkSession, path: str) -> DataFrame:
    """id (t001, t002, ... in the order of the file), product, question, reference, links, theme, terms (key terms of the reference); rows without a question are left out."""
    from ..operators.features import key_terms

    x = read_export(spark, path, BUSINESS).withColumn("at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id().alias("row"))).filter(F.trim("requete") != "")
    links = F.filter(F.split("liens_possibles", r"[;\s,]+"), lambda u: u.startswith("http"))
    x = x.select("at", F.trim("produit").alias("product"), F.trim("requete").alias("question"), F.col("reponse_ideale").alias("reference"), F.coalesce(links, F.array().cast("array<string>")).alias("links"), F.nullif(F.trim("thematique"), F.lit("")).alias("theme"))
    out = x.withColumn("n", F.row_number().over(Window.orderBy("at")).cast("string"))  # a written list: one file is one task anyway
    return out.select(F.concat(F.lit("t"), F.lpad("n", F.greatest(F.lit(3), F.length("n")), F.lit("0"))).alias("id"), "product", "question", "reference", "links", "theme", F.coalesce(key_terms(F.col("reference")), F.array().cast("array<string>")).alias("terms"))


def review_flags(spark: SparkSession, path: str) -> DataFrame:
    """id, reason: the questions marked for review; none, if there is no such file."""
    schema = "id string, raison string"
    folder, fs = _folder(spark, path)
    x = read_export(spark, path, schema) if fs.exists(folder) else spark.createDataFrame([], schema)
    return x.select(F.trim("id").alias("id"), F.col("raison").alias("reason")).filter("id <> ''")
