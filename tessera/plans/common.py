"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import ACCENTED, PLAIN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: DuckDB twins of the text functions.
SQL_TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"
SQL_FOLD = f"translate(lower({{0}}), '{ACCENTED}', '{PLAIN}')"
SQL_KEY = "left(sha1(regexp_replace(" + SQL_FOLD + ", '[^a-z0-9]', '', 'g')), 16)"
