"""Payloads as VARIANT: nested keys shredded to listed columns, all others kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten(rows: DataFrame, payload: str, columns: dict[str, tuple[str, str]], sections: tuple[str, ...]) -> DataFrame:
    """rows without the payload (JSON text), with one column for each of columns (name: key, type) and rest, a map of JSON texts.

    A key is looked for in the sections of the payload and at its top, a later section overwriting an earlier one unless its value is null or an empty text or array; so what was
    found in a text replaces what its catalogue says. rest holds every key that is not listed, as section.key.
    """
    x = rows.withColumn("__v", F.try_parse_json(payload))
    at = lambda path, kind: F.try_variant_get("__v", path, kind)

    def value(key: str, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for s in ("", *sections):
            v = at(f"$.{s}.{key}" if s else f"$.{key}", kind)
            empty = F.size(v) == 0 if kind.startswith("array") else v.cast("string") == ""
            out = F.when(v.isNotNull() & ~empty, v).otherwise(out)
        return out

    known = {k for k, _ in columns.values()}
    none = F.array().cast("array<struct<key:string,value:string>>")

    def others(section: str) -> Column:
        listed = [*known, *([] if section else sections)]
        m = F.map_filter(at(f"$.{section}" if section else "$", "map<string,variant>"), lambda k, v: ~k.isin(*listed))
        prefix = F.lit(f"{section}." if section else "")
        return F.coalesce(F.transform(F.map_entries(m), lambda e: F.struct(F.concat(prefix, e["key"]).alias("key"), F.to_json(e["value"]).alias("value"))), none)

    maps = [others(s) for s in ("", *sections)]
    rest = F.map_from_entries(F.concat(*maps))
    return x.select(*(c for c in rows.columns if c != payload), *(value(k, t).alias(name) for name, (k, t) in columns.items()), rest.alias("rest"))


def nest(rows: DataFrame, key: str, columns: dict[str, str], payload: str = "payload") -> DataFrame:
    """The way back: key and a JSON payload of the columns (name: key), nulls left out, with what rest keeps."""
    own = [F.struct(F.lit(k).alias("key"), F.to_json(F.struct(F.col(name).alias("x"))).alias("value")) for name, k in columns.items()]
    inner = F.filter(F.array(*own), lambda e: e["value"] != "{}")
    parts = F.transform(inner, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.regexp_extract(e["value"], r"(?s)^\{\"x\":(.*)\}$", 1)))
    more = F.transform(F.map_entries("rest"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return rows.select(key, F.concat(F.lit("{"), F.array_join(F.concat(parts, more), ","), F.lit("}")).alias(payload))
