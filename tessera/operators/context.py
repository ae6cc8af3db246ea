"""What a model is shown and what its answer holds: extracts with headers, headings and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunking import blank_code

#: Labels of document types, and the marks of an extract.
TYPES = {"reference_api": "référence technique", "guide_fonctionnel": "guide fonctionnel", "fiche_partenaire_agregation": "fiche partenaire", "guide_utilisateur": "aide en ligne"}
NOTHING = "(aucun extrait)"
CITATION = r"\s*\[S(\d+)\]"


def extract(sid: Column, title: Column, text: Column, api: Column, version: Column, doc_type: Column, first: Column, last: Column, url: Column, path: Column) -> Column:
    """One extract: a header with what is known of its source, then the text."""
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    label = F.lit(None).cast("string")
    for k, v in TYPES.items():
        label = F.when(doc_type == k, v).otherwise(label)
    pages = F.when(some(first).isNotNull(), F.concat(F.lit("p. "), first.cast("string"), F.coalesce(F.when(last != first, F.concat(F.lit("-"), last.cast("string"))), F.lit(""))))
    parts = (
        F.when(some(api).isNotNull(), F.concat(api, F.coalesce(F.concat(F.lit(" v"), some(version)), F.lit("")))), F.coalesce(label, F.replace(some(doc_type), F.lit("_"), F.lit(" "))), pages,
        F.coalesce(F.concat(F.lit("lien : "), some(url)), F.concat(F.lit("fichier : "), some(path))),
    )
    details = F.concat_ws(" ; ", *parts)
    header = F.concat(F.lit("["), sid, F.lit("] Source : "), title, F.when(details != "", F.concat(F.lit(" ("), details, F.lit(")"))).otherwise(F.lit("")))
    return F.concat(F.lit('<extrait id="'), sid, F.lit('">\n'), header, F.lit("\n\n"), F.regexp_replace(text, r"\A\s+|\s+\z", ""), F.lit("\n</extrait>"))


def formatted(queries: DataFrame, extracts: DataFrame, query: str, order: str) -> DataFrame:
    """query, context: the extracts (query, order, extract) of every query, a cut list, in order; a query without any is told so."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "extract"))), lambda x: x["extract"]), "\n\n")
    return queries.select(query).join(extracts.groupBy(query).agg(joined.alias("context")), query, "left").select(query, F.coalesce("context", F.lit(NOTHING)).alias("context"))


def cited(text: Column, known: Column) -> Column:
    """Distinct numbers of the sources that a text cites outside code, in order, as struct(sid, known)."""
    found = F.array_distinct(F.regexp_extract_all(blank_code(text), F.lit(CITATION), F.lit(1)))
    return F.transform(found, lambda n: F.struct(F.concat(F.lit("S"), n).alias("sid"), F.array_contains(known, F.concat(F.lit("S"), n)).alias("known")))


def outline(sections: Column) -> Column:
    """Headings of an answer as struct(at, depth, text), citations removed; sections as in markdown.outline."""
    heads = F.filter(sections, lambda s: s["level"] > 0)
    return F.transform(heads, lambda s, i: F.struct(i.alias("at"), s["level"].alias("depth"), F.trim(F.regexp_replace(s["title"], CITATION, "")).alias("text")))
