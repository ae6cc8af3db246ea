"""Products and glossary terms in texts, by whole words."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a word is not followed or preceded by.
_IN = r"[\p{L}\p{N}_-]"


def pattern(forms: Sequence[str], exact: bool) -> str:
    """A pattern that finds one of the forms as whole words; the longest is tried first."""
    any_ = "|".join(re.escape(f) for f in sorted(forms, key=lambda f: (-len(f), f)))
    return f"{'' if exact else '(?i)'}(?:^|[^{_IN[1:]})(?:{any_})(?:$|[^{_IN[1:]})"


def detected(text: Column, vocabulary: Mapping[str, Sequence[str]], exact: Sequence[str] = ()) -> Column:
    """The terms of a written vocabulary (term: its forms) that a text holds, in the order of the vocabulary; those in `exact` and acronyms by their exact case.

    One compiled pattern a term, so a text is scanned once a term, whatever the number of its forms.
    """
    hits = [F.when(text.rlike(pattern([t, *forms], t in exact or (t.isupper() and len(t) > 1))), F.lit(t)) for t, forms in vocabulary.items()]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def expansions(terms: Column, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    """The terms found and all of their forms, each term before its own."""
    forms = F.create_map(*(x for t, f in vocabulary.items() for x in (F.lit(t), F.array(F.lit(t), *map(F.lit, f)))))
    return F.flatten(F.transform(terms, lambda t: F.try_element_at(forms, t)))


def described(rows, name: str, text: str, *by: str):
    """by, lines: a vocabulary as `- name : text` lines in the order of names, for a prompt."""
    line = F.concat(F.lit("- "), F.col(name), F.lit(" : "), F.coalesce(F.col(text), F.lit("")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), line.alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
