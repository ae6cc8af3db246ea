"""Profiles of partner sheets from their facts, and the routing of a question from its analysis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of a partner's profile; {p} stands for the partner, {s} for the system that its data go to.
TITLE = "Agrégation {p} (fiche partenaire)"
TASKS = ("Paramétrer l'agrégation de {p} dans {s}", "Vérifier les données agrégées depuis {p}")
QUESTIONS = (
    "Quelle est la fréquence d'agrégation de {p} ?", "Quel est le format du code apporteur {p} ?", "Quels produits de {p} sont agrégés dans {s} ?", "Le prix d'achat moyen est-il transmis par {p} ?",
    "Les mouvements de {p} sont-ils agrégés ?", "Faut-il une lettre d'autorisation pour agréger {p} ?",
)
KEYWORDS = ("agrégation", "code apporteur", "lettre d'autorisation", "fréquence d'agrégation", "prix d'achat moyen")


def _filled(text: str, partner: Column, system: str) -> Column:
    before, *after = text.replace("{s}", system).split("{p}")
    return F.concat(F.lit(before), *(x for part in after for x in (partner, F.lit(part))))


def partner(name: Column, code: Column, products: Column, price_sent: Column, frequency: Column, letter: Column, system: str, shown: int = 8) -> dict[str, Column]:
    """title, summary, tasks, questions, keywords and prerequisites; a fact that is null or empty is not spoken of."""
    n = F.coalesce(F.size(products), F.lit(0))
    first = F.array_join(F.slice(products, 1, shown), ", ")
    facts = F.concat_ws(
        " ; ", F.nullif(F.regexp_replace(F.regexp_replace(code, r"\.+$", ""), "^(.*?)code apporteur", "$1le code apporteur"), F.lit("")),
        F.when(n > 0, F.concat(n.cast("string"), F.lit(" produit(s) agrégé(s) : "), first, F.when(n > shown, "…").otherwise(F.lit("")))),
        F.when(price_sent, F.lit("prix d'achat moyens transmis")).when(~price_sent, "prix d'achat moyens non transmis"), F.when(frequency != "", F.concat(F.lit("agrégation "), frequency)),
        F.when(letter, F.lit("lettre d'autorisation signée requise")),
    )
    summary = F.concat(_filled("Fiche d'agrégation du partenaire {p} dans {s}", name, system), F.when(facts != "", F.concat(F.lit(" : "), facts)).otherwise(F.lit("")), F.lit("."))
    none = F.array().cast("array<string>")
    return {
        "title": _filled(TITLE, name, system), "summary": summary, "tasks": F.array(*(_filled(t, name, system) for t in TASKS)), "questions": F.array(*(_filled(q, name, system) for q in QUESTIONS)),
        "keywords": F.concat(F.array(name, *map(F.lit, KEYWORDS)), F.coalesce(F.slice(products, 1, 6), none)),
        "prerequisites": F.when(letter, F.array(F.lit("Lettre d'autorisation complétée et signée"))).otherwise(none),
    }


ANALYSIS = "standalone_question string, intent string, corpus string, route string, sub_queries array<string>"


def routed(question: Column, history: Column, analysis: Column, intents: list[str], cues: str, guarded: str, tools: bool, default: str = "autre", home: str = "documentation") -> dict[str, Column]:
    """intent, corpus, route, queries and fallback from a model's analysis (JSON text).

    An analysis that is missing or cannot be read falls back to a search for the question. An intent outside the vocabulary becomes the default; the guarded corpus needs a
    cue in the question or its history; a route to tools needs tools. queries: the question as asked, then on its own, then at most three parts, each once.
    """
    a = F.from_json(analysis, ANALYSIS)
    lost = a.isNull() | (F.coalesce(a["intent"], a["standalone_question"], a["route"], a["corpus"]).isNull() & a["sub_queries"].isNull())
    own = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(""))
    spoken = F.concat_ws(" ", question, history).rlike(cues)
    corpus = F.when((own(a["corpus"]) == guarded) & ~spoken, F.lit("")).otherwise(own(a["corpus"]))
    route = F.coalesce(F.nullif(own(a["route"]), F.lit("")), F.lit(home))
    candidates = F.concat(F.array(question, a["standalone_question"]), F.coalesce(F.slice(a["sub_queries"], 1, 3), F.array().cast("array<string>")))
    return {
        "intent": F.when(F.lower(own(a["intent"])).isin(*intents), F.lower(own(a["intent"]))).otherwise(F.lit(default)), "corpus": corpus,
        "route": F.when((route == "outils") & F.lit(not tools), F.lit(home)).otherwise(route), "queries": F.array_distinct(F.filter(F.transform(candidates, lambda c: F.trim(c)), lambda c: c != "")), "fallback": lost,
    }


def boosted(attempt: Column, intent: Column, corpus: Column, family: list[str], guarded: str) -> Column:
    """Whether the intent may vote in the search: on the first attempt only, and an intent of the family only for its corpus."""
    return (attempt == 0) & (~intent.isin(*family) | (corpus == guarded))
