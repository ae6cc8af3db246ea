"""Models behind providers: batches of rows go to a provider inside tasks; deterministic stand-ins work offline.

A provider is an object that can be pickled. It is called with the rows of a batch and may hold a session or a loaded model,
made on first use in the worker. The stand-ins are labelled as such: they are not models.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")


class Scorer(Protocol):
    def score(self, pairs: Sequence[tuple[str, str]]) -> Sequence[float | None]: ...


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class Completer(Protocol):
    def complete(self, prompts: Sequence[str]) -> Sequence[str]: ...


class OverlapScorer:
    """Stand-in: the share of the query's distinct words that the passage has."""

    def score(self, pairs: Sequence[tuple[str, str]]) -> Sequence[float | None]:
        out: list[float | None] = []
        for query, passage in pairs:
            q = set(WORD.findall(query.lower()))
            out.append(len(q & set(WORD.findall(passage.lower()))) / len(q) if q else None)
        return out


class HashEmbedder:
    """Stand-in: words counted by their MD5 in 64 buckets."""

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]:
        import hashlib

        out = []
        for t in texts:
            v = [0.0] * 64
            for w in WORD.findall(t.lower()):
                v[hashlib.md5(w.encode(), usedforsecurity=False).digest()[-1] & 63] += 1
            out.append(v)
        return out


class Extractive:
    """Stand-in for generation: prompts are JSON with question, context (list of texts) and refusal; the answer is the first sentence of the first text, cited, or the refusal."""

    def complete(self, prompts: Sequence[str]) -> Sequence[str]:
        out = []
        for p in prompts:
            d = json.loads(p)
            first = d["context"][0].split(".")[0].strip() if d["context"] else ""
            out.append(f"{first}. [S1]" if first else d["refusal"])
        return out


def scored(rows: DataFrame, provider: Scorer, query: Column, passage: Column, name: str = "score", batch: int = 10, most: int = 1500) -> DataFrame:
    """rows with a score in [0, 1] from the provider, asked for `batch` passages of at most `most` characters at a time; what it leaves out gets 0."""
    r = rows.withColumn("__q", F.coalesce(query, F.lit(""))).withColumn("__p", F.left(F.coalesce(passage, F.lit("")), F.lit(most)))
    columns = rows.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{name}` double"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            pairs = list(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True))
            got: list[float] = []
            for i in range(0, len(pairs), batch):
                part = list(provider.score(pairs[i : i + batch]))[: len(pairs[i : i + batch])]
                part += [None] * (len(pairs[i : i + batch]) - len(part))
                got += [round(min(1.0, max(0.0, s or 0.0)), 6) for s in part]
            yield pa.RecordBatch.from_arrays([*b.select(columns).columns, pa.array(got, pa.float64())], names=[*columns, name])

    return r.mapInArrow(run, schema)


def embedded(rows: DataFrame, key: str, text: Column, provider: Embedder, batch: int = 64, most: int = 30_000) -> DataFrame:
    """key, embedding: line feeds become spaces, long texts are cut as the model's limit asks."""
    r = rows.select(key, F.left(F.translate(F.coalesce(text, F.lit("")), "\n", " "), F.lit(most)).alias("t"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            for i in range(0, len(texts), batch):
                out += [list(map(float, v)) for v in provider.embed(texts[i : i + batch])]
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=[key, "embedding"])

    return r.mapInArrow(run, f"{key} {r.schema[key].dataType.simpleString()}, embedding array<double>")


def completed(rows: DataFrame, prompt: Column, provider: Completer, name: str = "answer", batch: int = 8) -> DataFrame:
    """rows with the provider's text for each prompt; a batch that fails is asked again once, row by row, and then left null."""
    r = rows.withColumn("__prompt", prompt)
    columns = rows.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{name}` string"])

    def ask(prompts: list[str]) -> list[str | None]:
        try:
            return list(provider.complete(prompts))
        except Exception:  # a provider may raise anything; the rows say so by a null
            if len(prompts) == 1:
                return [None]
            return [x for p in prompts for x in ask([p])]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            prompts, out = b.column(b.num_columns - 1).to_pylist(), []
            for i in range(0, len(prompts), batch):
                out += ask(prompts[i : i + batch])
            yield pa.RecordBatch.from_arrays([*b.select(columns).columns, pa.array(out, pa.string())], names=[*columns, name])

    return r.mapInArrow(run, schema)


def structured(text: Column, schema: str) -> Column:
    """The JSON object inside a model's text (fenced or not) by a schema; null where it does not parse."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)
