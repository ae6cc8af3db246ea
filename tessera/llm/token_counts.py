"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged numpy arrays.

Texts are cut into pre-tokens by the vocabulary's pattern. Distinct pre-tokens of a slice are laid out as
one ragged array of symbols; every round finds each sequence's lowest-rank pair and applies it everywhere
in that sequence at once, until no sequence has a pair with a rank; the surviving symbols are the tokens.
Counts of pre-tokens are remembered in a bounded table per Python worker. No shuffle.

Cases: a null or empty text has 0 bytes and 0 tokens; texts of any length are counted whole; special
strings inside a text count as their one special token, as the library does by default; repeated rows and
ties get equal results row by row; empty tables give empty results; extra columns are carried unless
they clash with a result's name, which wins.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, read, slices

RESULT = "n_bytes long, n_tokens long"
#: The white space that the pre-tokenizer's \s means.
SPACE = r"\t-\r \x85\xa0  -     　"
REMEMBERED = 400_000
ROUND_SYMBOLS = 1 << 20
_NONE = np.int64(1) << 40


class Merger:
    """A BPE vocabulary (tokenizers' JSON) as arrays: symbols of bytes, and rank and result of each mergeable pair."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        # Fixed rule of byte-level vocabularies: printable Latin-1 stands for itself, the rest for 256 upwards.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.of_byte = np.zeros(256, np.int64)
        for b in shown:
            self.of_byte[b] = vocab[chr(b)]
        for i, b in enumerate(rest):
            self.of_byte[b] = vocab[chr(256 + i)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # An open-addressing table: one multiplicative probe, then neighbours.
        self.bits = 19
        self.key = np.full((1 << self.bits) + 64, -1, np.int64)
        self.rank = np.full(len(self.key), _NONE, np.int64)
        self.made = np.zeros(len(self.key), np.int64)
        slot = self._slot(key)
        left = np.arange(len(key))
        while len(left):
            free = self.key[slot[left]] == -1
            _, first = np.unique(slot[left][free], return_index=True)
            put = left[free][first]
            self.key[slot[put]], self.rank[slot[put]], self.made[slot[put]] = key[put], put, made[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] += self.key[slot[left]] != -1
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        s = SPACE
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{s}\p{{L}}\p{{N}}]+|[{s}]+(?![^{s}])|[{s}]+")
        self.known: dict[str, int] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The table slot of each pair, or that of an empty one."""
        key = a << 20 | b
        slot = self._slot(key)
        open_ = np.flatnonzero((self.key[slot] != key) & (self.key[slot] != -1))
        while len(open_):
            slot[open_] += 1
            k = self.key[slot[open_]]
            open_ = open_[(k != key[open_]) & (k != -1)]
        return slot

    def count(self, raw: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token."""
        out = np.zeros(len(raw), np.int64)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        seq = np.repeat(np.arange(len(raw)), size)
        while len(sym):
            joined = seq[1:] == seq[:-1]
            slot = self._lookup(sym[:-1], sym[1:])
            rank = np.where(joined, self.rank[slot], _NONE)
            begin = np.flatnonzero(np.concatenate([[True], ~joined]))
            low = np.minimum.reduceat(np.append(rank, _NONE), begin)
            live = low < _NONE
            length = np.diff(np.append(begin, len(sym)))
            out[seq[begin[~live]]] = length[~live]
            hit = (rank == np.repeat(low, length)[:-1]) & (rank < _NONE)
            at = np.flatnonzero(hit)
            # In a run of overlapping equal pairs every other one merges, from the left.
            run = np.cumsum(np.concatenate([[True], np.diff(at) != 1])) - 1
            first = at[np.concatenate([[True], np.diff(at) != 1])] if len(at) else at
            at = at[(at - first[run]) % 2 == 0] if len(at) else at
            sym[at] = self.made[slot[at]]
            keep = np.repeat(live, length)
            keep[at + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text."""
        n_bytes, n_tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        found: list[list[str]] = []
        for i, t in enumerate(texts):
            n_bytes[i] = len(t.encode("utf-8", "surrogatepass"))
            parts = [t]
            if self.special and self.special.search(t):
                parts = self.special.split(t)
                n_tokens[i] = len(parts) - 1
            pre = self.words.findall(parts[0])
            for p in parts[1:]:
                pre += self.words.findall(p)
            found.append(pre)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({w for pre in found for w in pre if w not in known})
        begin, symbols = 0, 0
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        for end in range(1, len(new) + 1):
            symbols += len(raw[end - 1])
            if symbols >= ROUND_SYMBOLS or end == len(new):
                known.update(zip(new[begin:end], self.count(raw[begin:end]).tolist(), strict=True))
                begin, symbols = end, 0
        for i, pre in enumerate(found):
            n_tokens[i] += sum(map(known.__getitem__, pre))
        return n_bytes, n_tokens


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def vocabulary(file: str) -> str:
    """The place of a vocabulary file of the public_tokenizers package, on whichever machine asks."""
    import public_tokenizers

    return public_tokenizers.path(file)


def count_tokens(docs: DataFrame, text: str = "text", file: str = "byte_bpe_50k.json", keep: list[str] | None = None) -> DataFrame:
    """docs with n_bytes and n_tokens of each whole text; without the text itself if keep leaves it out."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_bytes", "n_tokens")]
    carry = bound_batches(docs).select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carry.schema if f.name != "__text"), RESULT])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = merger(vocabulary(file))
        for part in slices(batches, [*keep, "__text"], "__text"):
            n_bytes, n_tokens = m.texts([t or "" for t in part["__text"].to_pylist()])
            part = part.select(keep).append_column("n_bytes", pa.array(n_bytes)).append_column("n_tokens", pa.array(n_tokens))
            yield from part.combine_chunks().to_batches()

    return carry.mapInArrow(run, schema)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    out = count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)
