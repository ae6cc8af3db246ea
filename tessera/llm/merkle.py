"""Merkle manifest of a dataset with persistent, path-copying trees.

Leaves are numbered within their source by a range partitioning and a count for each partition. Aligned blocks of
ARITY ** DEPTH nodes are one task group each: a block holds its tree once, and every tampered leaf makes a version
of it that copies the ancestors of that leaf only and shares all other nodes. The roots of blocks are the nodes of the next
level, blocked the same way, until each source has one block; the subroots form a tree of their own. On the way back each block
gets the siblings above it, by which a version goes on from its block to the root.

Cases: a null field enters its digest as `-`; a null source is a source of its own, before all others; a null doc_id is ordered first and
never tampered with; repeated ids are ordered by their leaves, and equal rows are equal leaves side by side; empty and very long texts are
hashed whole; a source of one document is its own subroot, one source its own root; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, groups, join_unique, read

#: Children of a node, and levels of the tree inside one block (2187 nodes).
ARITY, DEPTH = 3, 7
BLOCK = ARITY**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<before:string,after:string>>"


def joined_hash(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Persistent:
    """A tree whose versions share nodes: nodes are never changed, a version is the number of its root."""

    def __init__(self, leaves: list[str], height: int | None = None):
        """height: at least what the leaves need, the default; a tree of more levels goes on with single children."""
        self.digest, self.kids = list(leaves), [()] * len(leaves)
        level, self.height = range(len(leaves)), 0
        while len(level) > 1 if height is None else self.height < height:
            level = [self._node(tuple(level[i : i + ARITY])) for i in range(0, len(level), ARITY)]
            self.height += 1
        self.root = level[0]

    def _node(self, kids: tuple[int, ...]) -> int:
        self.digest.append(joined_hash(self.digest[k] for k in kids))
        self.kids.append(kids)
        return len(self.kids) - 1

    def _down(self, leaf: int) -> list[tuple[int, int]]:
        """The ancestors of a leaf in the first version, from its parent to the root, each with the place of the child on the way."""
        out, node = [], self.root
        for level in reversed(range(self.height)):
            place = leaf // ARITY**level % ARITY
            out.append((node, place))
            node = self.kids[node][place]
        return out[::-1]

    def siblings(self, leaf: int) -> list[tuple[str, str]]:
        """Level by level, the digests before and after the one on the way."""
        out = []
        for node, place in self._down(leaf):
            d = [self.digest[k] for k in self.kids[node]]
            out.append(("".join(d[:place]), "".join(d[place + 1 :])))
        return out

    def version(self, leaf: int, digest: str) -> int:
        """The root of a version in which one leaf has another digest; only its ancestors are copied."""
        self.digest.append(digest)
        self.kids.append(())
        new = len(self.kids) - 1
        for node, place in self._down(leaf):
            kids = self.kids[node]
            new = self._node((*kids[:place], new, *kids[place + 1 :]))
        return new


def folded(digest: str, steps: Iterable[tuple[str, str]]) -> str:
    for before, after in steps:
        digest = joined_hash((before, digest, after))
    return digest


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """tree (its source's name in order), doc_id, leaf, forged (the tampered leaf, null where the row is not chosen), salt."""
    docs = docs.select(*FIELDS)
    digest = lambda text: F.sha2(F.concat(*(field(F.col(c)) for c in FIELDS[:-1]), field(text)), 256)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    forged = F.when(chosen, digest(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    return docs.select(tree.alias("tree"), "doc_id", digest(F.col("text")).alias("leaf"), forged.alias("forged"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """df (stored; tree without nulls) with pos, the place of each row in its tree by the columns of order.

    Only a tree that a range partition starts in the middle of needs an offset, so there is at most one offset a partition.
    """
    from pyspark import TaskContext

    keep = df.columns
    ordered = df.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)

    def number(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        part, last, run = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tree = batch.column(batch.schema.get_field_index("tree")).to_numpy(zero_copy_only=False)
            first = np.concatenate([[tree[0] != last], tree[1:] != tree[:-1]])
            begin = np.maximum.accumulate(np.where(first, np.arange(n), -1))
            seq = np.where(begin < 0, run + np.arange(n), np.arange(n) - begin)
            last, run = tree[-1], int(seq[-1]) + 1
            yield pa.record_batch([*batch.columns, pa.array(seq, pa.int64()), pa.array(np.full(n, part), pa.int64())], names=[*keep, "seq", "part"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    numbered = durable(ordered.mapInArrow(number, f"{fields}, seq long, part long"), "merkle-order")
    runs = numbered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    offset = runs.selectExpr("tree", "part", "sum(n) OVER (PARTITION BY tree ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before")
    offset = F.broadcast(offset.filter("before > 0"))
    return numbered.join(offset, ["tree", "part"], "left").select(*keep, (F.col("seq") + F.coalesce("before", F.lit(0))).alias("pos"))


def _blocks(nodes: DataFrame, headers: DataFrame | None, work, schema: str) -> DataFrame:
    """work(tree, block, nodes of the block as [(full, natural)], first node's place, header row or None) for every aligned block."""
    own = nodes.select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "full", "natural", F.lit(None).cast(_STEPS).alias("path"), F.lit(None).cast("string").alias("root"), F.lit(None).cast("boolean").alias("several"))
    if headers is not None:
        own = own.unionByName(headers.select("tree", "block", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("full"), F.lit(None).cast("string").alias("natural"), "path", "root", "several"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for (tree, block), held in groups(batches, 2):
            rows = pa.Table.from_batches(held)
            pos, full, natural = (rows[c].to_pylist() for c in ("pos", "full", "natural"))
            header = None
            if pos[0] < 0:
                header = {c: rows[c][0].as_py() for c in ("path", "root", "several")}
                pos, full, natural = pos[1:], full[1:], natural[1:]
            yield work(tree, block, full, natural, pos[0], header)

    return own.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(run, schema)


def _digests(block: int, full: list[str], natural: list[str]) -> list[str]:
    """The digests by which nodes enter their block: a node that is all of its tree stands as it is."""
    return natural if block == 0 and len(full) == 1 else full


def _roots(nodes: DataFrame) -> DataFrame:
    """The roots of blocks as nodes of the next level: full, with all levels of a block, and natural, if it is the only one of its tree."""

    def work(tree, block, full, natural, first, header):
        import pyarrow as pa

        d = _digests(block, full, natural)
        whole, short = Persistent(d, DEPTH), Persistent(d)
        return pa.record_batch([[tree], pa.array([block], pa.int64()), [whole.digest[whole.root]], [short.digest[short.root]]], names=["tree", "pos", "full", "natural"])

    return _blocks(nodes, None, work, "tree string, pos long, full string, natural string")


def _paths(nodes: DataFrame, headers: DataFrame) -> DataFrame:
    """tree, block (the place of the node), path (siblings up to the root of its tree), root, several (its tree has other nodes too)."""

    def work(tree, block, full, natural, first, header):
        import pyarrow as pa

        t = Persistent(_digests(block, full, natural), DEPTH if header["several"] else None)
        up = [(s["before"], s["after"]) for s in header["path"]]
        path = [[{"before": b, "after": a} for b, a in [*t.siblings(i), *up]] for i in range(len(full))]
        n, alone = len(full), block == 0 and len(full) == 1
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return pa.record_batch([[tree] * n, pa.array(range(first, first + n), pa.int64()), pa.array(path, kind), [header["root"]] * n, [not alone] * n], names=["tree", "block", "path", "root", "several"])

    return _blocks(nodes, headers, work, f"tree string, block long, path {_STEPS}, root string, several boolean")


def block_headers(nodes: DataFrame, name: str) -> DataFrame:
    """nodes: tree, pos (0, 1, ... in each tree), full, natural. Returns for each block of them what lies above it: tree, block, path, root, several.

    One level up holds a 2187th of the nodes; the levels end where no tree has a second block.
    """
    up = durable(_roots(nodes), f"{name}-up")
    if (up.agg(F.max("pos")).first()[0] or 0) == 0:
        return up.select("tree", F.col("pos").alias("block"), F.array().cast(_STEPS).alias("path"), F.col("natural").alias("root"), F.lit(False).alias("several"))
    return durable(_paths(up, block_headers(up, name)), f"{name}-down")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; the last two after tampering."""
    placed = durable(positions(durable(leaves(docs), "merkle-leaves"), ["doc_id", "leaf", "salt"]), "merkle-placed")
    nodes = placed.select("tree", "pos", F.col("leaf").alias("full"), F.col("leaf").alias("natural"))
    inner = block_headers(nodes, "merkle")
    subroots = durable(inner.filter("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("full"), F.col("root").alias("natural")), "merkle-subroots")
    subroots = durable(positions(subroots, ["name"]), "merkle-sources")
    outer = _paths(subroots, block_headers(subroots, "merkle-top")).select(F.col("block").alias("pos"), F.col("path").alias("outer"), F.col("root").alias("top"))
    blocks = inner.groupBy("tree").agg(F.count(F.lit(1)).alias("blocks"))
    outer = durable(subroots.join(outer.hint("merge"), "pos").select(F.col("name").alias("tree"), "outer", "top").join(blocks.hint("merge"), "tree"), "merkle-outer")
    headers = join_unique(inner, outer, ["tree"], "blocks", inner.count())
    return _proofs(placed, headers)


def _proofs(placed: DataFrame, headers: DataFrame) -> DataFrame:
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = placed.select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "doc_id", "leaf", "forged", none(_STEPS, "path"), none(_STEPS, "outer"), none("string", "root"), none("string", "top"), none("boolean", "several"))
    doc = dict(placed.dtypes)["doc_id"]
    heads = headers.select("tree", "block", F.lit(-1).cast("long").alias("pos"), none(doc, "doc_id"), none("string", "leaf"), none("string", "forged"), "path", "outer", "root", "top", "several")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, held in groups(batches, 2):
            rows = pa.Table.from_batches(held)
            head = {c: rows[c][0].as_py() for c in ("path", "outer", "root", "top", "several")}
            up = [(s["before"], s["after"]) for s in [*head["path"], *head["outer"]]]
            leaf, forged = rows["leaf"].to_pylist()[1:], rows["forged"].to_pylist()[1:]
            tree = Persistent(leaf, DEPTH if head["several"] else None)
            above = "".join(b + a for b, a in up)
            proof = [joined_hash([*(b + a for b, a in tree.siblings(i)), above]) for i in range(len(leaf))]
            untouched = folded(tree.digest[tree.root], up)
            ends = [untouched if f is None else folded(tree.digest[tree.version(i, f)], up) for i, f in enumerate(forged)]
            n = len(leaf)
            root = [head["top"]] * n
            good = [e == head["top"] for e in ends]
            yield pa.record_batch([rows["doc_id"].slice(1).combine_chunks(), leaf, [head["root"]] * n, root, proof, ends, good], names=names)

    schema = f"doc_id {doc}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.unionByName(heads).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(run, schema)


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"))


def oracle(levels: int = 14, tops: int = 8) -> str:
    """The same by self-joins, level by level, for sources of up to 3 ** levels documents and 3 ** tops sources."""
    f = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(f(c) for c in FIELDS[:-1])
    parts = [
        "table_bits AS (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))",
        "crc AS (SELECT list(v ORDER BY i) AS t FROM table_bits)",
        f"""leaf0 AS (SELECT row_number() OVER () AS id, doc_id, source, sha256({head} || {f("text")}) AS leaf,
            list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) % 2 = 1 AS chosen,
            sha256({head} || {f("replace(text, chr(10), '')")}) AS forged FROM documents, crc)""",
        "x0 AS (SELECT id, doc_id, leaf, source, CASE WHEN chosen THEN forged ELSE leaf END AS h, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos FROM leaf0)",
        "n0 AS (SELECT source, pos, leaf AS d, count(*) OVER (PARTITION BY source) AS n FROM x0)",
    ]

    def climb(k: int, of: str, key: str) -> None:
        x, n, r = (f"{c}{of}{k}" for c in "xnr")
        same = f"q.{key} IS NOT DISTINCT FROM r.{key} AND q.pos // 3 = r.run"
        parts.append(f"{r} AS (SELECT {key}, pos // 3 AS run, list(d ORDER BY pos) AS ds, any_value(n) AS n FROM {n} GROUP BY ALL)")
        parts.append(f"n{of}{k + 1} AS (SELECT {key}, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d, (n + 2) // 3 AS n FROM {r})")
        before, after = "array_to_string(ds[1:(q.pos % 3)::BIGINT], '')", "array_to_string(ds[(q.pos % 3 + 2)::BIGINT:], '')"
        parts.append(f"x{of}{k + 1} AS (SELECT q.* REPLACE (q.pos // 3 AS pos, CASE WHEN r.n > 1 THEN sha256({before} || h || {after}) ELSE h END AS h, CASE WHEN r.n > 1 THEN proof || {before} || {after} ELSE proof END AS proof) FROM {x} q JOIN {r} r ON {same})")

    for k in range(levels):
        climb(k, "", "source")
    parts.append(f"s0 AS (SELECT 0 AS one, source AS name, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM n{levels})")
    parts.append("nt0 AS (SELECT one, pos, subroot AS d, count(*) OVER () AS n FROM s0)")
    parts.append(f"xt0 AS (SELECT q.id, q.doc_id, q.leaf, s0.subroot, 0 AS one, q.h, q.proof, s0.pos FROM x{levels} q JOIN s0 ON q.source IS NOT DISTINCT FROM s0.name)")
    for k in range(tops):
        climb(k, "t", "one")
    last = f"SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = d AS verified FROM xt{tops}, nt{tops}"
    return "WITH " + ",\n".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts) + "\n" + last
