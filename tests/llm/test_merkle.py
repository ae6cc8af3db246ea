import random
from hashlib import sha256
from zlib import crc32

import pytest
from helpers import SCHEMA, documents, hard_rows

from tessera.llm import merkle


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc, text):
    f = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return H(*(f(x) for x in (*doc[:1], doc[3], doc[2], doc[4], text)))


def climb(nodes):
    """Levels of a plain tree, the last of one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def walk(levels, at, h):
    proof = ""
    for level in levels[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        before, after = "".join(run[: at % 3]), "".join(run[at % 3 + 1 :])
        proof, h, at = proof + before + after, H(before, h, after), at // 3
    return proof, h


def plain(rows):
    """rows: (doc_id, text, lang, source, n_chars)"""
    docs = sorted(((r, leaf(r, r[1])) for r in rows), key=lambda x: (x[0][3] is not None, (x[0][3] or "").encode(), x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {}
    for r, d in docs:
        trees.setdefault(r[3], []).append((r, d))
    levels = {s: climb([d for _, d in x]) for s, x in trees.items()}
    top = climb([x[-1][0] for x in levels.values()])
    out = []
    for k, (s, x) in enumerate(trees.items()):
        for i, (r, d) in enumerate(x):
            h = d
            if r[0] is not None and crc32(str(r[0]).encode()) % 2 == 0:
                h = leaf(r, r[1] and r[1].replace("\n", ""))
            a, h = walk(levels[s], i, h)
            b, h = walk(top, k, h)
            out.append((r[0], d, levels[s][-1][0], top[-1][0], H(a, b), h, h == top[-1][0]))
    return sorted(out, key=str)


def got(docs):
    return sorted(map(tuple, merkle.manifest(docs).collect()), key=str)


def rows_of(n, sources, seed=1):
    r = random.Random(seed)
    return [(i, r.choice(["a\nb", "c", "", None, "é\n🎉" * 3]) and f"{i}\n{r.random()}", r.choice(["en", None]), r.choice(sources), r.choice([None, i])) for i in range(n)]


@pytest.mark.parametrize("depth", [1, 2, 7])
def test_equals_a_plain_tree_at_every_block_size(spark, monkeypatch, depth):
    """Blocks of 3 and 9 nodes take several levels of distributed versions; 35 sources make a tall upper tree."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "BLOCK", 3**depth)
    rows = rows_of(150, [None, "", "hot", "hot", "hot", "é", "z", *(f"s{i}" for i in range(30))])
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(7)) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_sizes_around_powers(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "DEPTH", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = rows_of(n, ["one"])
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


def test_hard_rows(spark):
    docs = documents(spark, hard_rows())
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    out = got(docs)
    assert out == plain(rows) and len(out) == len(rows)


def test_empty(spark):
    out = merkle.manifest(documents(spark, []))
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_versions_share_all_nodes_but_ancestors():
    t = merkle.Persistent([H(str(i)) for i in range(81)])
    nodes, first = len(t.digest), t.digest[t.root]
    a = t.version(40, H("x"))
    b = t.version(41, H("y"))
    assert len(t.digest) == nodes + 2 * (1 + t.height)  # a leaf and its ancestors each
    assert t.digest[t.root] == first and len({first, t.digest[a], t.digest[b]}) == 3
    old, new = t.kids[t.root], t.kids[a]
    assert sum(x == y for x, y in zip(old, new, strict=True)) == 2


def test_line_feeds_decide_what_is_noticed(spark):
    even = [i for i in range(40) if crc32(str(i).encode()) % 2 == 0]
    rows = [(i, "a\nb" if i % 3 else "ab", "en", "s", 1) for i in range(40)]
    for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.verified == (r.doc_id not in even or r.doc_id % 3 == 0)
        assert (r.folded_root == r.root) == r.verified
