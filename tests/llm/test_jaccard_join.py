import random
import re
from collections import Counter

import pytest
from helpers import documents, hard_rows, words
from tessera.llm import jaccard_join as J


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = min(J.N, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows):
    """(id, class, links) of every row, by comparing all pairs."""
    s = [sets(t) for _, t, _ in rows]
    near = [[j for j in range(len(rows)) if i != j and s[i] and s[j] and len(s[i] & s[j]) >= J.THRESHOLD * len(s[i] | s[j]) - 1e-9] for i in range(len(rows))]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        root[i] = (min(ids) if ids else None) if s[i] else rows[i][0]
    return Counter((rows[i][0], root[i], len(near[i])) for i in range(len(rows)))


def family(seed, n, size, edits):
    """Copies of one text with some words replaced, at similarities on both sides of the threshold."""
    r = random.Random(seed)
    base = words(seed, size).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows():
    passage = words(77, 60)
    out = hard_rows()
    out += [(1000 + i, t, "a") for i, t in enumerate(family(1, 60, 120, 6))]
    out += [(2000 + i, t, "b") for i, t in enumerate(family(2, 12, 40, 3))]
    out += [(3000 + i, words(300 + i, 150) + " " + passage, "a") for i in range(40)]
    out += [(4000 + i, words(9, 70), "c") for i in range(25)] + [(5000, "\n".join(words(9, 70).split()), "c")]
    out += [(6000 + i, " ".join(f"x{j}" for j in range(i, i + 30)), "a") for i in range(12)]
    out += [(7000 + i, " ".join(f"y{j}" for j in range(2 * i, 2 * i + 60)), "a") for i in range(40)]  # a long chain: its ends share nothing
    return out


@pytest.mark.parametrize("block", [1500, 7])
def test_classes_and_links_equal_all_pairs(spark, rows, block, monkeypatch):
    """With a small BLOCK, components go by bucket and buckets by pairs of blocks."""
    monkeypatch.setattr(J, "BLOCK", block)
    out = J.links(documents(spark, rows))
    assert Counter(tuple(r) for r in out.collect()) == brute(rows)


def test_one_of_each_class_stays(spark, rows):
    docs = documents(spark, rows)
    out = J.keep_one(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    classes = {c for _, c, _ in brute([r for r in rows if sets(r[1])])}
    full = [r for r in kept if sets(r["text"])]
    assert len(full) == len(classes) and {r["doc_id"] for r in full} == classes
    assert len(kept) - len(full) == sum(not sets(t) for _, t, _ in rows)


def test_pruning_keeps_what_may_reach_the_threshold():
    from math import comb

    for k, least in J.least_matches().items():
        below = sum(comb(k + 1, m) * 0.8**m * 0.2 ** (k + 1 - m) for m in range(least))
        assert below < J.TOLERANCE <= below + comb(k + 1, least) * 0.8**least * 0.2 ** (k + 1 - least)


def test_empty_table(spark):
    assert J.links(documents(spark, [])).count() == 0
    assert J.keep_one(documents(spark, [])).count() == 0
