import struct
from collections import defaultdict

import xxhash
from helpers import documents, hard_rows, words
from tessera.llm import mixing as M

EPS = 1e-9


def water(sizes):
    """Targets by resharing until nobody is above the cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return out


def coin(a, b, seed):
    h = 42
    for v, n in ((a, 8), (b, 8), (seed, 4)):
        h = xxhash.xxh64_intdigest(struct.pack("<q" if n == 8 else "<i", v), h)
    return (h >> 11) / 2**53


def pivotal(items, seed):
    """The chain in plain Python: items as [key, words, p], longest first."""
    snap = lambda p: 0.0 if p < EPS else 1.0 if p > 1 - EPS else p
    left, done = None, {}
    for key, words_, p in items:
        both = [(key, words_, snap(p))]
        if left is not None:
            (a, wa, pa), (x, wx, px) = left, (key, words_, p)
            up, down = min((1 - pa) * wa, px * wx), min(pa * wa, (1 - px) * wx)
            g = up if coin(a, x, seed) * (up + down) < down else -down
            both = [(a, wa, snap(pa + g / wa)), (x, wx, snap(px - g / wx))]
        open_ = [b for b in both if 0 < b[2] < 1]
        done |= {k: p for k, _, p in both if not 0 < p < 1}
        left = open_[0] if open_ else None
    return left, done


def give_back(over, spare):
    """Keys whose copies change: spare as (words, key), all that may."""
    e, out = abs(over), []
    for w, k in sorted(spare, reverse=True):
        if w <= e:
            e -= w
            out.append((w, k))
    last = [x for x in spare if x not in out and x[0] < 2 * e]
    return {k for _, k in out + ([min(last)] if last else [])}


def test_copies_equal_a_plain_version(spark):
    from pyspark.sql import functions as F

    rows = [(i, words(i, 5 + 11 * (i % 17)), f"s{i % 3}") for i in range(45)]  # one cell per source, fewer than SPARE of a size class
    of = M.units(documents(spark, rows)).cache()
    keys = {(r["doc_id"]): r for r in of.withColumn("key", F.xxhash64("doc_id", "h", "size")).collect()}
    got = {r["doc_id"]: r for r in M.plan(documents(spark, rows)).collect()}
    seed, changed = 7, 0
    for s in ("s0", "s1", "s2"):
        mine = sorted((r for r in keys.values() if r["source"] == s), key=lambda r: (r["size"], r["key"]), reverse=True)
        x = got[mine[0]["doc_id"]]
        want = x["target"] / x["source_size"]
        base = int(want + EPS)
        left, done = pivotal([(r["key"], r["size"], max(0.0, want - base)) for r in mine], seed)
        if left:
            done[left[0]] = float(coin(left[0], 0, seed) < left[2])
        over = sum(r["size"] * (base + done[r["key"]]) for r in mine) - x["target"]
        flip = give_back(over, [(r["size"], r["key"]) for r in mine if done[r["key"]] == (over > 0)]) if want - base > EPS else set()
        changed += len(flip)
        assert {r["doc_id"]: got[r["doc_id"]]["copies"] for r in mine} == {r["doc_id"]: base + (1 - done[r["key"]] if r["key"] in flip else done[r["key"]]) for r in mine}
    assert changed


def test_twenty_sources_of_fifty_documents_meet_their_targets(spark):
    import random

    r = random.Random(3)
    rows = [(i, words(i, int(10 * 2 ** (9 * r.random() ** 2))), f"s{i % 20}") for i in range(1000)]
    taken, want, sizes = defaultdict(int), {}, defaultdict(list)
    for x in M.plan(documents(spark, rows)).collect():
        taken[x["source"]] += x["size"] * x["copies"]
        want[x["source"]] = x["target"]
        sizes[x["source"]].append(x["size"])
    assert len(want) == 20
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, sorted(sizes[s])[len(sizes[s]) // 2])


def test_targets_and_totals(spark):
    rows = [(i, words(i, 10 + i % 50), None if i % 7 == 0 else f"s{i % 7}") for i in range(900)] + [(2000 + i, words(i, 40), "s1") for i in range(900)] + hard_rows()
    docs = documents(spark, rows)
    out = M.plan(docs).collect()
    sizes, taken, want = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r["source"]] += r["size"] * r["m"]
        taken[r["source"]] += r["size"] * r["m"] * r["copies"]
        want[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2
    assert sum(r["m"] for r in out) == len(rows)
    exact = water(sizes)
    for s, t in want.items():
        assert abs(t - exact[s]) < 1e-6 * max(1, t)
    for s in ("s1", "s2", "s3", "s4", None):
        assert abs(taken[s] - want[s]) <= 15, "about the shortest documents"
    again = {(r["doc_id"], r["source"], r["h"]): r["copies"] for r in M.plan(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["source"], r["h"]): r["copies"] for r in out}


def test_mixed_rows(spark):
    docs = documents(spark, hard_rows() + [(100 + i, words(i, 30), f"s{i % 4}") for i in range(100)])
    out = M.mix(docs)
    assert out.columns == docs.columns
    of = {(r["doc_id"], r["source"], r["h"]): r["copies"] * r["m"] for r in M.plan(docs).collect()}
    assert out.count() == sum(of.values())


def test_empty_table(spark):
    assert M.plan(documents(spark, [])).count() == 0
    assert M.mix(documents(spark, [])).count() == 0
