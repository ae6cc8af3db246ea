import random
from collections import defaultdict

from helpers import documents, hard_rows, words
from tessera.llm import packing as P


def naive(items, capacity):
    """Every open bin is looked at: the tightest compatible one, by residual."""
    bins, out = [], []
    for size, source, cluster in items:
        full, rest = divmod(size, capacity)
        for k in range(full + (rest > 0 or not full)):
            n = min(capacity, size - k * capacity)
            fit = [b for b in bins if b[0] >= n and source not in b[1] and cluster not in b[2]]
            residual = min((b[0] for b in fit), default=None)
            out.append(residual)
            b = next((b for b in fit if b[0] == residual), None)
            if b is None:
                b = [capacity, set(), set()]
                bins.append(b)
            b[0] -= n
            b[1].add(source)
            b[2].add(cluster)
    return len(bins), out


def test_always_the_tightest_compatible_bin():
    r = random.Random(4)
    for capacity in (1, 7, 64):
        for sources in (2, 6, 30):
            items = sorted(((r.randrange(capacity * 2), r.randrange(sources), r.randrange(12)) for _ in range(150)), reverse=True)
            bins: dict = defaultdict(lambda: [capacity, set(), set()])
            for (_, s, c), pieces in zip(items, P.pack(items, capacity), strict=True):
                for _, _, _, n, b in pieces:
                    fit = [x[0] for x in bins.values() if x[0] >= n and s not in x[1] and c not in x[2]]
                    x = bins[b]
                    assert s not in x[1] and c not in x[2] and x[0] >= n
                    assert x[0] == min(fit, default=capacity) or not x[1]
                    assert bool(x[1]) == bool(fit), "a new bin opens only if no open one fits"
                    x[0] -= n
                    x[1].add(s)
                    x[2].add(c)
            assert len(bins) <= naive(items, capacity)[0] + 2  # equal residuals may hold other bitmaps


def test_documents(spark):
    rows = [*hard_rows(), *((100 + i, words(i, 30 + i), f"s{i % 5}") for i in range(60))]
    out = P.pack_documents(documents(spark, rows), 200).collect()
    text = {(i, s): len((t or "").split()) for i, t, s in rows}
    total, bins = defaultdict(int), defaultdict(list)
    for r in out:
        total[r["doc_id"], r["source"], r["piece"]] += r["piece_size"]
        bins[r["bin_id"]].append(r)
    assert len(out) == sum(max(1, -(-len((t or "").split()) // 200)) for _, t, _ in rows)
    assert sum(r["piece_size"] for r in out) == sum(len((t or "").split()) for _, t, _ in rows)
    for b in bins.values():
        assert sum(r["piece_size"] for r in b) <= 200
        assert len({r["source"] for r in b}) == len(b)
    whole = defaultdict(str)
    for r in sorted(out, key=lambda r: r["piece"]):
        whole[r["doc_id"], r["source"]] += r["text"] or ""
    assert all(whole[i, s] == t for i, t, s in rows if i and i not in (7,) and t)
    assert all(len((r["text"] or "").split()) == r["piece_size"] for r in out if r["doc_id"] != 9)
    long = sorted((r["start"], r["piece_size"]) for r in out if r["doc_id"] == 6)
    assert long == [(k, min(200, text[6, "b"] - k)) for k in range(0, text[6, "b"], 200)]


def test_equal_rows_spread_over_shards(spark):
    rows = [(1, words(1, 20), "a")] * 1000
    from pyspark.sql import functions as F

    out = P.best_fit(documents(spark, rows), F.lit(20), F.xxhash64("text"), 100, shard=100).collect()
    assert len(out) == 1000 == len({r["bin_id"] for r in out})
    shards = [r["bin_id"] >> 32 for r in out]
    assert len(set(shards)) > 3 and max(map(shards.count, set(shards))) <= 400


def test_empty_table(spark):
    assert P.pack_documents(documents(spark, [])).count() == 0


def test_near_copies_are_never_in_one_bin(spark):
    text = words(9, 120, 3000).split()
    near = [" ".join(text), "  ".join(text), " ".join([*text[:-1], "other"])]
    rows = [(k, t, f"s{k}") for k, t in enumerate(near)] + [(10, None, "a"), (11, words(8, 30), "b")]
    out = P.pack_apart(documents(spark, rows), 1000).collect()
    assert sorted(r["doc_id"] for r in out) == [0, 1, 2, 10, 11]
    assert len({r["bin_id"] for r in out if r["doc_id"] < 3}) == 3
