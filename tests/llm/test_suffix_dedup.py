import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, hard_rows, words
from tessera.llm import suffix_dedup as S
from tessera.llm.ragged import Texts


def brute(texts):
    """Removed runs of each text, by counting every window."""
    raw = [(t or "").encode() for t in texts]
    c = Counter(x[i : i + S.LENGTH] for x in raw for i in range(len(x) - S.LENGTH + 1))
    return [S.merge([(i, i + S.LENGTH) for i in range(len(x) - S.LENGTH + 1) if c[x[i : i + S.LENGTH]] > 1]) for x in raw]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    p, q = words(50, 70), words(51, 45)
    exact = words(52, 60)[: S.LENGTH]
    out = hard_rows()
    for i in range(40):
        parts = [words(600 + i, r.randrange(20, 80))]
        for extra, chance in ((p, 0.5), (q, 0.4), (exact, 0.2), (p[7:350], 0.2), (exact[:-1], 0.3)):
            if r.random() < chance:
                parts += [extra, words(700 + i, r.randrange(1, 30))]
        out.append((100 + i, " ".join(parts), "a"))
    out += [(300, "z" * 199, "a"), (301, "z" * 200, "a"), (302, "y" * 201, "a"), (303, words(80, 90) + " " + words(80, 90), "a"), (304, "short", "b"), (305, "short", "b")]
    return out


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_removed_runs_equal_a_count_of_all_windows(spark, rows, crowd, monkeypatch):
    """With a small CROWD, buckets are split by window."""
    monkeypatch.setattr(S, "CROWD", crowd)
    want = defaultdict(list)
    for (i, t, _), spans in zip(rows, brute([t for _, t, _ in rows]), strict=True):
        want[i, t or ""].append(spans)
    out = S.with_spans(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        got = S.merge([(x["b"], x["e"]) for x in r["__spans"] or ()])
        assert got == want[r["doc_id"], bytes(r["__text"]).decode()][0], r["doc_id"]


def test_texts_without_their_repeats(spark, rows):
    docs = documents(spark, rows)
    out = S.remove_repeats(docs)
    assert out.columns == docs.columns
    spans = {(i, t): s for (i, t, _), s in zip(rows, brute([t for _, t, _ in rows]), strict=True)}
    want = Counter()
    for i, t, _ in rows:
        raw, keep = (t or "").encode(), []
        gone = np.zeros(len(raw), bool)
        for b, e in spans[i, t]:
            gone[b:e] = True
        at = 0
        for ch in t or "":
            n = len(ch.encode())
            if not gone[at : at + n].all():
                keep.append(ch)
            at += n
        want[i, None if t is None else "".join(keep)] += 1
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)


def test_query_tells_what_is_left(spark, sf):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = {}
    for i, x, spans in zip(t["doc_id"], t["text"], brute(t["text"]), strict=True):
        raw, at, kept = x.encode(), 0, b""
        for b, e in spans:
            kept, at = kept + raw[at:b], e
        want[i] = (len(raw), sum(e - b for b, e in spans), len(spans), hashlib.sha256(kept + raw[at:]).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in S.op10_suffix_dedup(spark, sf).collect()} == want


def test_every_window_has_one_row_and_equal_windows_the_same_anchor():
    texts = [words(i, 60) for i in range(4)] + ["", "x" * 199, "x" * 450]
    t = Texts(texts)
    doc, h, _, first, more, offset = S.anchors(t)
    seen: dict = {}
    count = Counter()
    for d, a, f, m, o in zip(doc, h, first, more, offset, strict=True):
        raw = texts[d].encode()
        for s in range(f, f + m + 1):
            count[d, s] += 1
            w = raw[s : s + S.LENGTH]
            assert len(w) == S.LENGTH and 0 <= f + o - s <= S.LENGTH - S.GRAM
            assert seen.setdefault(w, (a, f + o - s)) == (a, f + o - s)
    assert count == {(d, s): 1 for d, x in enumerate(texts) for s in range(len(x.encode()) - S.LENGTH + 1)}


def test_empty_table(spark):
    assert S.with_spans(documents(spark, [])).count() == 0
    assert S.remove_repeats(documents(spark, [])).count() == 0
