import random

from helpers import documents, hard_rows
from tessera.llm import token_counts as K


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(K.vocabulary("byte_bpe_50k.json"))


def test_counts_equal_the_library(spark):
    r = random.Random(3)
    alphabet = "aab bcde \n\t  \x85\x1c\x1f é漢字🎉1２³'s'll<|endoftext|> \r\x0b!?...--ßÑ́"
    rows = [*hard_rows(), *((100 + i, "".join(r.choice(alphabet) for _ in range(r.randrange(90))), "a") for i in range(300))]
    rows += [(900, "a" * 4000, "a"), (901, "ab" * 2000, "a"), (902, " " * 300, "a"), (903, "<|endoftext|>" * 3 + "x", "a"), (904, "aaaa bbbbb" * 40, "a")]
    t = library()
    out = K.count_tokens(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    for x in out:
        assert x["n_tokens"] == len(t.encode(x["text"] or "", add_special_tokens=False).ids), repr(x["text"])[:80]
        assert x["n_bytes"] == len((x["text"] or "").encode())


def test_remembered_counts_are_bounded(monkeypatch):
    m = K.Merger(K.vocabulary("byte_bpe_50k.json"))
    monkeypatch.setattr(K, "REMEMBERED", 5)
    monkeypatch.setattr(K, "ROUND_SYMBOLS", 8)
    texts = [f"word{i} other{i} thing" for i in range(40)]
    want = [len(library().encode(x).ids) for x in texts]
    assert [int(m.texts([x])[1][0]) for x in texts] == want
    assert len(m.known) < 12


def test_empty_table(spark):
    assert K.count_tokens(documents(spark, [])).count() == 0
