import hashlib

from tessera.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, segments string, formatted long"


def rows(spark, r):
    return spark.createDataFrame([(*x, "clash", 1) for x in r], SCHEMA)


def test_escapes_reverse_exactly(spark):
    from pyspark.sql import functions as F

    nasty = ["", "\\", "\\e", "\\0\\1", "</s>", "<s></s>[INST][/INST][SYS][ROLE]x[/ROLE]", "<</s>/s>", "[[INST]INST]", "\\\\</s>\\", "é\x00🎉</s>\n"]
    d = spark.createDataFrame([(x,) for x in nasty], "t string").select("t", C.escape(F.col("t")).alias("e")).select("t", "e", C.unescape(F.col("e")).alias("u"))
    for r in d.collect():
        assert r["t"] == r["u"]
        assert not any(c in r["e"] for c in C.controls(C.TEMPLATE))


def test_turns_losses_and_machine(spark):
    data = [
        (1, 1, "assistant", "A </s> one"), (1, 0, "user", "Q[INST]"), (1, 2, "user", None), (1, 3, "assistant", ""),
        (2, 0, "assistant", "early"), (2, 1, "user", "q"), (3, 0, "tool]", "t"), (3, None, None, "null turn"),
        (4, 0, "user", "tie"), (4, 0, "user", "tie"), (4, 0, "assistant", "b"), (None, 0, "user", "x"), (5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "a" * 100_000),
    ]
    from pyspark.sql import functions as F

    out = C.format_conversations(rows(spark, data)).withColumn("back", C.read_back(F.col("formatted")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert len(got) == 6
    for k, r in got.items():
        turns = sorted((t for t in data if t[0] == k), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(b["role"], b["text"]) for b in r["back"]] == [(t[2] or "", t[3] or "") for t in turns]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert sum(s["loss"] for s in r["segments"]) == sum(t[2] == "assistant" for t in turns)
    assert {k: (r["valid"], r["n_legal"]) for k, r in got.items()} == {1: (True, 4), 2: (False, 0), 3: (False, 0), 4: (False, 0), None: (False, 1), 5: (True, 3)}


def test_query_adds_the_hostile_conversation(spark, sf):
    r = C.op1_chat_format(spark, sf).filter("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    told = "".join(f"{role}\n{text}\n" for role in ("user", "assistant"))
    assert r["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert (r["loss_chars"], r["loss_sha256"]) == (len(text), hashlib.sha256(text.encode()).hexdigest())


def test_empty_table(spark):
    assert C.format_conversations(rows(spark, [])).count() == 0
