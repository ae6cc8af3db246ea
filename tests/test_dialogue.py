import contextlib
import io

from tessera.operators import dialogue
from tessera.plans.dialogue import sse_frames


def test_frames_of_a_user_never_meet_in_one_row(spark, sf):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        sse_frames(spark, sf).explain()
    assert "collect_list" not in out.getvalue()


def test_open_turns_are_rows(spark):
    rows = [(1, 1, "a"), (1, 2, dialogue.RESET), (1, 4, "c"), (1, 3, "b"), (2, 5, "d"), (3, 6, dialogue.RESET)]
    out = dialogue.open_turns(spark.createDataFrame(rows, "k long, o long, v string"), "k", "o", "v")
    assert sorted((r["k"], r["__i"], r["v"]) for r in out.collect()) == [(1, 1, "b"), (1, 2, "c"), (2, 1, "d")]
