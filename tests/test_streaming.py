import random

from tessera.plans import upkeep
from tessera.streaming import threads


def test_any_order_of_arrival_in_a_folder_of_part_files(spark, tmp_path):
    r = random.Random(8)
    # User 1 has most events; of its resets the last one arrives in the first file.
    rows = [(i, 1 if i % 3 else i % 7, "error" if i % 41 == 0 or i == 880 else f"t{i % 4}", float(i % 10)) for i in range(1, 900)]
    r.shuffle(rows)
    rows.sort(key=lambda x: x[0] != 880)
    for k in range(3):
        d = spark.createDataFrame(rows[k * 300 : k * 300 + 300], "event_id long, user_id long, event_type string, value double")
        d.selectExpr("*", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, event_id % 9) AS ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    newest, n, total = {}, {}, {}
    for i, u, kind, v in sorted(rows):
        newest[u] = (i, kind, v)
        n[u], total[u] = (0, 0.0) if kind == "error" else (n.get(u, 0) + 1, total.get(u, 0.0) + v)
    at = str(tmp_path)
    assert {x["user_id"]: (x["n"], x["total"]) for x in upkeep.stream_thread_state(spark, at).collect()} == {u: (n[u], total[u]) for u in n}
    assert {x["user_id"]: (x["event_id"], x["event_type"], x["value"]) for x in upkeep.stream_ingest(spark, at).collect()} == newest
    assert sum(x["n"] for x in upkeep.stream_daily_counts(spark, at).collect()) == len(rows)
    assert {(x["user_id"], x["event_type"]) for x in upkeep.stream_dedup(spark, at).collect()} == {(u, k) for _, u, k, _ in rows}


def parts(spark, at, batches):
    """Part files of events (event_id, user_id, event_type, value, seconds), read one a batch."""
    for rows in batches:
        d = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, second long")
        d.selectExpr("event_id", "user_id", "event_type", "value", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, second) AS ts").coalesce(1).write.mode("append").parquet(f"{at}/events.parquet")
    return threads.event_stream(spark, str(at))


def test_state_is_bounded_and_its_history_is_kept(spark, tmp_path):
    day = 86_400
    batches = [
        [(1, 1, "view", 1.0, 0), (2, 1, "view", 2.0, 10), (3, 2, "view", None, 20)],
        [(4, 1, "view", 4.0, 2 * day), (9, None, "view", 9.0, 2 * day)],  # the first events are settled now
        [(5, 1, "error", 0.0, 2 * day + 5), (7, 1, "view", 8.0, 2 * day + 9), (6, 2, "view", 1.0, 2 * day + 6)],
    ]
    at = threads.thread_checkpoint(parts(spark, tmp_path, batches), "bounded", late="1 hour")
    now = {r.user_id: (r.last_reset, r.n, r.total) for r in threads.stored_state(spark, at).collect()}
    assert now == {1: (5, 1, 8.0), 2: (None, 2, 1.0), None: (None, 1, 9.0)}
    steps = [(r.user_id, r.last_reset, r.n, r.total) for r in threads.state_history(spark, at).filter("user_id = 1").orderBy("step").collect()]
    assert sorted(steps, key=str) == sorted([(1, None, 2, 3.0), (1, None, 3, 7.0), (1, 5, 1, 8.0)], key=str)
    assert {r.event_id for r in threads.open_events(spark, at).collect()} <= {4, 6, 7, 9}
    first = threads.stored_state(spark, at, batch=0).collect()
    assert {(r.user_id, r.n) for r in first} == {(1, 2), (2, 1)}


def test_a_late_reset_takes_back_what_was_counted(spark, tmp_path):
    batches = [[(1, 1, "view", 1.0, 0), (3, 1, "view", 4.0, 30)], [(2, 1, "error", 0.0, 20)], [(1, 1, "view", 1.0, 0), (4, 1, "view", 2.0, 40)]]
    at = threads.thread_checkpoint(parts(spark, tmp_path, batches), "late")
    assert [tuple(r) for r in threads.stored_state(spark, at).collect()] == [(1, 2, 2, 6.0)]


def test_first_tokens_and_sessions(spark, tmp_path):
    batches = [
        [(1, 1, "click", 0.0, 100), (2, 1, "view", 0.0, 0), (3, 2, "view", 0.0, 0)],
        [(4, 1, "click", 0.0, 40), (5, 2, "click", 0.0, 5000), (6, None, "view", 0.0, 1), (7, None, "click", 0.0, 2), (8, 2, "view", 0.0, 4999)],
    ]
    e = parts(spark, tmp_path, batches)
    got = {(r.start_id, r.user_id, r.ms) for r in threads.first_token(e, "view", "click", "tokens").collect()}
    assert got == {(2, 1, 40_000), (3, 2, None), (8, 2, 1000), (6, None, None)}
    runs = {(r.user_id, r.began[11:], r.n, r.seconds) for r in threads.drained(e, lambda x: threads.sessions(x, "30 minutes"), "runs").collect()}
    assert runs == {(1, "00:00:00", 3, 100), (2, "00:00:00", 1, 0), (2, "01:23:19", 2, 1), (None, "00:00:01", 2, 1)}
