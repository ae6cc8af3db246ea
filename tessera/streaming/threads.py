"""Structured Streaming: thread state with resets, its history, joins of streams, windows, de-duplication and incremental upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.index import Table
from ..sources.files import scratch


def event_stream(spark: SparkSession, folder: str, table: str = "events", files: int = 1) -> DataFrame:
    """The events of a table, a file or a folder of part files, as a stream, with a time stamp that watermarks accept."""
    path = f"{folder}/{table}.parquet"
    s = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern: a stream takes a plain path for a folder
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, name: str, mode: str, partition: str | None = None) -> DataFrame:
    """Run a stream over all that is there, into a table in the shared folder, and read it. Complete mode replaces the table in each batch."""
    spark = stream.sparkSession
    at = scratch(spark, name)
    out = f"{at}/out"

    def store(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={i}")  # a batch that is run again replaces itself

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


class ThreadState(StatefulProcessor):
    """Per user: what counts since the reset of the largest id, and the events that a late reset could still take back.

    An event is kept by itself until the watermark has passed it and is a sum from then on; a reset empties the sums, as it is newer than all of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "last_reset long, n long, total double")
        self.open = handle.getListState("open", "event_id long, at long, value double")

    def _apply(self, rows: Iterable) -> None:
        last, n, total = self.totals.get() or (None, 0, 0.0)
        for part in rows:
            resets = part.event_id[part.deleted]
            if len(resets) and (last is None or resets.max() > last):
                last = int(resets.max())
                kept = [e for e in self.open.get() if e[0] > last]
                n, total = len(kept), float(sum(e[2] or 0.0 for e in kept))
                self.open.put(kept) if kept else self.open.clear()
            new = part[~part.deleted]
            new = new if last is None else new[new.event_id > last]
            if len(new):
                n, total = n + len(new), total + float(new.value.sum())
                self.open.appendList([(int(i), int(t), float(v)) for i, t, v in zip(new.event_id, new["at"], new.value.fillna(0.0), strict=True)])
        self.totals.update((last, n, total))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        self._apply(rows)
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + 1)
        yield self._row(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        seen = timerValues.getCurrentWatermarkInMs()
        kept = [e for e in self.open.get() if e[1] > seen]
        if kept:
            self.open.put(kept)
            self.handle.registerTimer(min(e[1] for e in kept) + 1)
        else:
            self.open.clear()
        return iter(())

    def _row(self, key):
        import pandas as pd

        last, n, total = self.totals.get()
        return pd.DataFrame({"user_id": pd.array([key[0]], "Int64"), "last_reset": pd.array([last], "Int64"), "n": [n], "total": [total]})

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB with a log of its changes, as long as a stream with state of its own runs."""
    want = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(f"spark.sql.streaming.stateStore.{k}", None) for k in want}
    for k, v in want.items():
        spark.conf.set(f"spark.sql.streaming.stateStore.{k}", v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.streaming.stateStore.{k}") if v is None else spark.conf.set(f"spark.sql.streaming.stateStore.{k}", v)


def thread_checkpoint(events: DataFrame, name: str, deleted: str = "error", late: str = "40 days") -> str:
    """Run the thread state over all events that are there; returns the folder of its checkpoint.

    Events may arrive in any order, `late` behind the newest at most; what comes later than that is dropped, and what is older cannot be taken back one by one.
    """
    spark = events.sparkSession
    at = scratch(spark, name)
    slim = events.withWatermark("ts", late).select("user_id", "event_id", "value", F.coalesce(F.col("event_type") == deleted, F.lit(False)).alias("deleted"), F.unix_millis("ts").alias("at"), "ts")
    with rocksdb(spark):
        out = slim.groupBy("user_id").transformWithStateInPandas(ThreadState(), "user_id long, last_reset long, n long, total double", "Update", "EventTime")
        out.writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).format("noop").start().awaitTermination()
    return f"{at}/checkpoint"


def stored_state(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """user_id, last_reset, n, total: the state as of a batch, the last one by default, read from the checkpoint."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "totals")
    x = (reader if batch is None else reader.option("batchId", batch)).load()
    return x.select("key.user_id", "value.*")


def state_history(spark: SparkSession, checkpoint: str) -> DataFrame:
    """step (the batch), user_id, last_reset, n, total: what each batch made of the threads it touched."""
    x = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "totals").option("readChangeFeed", "true").option("changeStartBatchId", 0).load()
    return x.filter("change_type = 'update'").select(F.col("batch_id").alias("step"), "key.user_id", "value.*")


def open_events(spark: SparkSession, checkpoint: str) -> DataFrame:
    """user_id, event_id, at, value: the events that are still kept one by one."""
    x = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    return x.select("key.user_id", "list_element.*")


def drained(events: DataFrame, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """All rows of build(events), a stream in append mode, those included that wait for the watermark.

    The events run first; then a closing row of a far future, all null but for its time, moves the watermark past everything and the same query, from its
    checkpoint, tells what was waiting. build must have one stateful step and let rows without keys go.
    """
    spark = events.sparkSession
    at = scratch(spark, name)
    closing = spark.createDataFrame([], events.schema)
    closing.write.parquet(f"{at}/closing")
    end = spark.readStream.schema(events.schema).parquet(f"{at}/closing")
    whole = build(events.unionByName(end))

    def store(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={i}")

    for close in (False, True):
        if close:
            nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name != "ts"]
            spark.range(1).select(*nulls, F.lit("2200-01-01").cast("timestamp").alias("ts")).select(events.columns).write.mode("append").parquet(f"{at}/closing")
        whole.writeStream.outputMode("append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    return spark.read.schema(whole.schema).parquet(f"{at}/out").select(*whole.columns)


def tokens_after(events: DataFrame, start: str, token: str, within: str = "30 minutes", late: str = "40 days") -> DataFrame:
    """start_id, user_id, us, closing: every start with each token of its user within the time given, null where there is none. Two streams joined by an interval.

    The closing row stays in, marked, and has a user where a join looks for one: dropped here, it would be dropped before it could move the watermark.
    """
    closing = F.col("event_id").isNull() & F.col("event_type").isNull()
    s = events.filter((F.col("event_type") == start) | closing).select(F.col("event_id").alias("start_id"), "user_id", F.col("ts").alias("started"), closing.alias("closing")).withWatermark("started", late)
    t = events.filter((F.col("event_type") == token) | closing).select(F.when(closing, F.lit(0)).otherwise(F.col("user_id")).alias("token_user"), F.col("ts").alias("spoken")).withWatermark("spoken", late)
    meet = F.expr(f"user_id = token_user AND spoken >= started AND spoken <= started + INTERVAL {within}")
    return s.join(t, meet, "left").select("start_id", "user_id", (F.unix_micros("spoken") - F.unix_micros("started")).alias("us"), "closing")


def first_token(events: DataFrame, start: str, token: str, name: str, within: str = "30 minutes", late: str = "40 days") -> DataFrame:
    """start_id, user_id, ms: from every start to the first token."""
    x = drained(events, lambda e: tokens_after(e, start, token, within, late), name)
    return x.filter("NOT closing").groupBy("start_id", "user_id").agg(F.expr("min(us) div 1000").alias("ms"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "40 days") -> DataFrame:
    """user_id, began, n, seconds: runs of a user's events with less than `gap` between two."""
    x = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("event_id").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("last"))
    return x.filter("n > 0").select("user_id", F.date_format("began", "yyyy-MM-dd HH:mm:ss").alias("began"), "n", F.expr("(unix_micros(last) - unix_micros(began)) div 1000000").alias("seconds"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("x")).select(key, "x.*")


def daily_counts(events: DataFrame) -> DataFrame:
    """Tumbling windows of a day by type; run it in complete mode, so that windows still open are told too."""
    w = events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def first_seen(events: DataFrame) -> DataFrame:
    return events.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])


def ingest(stream: DataFrame, key: str, order: str, name: str, buckets: int = 8) -> DataFrame:
    """Upsert the newest row per key into a bucketed table, in whatever order rows arrive; one run at a time."""
    spark = stream.sparkSession
    at = scratch(spark, name)
    table = Table(spark, f"{at}/table", key, buckets)
    table.create(spark.createDataFrame([], stream.schema))

    def store(batch: DataFrame, i: int) -> None:
        batch = batch.persist()
        new = latest(batch, key, order).select(stream.columns)
        if i:  # a stored row may be the newer one
            new = latest(table.get(new).select(stream.columns).unionByName(new), key, order).select(stream.columns)
        (table.upsert if i else table.create)(new)
        batch.unpersist()

    stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    return table.read().drop("bucket")
