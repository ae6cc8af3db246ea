"""Removal of repeated passages: a depth-limited radix sort of suffixes, spread over the cluster.

Only the first LENGTH bytes of a suffix matter. The first digit is chosen by content: every window of LENGTH bytes holds
an anchor, the GRAM-byte string with the least hash, which equal windows share at the same offset. A window belongs to the
bucket of its anchor, so one row per anchor (a run of consecutive windows) stands for about 85 suffixes.
Buckets with one row hold unique windows only and are dropped. Rows whose whole context (all bytes of their windows) is
equal repeat completely; one of them stands for all. What is left is ordered by further digits, most significant first: a bucket over
CROWD different contexts is split by Spark, pass after pass (WIDTHS), into windows whose anchor lies in the same stretch of places, by the bytes that
all windows of that stretch have, down to single windows if need be; a smaller bucket goes to one task, which passes
digits of 8, 64 and 128 bytes. Each pass drops what has become unique; what is equal after the last digit is exactly the repeated windows.
Hot anchors, contexts and texts meet their partners by broadcast (common.join_unique).

Cases: null is empty; texts under LENGTH bytes keep everything, however often they occur; texts are taken whole (a very long one in
pieces that overlap by a window), and matches stay inside a document; repeated rows are equal texts, so their windows repeat; ids may be null or
repeat; an empty table gives no rows; other columns are carried by remove_repeats() and ignored by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, durable, join_unique, read, slices
from .ragged import Texts, mix, repeated

LENGTH, GRAM = 200, 32
DIGITS = (8, 64, 128)
#: Places of the anchor in a window; contexts of a bucket up to which one task passes the digits; and how many places a stretch has in each pass over larger ones.
PLACES, CROWD, WIDTHS = LENGTH - GRAM + 1, 256, (64, 16, 4, 1)
BATCH_BYTES, PIECE = 1 << 20, 1 << 20
AT_ONCE = 400_000


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` keys, by prefix and suffix minima of blocks."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, keys.dtype)
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(keys.dtype).max, keys.dtype)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def anchors(t: Texts) -> tuple[np.ndarray, ...]:
    """Document, anchor hash, hash of the context, first window, windows - 1 and offset of the anchor, of each row."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    begin = np.arange(max(0, len(t.buf) - GRAM + 1))
    if not len(begin):
        return none
    gram = t.hashes(begin, begin + GRAM)
    least = _least((gram >> np.uint64(32) << np.uint64(32)) | begin.astype(np.uint64), LENGTH - GRAM + 1)
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    end = t.start[:-1] + t.size - LENGTH  # last window of each document
    some = np.flatnonzero(t.size >= LENGTH)
    if not len(some):
        return none
    inside = np.zeros(len(at) + 1, np.int32)
    np.add.at(inside, t.start[:-1][some], 1)
    np.subtract.at(inside, end[some] + 1, 1)
    inside = np.cumsum(inside[:-1]) > 0
    new = np.flatnonzero(inside & np.concatenate([[True], (at[1:] != at[:-1]) | ~inside[:-1]]))
    stop = np.flatnonzero(inside & np.concatenate([(at[1:] != at[:-1]) | ~inside[1:], [True]]))
    doc = np.searchsorted(t.start, new, "right") - 1
    return doc, gram[at[new]], t.hashes(new, stop + LENGTH), new - t.start[doc], stop - new, at[new] - new


def pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """A text in pieces whose windows are, one after the other, all its windows: (begin, bytes)."""
    for begin in range(0, max(1, len(text) - LENGTH + 1), PIECE):
        yield begin, text[begin : begin + PIECE + LENGTH - 1]


def pack(first: np.ndarray, more: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return first << 16 | more << 8 | offset


def windows_repeated(key: np.ndarray, t: Texts, more: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts t with their bucket keys: row and number of each window that occurs twice in a bucket, by digit passes.

    Equal windows hold their anchor at the same place, so the places are worked one stretch after the other, at most AT_ONCE windows or one place.
    """
    step = max(1, min(PLACES, PLACES * AT_ONCE // max(1, int((more + 1).sum()))))
    found = []
    for place in range(0, PLACES, step):
        low = np.maximum(offset - place - step + 1, 0)
        count = np.maximum(np.minimum(offset - place, more) - low + 1, 0)
        row = np.repeat(np.arange(len(count)), count)
        number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count - low, count)
        begin = t.start[row] + number
        group, depth = mix(key[row] + (offset[row] - number).astype(np.uint64)), 0
        for digit in DIGITS:
            group = mix(group + t.hashes(begin + depth, begin + depth + digit))
            keep = repeated(group)
            row, number, begin, group, depth = row[keep], number[keep], begin[keep], group[keep], depth + digit
        found.append((row, number))
    row, number = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((number, row))
    return row[order], number[order]


def runs(row: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last of each run of consecutive numbers."""
    if not len(row):
        return row, number, number
    cut = (np.diff(row) != 0) | (np.diff(number) != 1)
    a, b = np.concatenate([[True], cut]), np.concatenate([cut, [True]])
    return row[a], number[a], number[b]


def split(t: Texts, more: np.ndarray, offset: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Contexts cut by stretches of `width` places. For each stretch: rows, hash of the bytes that all its windows have, first window, windows - 1 and place of the first."""
    for low in range(0, PLACES, width):
        high = min(PLACES, low + width) - 1
        row = np.flatnonzero((offset >= low) & (offset - more <= high))
        last, first = np.minimum(offset[row], high), np.maximum(offset[row] - more[row], low)
        anchor = t.start[row] + offset[row]
        yield row, mix(t.hashes(anchor - low, anchor - high + LENGTH) + np.uint64(width * LENGTH + low)), offset[row] - last, last - first, last


def _named(docs: DataFrame, text: str) -> DataFrame:
    """docs with __text (binary) and __name (a digest of it)."""
    d = docs.withColumn("__text", F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit("").cast("binary")))
    return d.withColumn("__name", F.unhex(F.md5("__text")))


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """Rows (h, context, id, pack) of anchors, and rows (id, name, doc_id) of the texts they belong to."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        names, none = ["h", "context", "id", "pack", "name", "doc_id"], pa.nulls
        for part in slices(batches, ["name", "doc_id", "text"], "text"):
            each, kind = part["text"].to_pylist(), part["doc_id"].type
            for begin, some in [(0, each)] if len(each) > 1 else ((b, [x]) for b, x in pieces(each[0])):
                doc, h, context, first, more, offset = anchors(Texts(some))
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(context.view(np.int64)), pa.array(at + doc), pa.array(pack(begin + first, more, offset)), none(len(doc), pa.binary()), none(len(doc), kind)], names=names)
            n = len(each)
            yield pa.record_batch([none(n, pa.int64()), none(n, pa.int64()), pa.array(at + np.arange(n)), none(n, pa.int64()), part["name"].combine_chunks(), part["doc_id"].combine_chunks()], names=names)
            at += n

    return texts.mapInArrow(run, f"h long, context long, id long, pack long, name binary, doc_id {texts.schema['doc_id'].dataType.simpleString()}")


def _contexts(texts: DataFrame) -> DataFrame:
    """texts: id, text, rows. Rows (h, id, pack, kinds, bytes) of contexts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in slices(batches, ["id", "text", "rows"], "text"):
            for who, text, rows in zip(part["id"].to_pylist(), part["text"].to_pylist(), part["rows"].to_pylist(), strict=True):
                for k in range(0, len(rows), 4000):
                    some = rows[k : k + 4000]
                    raw = [text[(b := r["pack"] >> 16) : b + (r["pack"] >> 8 & 255) + LENGTH] for r in some]
                    yield pa.record_batch([pa.array([r["h"] for r in some]), pa.array([who] * len(some)), pa.array([r["pack"] for r in some]), pa.array([r["kinds"] for r in some]), pa.array(raw, pa.binary())], names=["h", "id", "pack", "kinds", "bytes"])

    return texts.mapInArrow(run, "h long, id long, pack long, kinds long, bytes binary")


def _split(contexts: DataFrame, width: int) -> DataFrame:
    """The windows of contexts by stretches of their anchor's place: rows (h, context, id, pack, bytes), h naming stretch and common bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in slices(batches, ["id", "pack", "bytes"], "bytes"):
            raw = part["bytes"].to_pylist()
            first, more, offset = (part["pack"].to_numpy() >> x & y for x, y in ((16, -1), (8, 255), (0, 255)))
            t, who = Texts(raw), part["id"].to_numpy()
            for row, h, begin, windows, place in split(t, more, offset, width):
                context = t.hashes(t.start[row] + begin, t.start[row] + begin + windows + LENGTH)
                own = [raw[r][b : b + w + LENGTH] for r, b, w in zip(row.tolist(), begin.tolist(), windows.tolist(), strict=True)]
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(context.view(np.int64)), pa.array(who[row]), pa.array(pack(first[row] + begin, windows, place)), pa.array(own, pa.binary())], names=["h", "context", "id", "pack", "bytes"])

    return contexts.mapInArrow(run, "h long, context long, id long, pack long, bytes binary")


def _compare(contexts: DataFrame) -> DataFrame:
    """Spans (id, b, e) of the windows that repeat, from contexts dealt by h, none of whose buckets is crowded."""

    def work(rows):
        import pyarrow as pa

        same = np.unique(np.stack([rows[c].to_numpy() for c in ("h", "id", "pack")]), axis=1, return_index=True)[1]  # rows of one id and text are one
        rows = rows.take(pa.array(same)) if len(same) < rows.num_rows else rows
        first, more, offset = (rows["pack"].to_numpy() >> x & y for x, y in ((16, -1), (8, 255), (0, 255)))
        row, number = windows_repeated(rows["h"].to_numpy().view(np.uint64), Texts(rows["bytes"].to_pylist()), more, offset)
        row, a, b = runs(row, number)
        return pa.record_batch([pa.array(rows["id"].to_numpy()[row]), pa.array(first[row] + a), pa.array(first[row] + b + LENGTH)], names=["id", "b", "e"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, total = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            total += batch.column(3).nbytes
            if total < BATCH_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            h = rows["h"].to_numpy()
            cut = int(np.argmax(h == h[-1]))  # the last bucket may go on
            if cut:
                yield work(rows.slice(0, cut))
                rows = rows.slice(cut)
            held, total = rows.combine_chunks().to_batches(), rows["bytes"].nbytes
        if held:
            yield work(pa.Table.from_batches(held))

    return contexts.select("h", "id", "pack", "bytes").repartition("h").sortWithinPartitions("h").mapInArrow(run, "id long, b long, e long")


def _sorted_out(rows: DataFrame, n: int, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (h, context, id, pack, carry), n of them, parted: spans of contexts that occur twice, and one row of each context whose bucket holds several, with their number as kinds."""
    one = [F.min_by(c, "id").alias(c) for c in carry]
    kinds = durable(rows.groupBy("h", "context").agg(F.count(F.lit(1)).alias("alike"), F.min("id").alias("id"), *one), "repeats-kinds")
    whole = join_unique(rows.select("h", "context", "id", "pack"), kinds.filter("alike > 1").select("h", "context", "alike"), ["h", "context"], "alike", n)
    first, more = F.shiftright("pack", 16), F.shiftright("pack", 8).bitwiseAND(255)
    spans = whole.select("id", first.alias("b"), (first + more + LENGTH).alias("e"))
    several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    return spans, join_unique(kinds.select("h", "id", *carry), several, ["h"], "kinds", n)


def repeated_spans(named: DataFrame) -> DataFrame:
    """name, m (rows), spans (array of struct(b, e), not merged) of every text (see _named) with a repeated window."""
    texts = named.filter(F.octet_length("__text") >= LENGTH).select(F.col("__name").alias("name"), "doc_id", F.col("__text").alias("text"))
    all_ = durable(_anchor_rows(texts), "repeats-anchors")
    ids, rows = all_.filter("h IS NULL").select("id", "name", F.col("doc_id").alias("own")), all_.filter("h IS NOT NULL").select("h", "context", "id", "pack")
    twice = durable(rows.groupBy("h").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "repeats-buckets")
    rows = durable(join_unique(rows, twice, ["h"], "size", rows.count()).drop("size"), "repeats-rows")
    whole, open_ = _sorted_out(rows, rows.count(), ["pack"])
    per_text = open_.groupBy("id").agg(F.collect_list(F.struct("h", "pack", "kinds")).alias("rows")).join(ids, "id").withColumnRenamed("name", "of")
    told = texts.join(per_text.hint("merge"), (F.col("name") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("own"))).select("id", "text", "rows")
    left = durable(_contexts(told), "repeats-contexts")
    spans = whole.unionByName(_compare(left.filter(F.col("kinds") <= CROWD)))
    left = left.filter(F.col("kinds") > CROWD).dropDuplicates(["h", "id", "pack"])
    for width in WIDTHS:
        if left.isEmpty():
            break
        parts = durable(_split(left, width), "repeats-split")
        more, left = _sorted_out(parts, parts.count(), ["pack", "bytes"])
        left = durable(left, "repeats-left")
        spans = spans.unionByName(more).unionByName(_compare(left.filter(F.col("kinds") <= CROWD)))
        left = left.filter(F.col("kinds") > CROWD)
    spans = spans.groupBy("id").agg(F.collect_list(F.struct("b", "e")).alias("spans")).join(ids, "id")
    return spans.groupBy("name").agg(F.count(F.lit(1)).alias("m"), F.first("spans").alias("spans"))  # copies repeat from end to end, each of them


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __text (bytes) and __spans: the byte runs to remove, merged by merge() where they are used."""
    named = _named(bound_batches(docs), text)
    told = durable(repeated_spans(named).select(F.col("name").alias("__name"), F.col("m").alias("__m"), F.col("spans").alias("__spans")), "repeats-spans")
    return join_unique(named, told, ["__name"], "__m", docs.count(), "left").drop("__name", "__m")


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, each text without its repeated runs; a character stays if any byte of it stays. n_chars, if there, follows."""
    columns = docs.columns
    kept = with_spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in columns if c != text)).alias("__row"), F.col("doc_id"), F.col(f"`{text}`").alias("__in")), "__in")
    kept = kept.select("__row", F.col("__in").isNull().alias("__null"), "__text", "__spans")
    schema = f"__row {kept.schema['__row'].dataType.simpleString()}, __kept string"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in slices(batches, ["__row", "__null", "__text", "__spans"], "__text"):
            out = []
            for null, raw, spans in zip(part["__null"].to_pylist(), part["__text"].to_pylist(), part["__spans"].to_pylist(), strict=True):
                pieces, at = [], 0
                for b, e in merge([(s["b"], s["e"]) for s in spans or ()]):
                    while b < e and raw[b] & 0xC0 == 0x80:
                        b += 1
                    while e > b and e < len(raw) and raw[e] & 0xC0 == 0x80:
                        e -= 1
                    pieces.append(raw[at:b])
                    at = e
                pieces.append(raw[at:])
                out.append(None if null else b"".join(pieces).decode("utf-8", "replace"))
            yield from part.select(["__row"]).append_column("__kept", pa.array(out, pa.string())).combine_chunks().to_batches()

    out = kept.mapInArrow(run, schema)
    pick = {c: F.col("__kept") if c == text else F.length("__kept").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"__row.`{c}`") for c in columns}
    return out.select(*(x.alias(c) for c, x in pick.items()))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = with_spans(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "__text", "__spans")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in slices(batches, ["doc_id", "__text", "__spans"], "__text"):
            size, gone, count, sha = [], [], [], []
            for raw, spans in zip(part["__text"].to_pylist(), part["__spans"].to_pylist(), strict=True):
                cut, kept, at = merge([(s["b"], s["e"]) for s in spans or ()]), hashlib.sha256(), 0
                for b, e in cut:
                    kept.update(raw[at:b])
                    at = e
                kept.update(raw[at:])
                size.append(len(raw))
                gone.append(sum(e - b for b, e in cut))
                count.append(len(cut))
                sha.append(kept.hexdigest())
            part = part.select(["doc_id"])
            for name, x in (("n_bytes", pa.array(size, pa.int64())), ("n_removed", pa.array(gone, pa.int64())), ("n_spans", pa.array(count, pa.int64())), ("kept_sha256", pa.array(sha, pa.string()))):
                part = part.append_column(name, x)
            yield from part.combine_chunks().to_batches()

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def oracle() -> str:
    """DuckDB SQL for op10_suffix_dedup: every window as a hash of its bytes, all counted."""
    return f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
d AS (SELECT doc_id, x, length(x) // 2 AS n FROM t),
w AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, {2 * LENGTH})) AS k FROM (SELECT doc_id, x, unnest(generate_series(0, n - {LENGTH})) AS s FROM d WHERE n >= {LENGTH})),
k AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, s FROM w SEMI JOIN k USING (k)),
g AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {LENGTH} THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS i FROM g),
c AS (SELECT doc_id, i, min(s) AS b, max(s) + {LENGTH} AS e FROM i GROUP BY ALL),
q AS (SELECT c.*, coalesce(lead(b) OVER (PARTITION BY doc_id ORDER BY b), d.n) AS next, d.x, d.n FROM c JOIN d USING (doc_id)),
o AS (SELECT doc_id, any_value(n) AS n, sum(e - b) AS gone, count(*) AS spans,
    substr(any_value(x), 1, 2 * min(b)) || string_agg(substr(x, 2 * e + 1, 2 * (next - e)), '' ORDER BY b) AS kept FROM q GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, d.x))) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)"""
