"""What the operators of this subpackage share: reading, the word pattern and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BATCH_BYTES, bound_batches  # noqa: F401 (used by the operators)

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text as long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        at = f"{tempfile.gettempdir()}/tessera-shared"
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return at.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again.

    A lost executor then costs the tasks it was running, never the steps before this table. The table goes when the
    application ends, or earlier by drop().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(table: DataFrame) -> None:
    """Delete a table of durable() that nothing reads any more."""
    spark = table.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Keys that hold over one PARTS-th of all rows count as hot; there are at most PARTS of them, which bounds their broadcast.
PARTS = 5000


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], weight: str, rows: int, how: str = "inner") -> DataFrame:
    """left and right by keys without nulls, right having one row per key and in weight the rows that left has of it (rows in all).

    Hot keys, at most PARTS rows of right, meet by broadcast where the rows of left lie; the others by shuffle, where no key is
    hot any more, at every size of the tables. how: inner or left.
    """
    most = max(1, rows // PARTS)
    hot = right.filter(F.col(weight) > most)
    near = left.join(F.broadcast(hot), keys)
    far = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.filter(F.col(weight) <= most).hint("merge"), keys, how)
    return near.unionByName(far)


def slices(batches: Iterable, columns: list[str], text: str, most_bytes: int = 1 << 19) -> Iterator:
    """Cut Arrow record batches into runs of rows holding about most_bytes of text (a longer text alone is one run)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        begin, total = 0, 0
        for i, n in enumerate(size):
            if total and total + n > most_bytes:
                yield pa.Table.from_batches([batch.slice(begin, i - begin)]).select(columns)
                begin, total = i, 0
            total += int(n)
        yield pa.Table.from_batches([batch.slice(begin)]).select(columns)


def groups(batches: Iterable, keys: int) -> Iterator[tuple[tuple, list]]:
    """Runs of rows equal in their first `keys` columns, from Arrow batches sorted by them: (key, slices of batches)."""
    import numpy as np

    now, held = None, []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n - 1, bool)
        for k in range(keys):
            column = batch.column(k)
            x = column.to_numpy(zero_copy_only=False)
            change |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(batch.column(k)[a].as_py() for k in range(keys))
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held
