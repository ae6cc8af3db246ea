"""Session settings used by the tests, the bench and interactive work."""

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tessera", cpus: str = "8", memory: str = "8g") -> SparkSession:
    """A local session in UTC with AQE; on a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()))
        .getOrCreate()
    )


#: Most bytes of an Arrow batch on its way to a Python worker; Spark's own default is 64 MB for each task and direction.
BATCH_BYTES = 4 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """df, after lowering its session's Arrow batch size to BATCH_BYTES, unless it is lower already. Rows of long texts make the default batches heavy.

    The setting stays, as Spark reads it only when the result is computed, after the operator has returned.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key, "67108864b").rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df
