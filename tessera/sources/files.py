"""Sources and sinks: Markdown folders, front matter, export CSV, JSON lines, rule files, and scratch space that all executors share."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset and the session is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"{tempfile.gettempdir()}/tessera-shared"
    return f"{at.rstrip('/')}/tessera"


def _folder(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new empty folder in the shared folder, which goes when the application ends."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    folder, fs = _folder(spark, path)
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


def stored(rows: DataFrame, path: str) -> DataFrame:
    """rows as a table at path, read again."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def fingerprint(rows: DataFrame, *marks: str) -> str:
    """What names a result of rows: the files they are read from, with sizes and times, the plan over them, and marks."""
    spark = rows.sparkSession
    files = sorted(rows.inputFiles())
    seen = []
    for parent in sorted({f.rsplit("/", 1)[0] for f in files}):
        folder, fs = _folder(spark, parent)
        seen += [f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in fs.listStatus(folder)]
    text = "\n".join([*marks, *rows.columns, str(rows.semanticHash()) if not files else "", *files, *seen])
    return f"{marks[0]}-{hashlib.sha256(text.encode()).hexdigest()[:24]}"


#: The named results of this process, by application: (application, name) -> folder.
_made: dict[tuple[str, str], str] = {}


def named(spark: SparkSession, name: str, build: Callable[[str], None]) -> str:
    """The folder that build has filled under this name, made once per application and deleted at its end."""
    key = (spark.sparkContext.applicationId, name)
    if key in _made:
        folder, fs = _folder(spark, _made[key])
        if fs.exists(folder):
            return _made[key]
    at = scratch(spark, name)
    build(at)
    _made[key] = at
    return at


def markdown_folder(spark: SparkSession, root: str) -> DataFrame:
    """source_path (below root), raw, modified: every .md file below root except a readme.md directly in it."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), f"^.*?{root.rstrip('/').rsplit('/', 1)[-1]}/", "")
    return files.select(path.alias("source_path"), F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("modified")).filter(F.lower("source_path") != "readme.md")


def split_front_matter(raw: Column) -> tuple[Column, Column]:
    """(map of the leading block's `name: value` lines, body). A byte order mark is allowed; without a closed block the map is empty."""
    pattern = r"(?s)^\x{FEFF}?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"
    block = F.regexp_extract(raw, pattern, 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    entries = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+)\s*:", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[\w-]+\s*:", "")), r"^[\"']|[\"']$", "").alias("value")))
    last = F.filter(entries, lambda e: F.element_at(F.filter(entries, lambda o: o["key"] == e["key"]), -1)["value"] == e["value"])
    fields = F.map_from_entries(F.array_distinct(last))
    return fields, F.regexp_replace(raw, pattern, "")


def as_list(value: Column) -> Column:
    """`[a, b]` or `a, b` as an array."""
    return F.filter(F.transform(F.split(F.regexp_replace(value, r"^\[|\]$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quoted cells over several lines and cells of any length."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', quote='"', encoding="UTF-8", maxCharsPerColumn=-1)


def write_export(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=True, sep=sep, emptyValue="")


def read_jsonl(spark: SparkSession, path: str, schema: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    rows = spark.read.schema(schema).json(path)
    return rows.withColumns({c: F.coalesce(F.col(c), v) for c, v in (defaults or {}).items()})


def write_markdown(rows: DataFrame, path: str) -> None:
    """Articles (name, front: map of strings, body) as text, a folder name=<name> for each; stale ones go, as the whole path is replaced."""
    front = F.array_join(F.transform(F.array_sort(F.map_entries("front")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    text = F.concat(F.lit("---\n"), front, F.lit("\n---\n\n"), F.col("body"))
    rows.select("name", text.alias("value")).repartition("name").write.mode("overwrite").partitionBy("name").text(path)


def cache_key(kind: str, model: str, payload: Column, version: int = 1) -> Column:
    """SHA-256 of the canonical JSON of version, kind, model and payload."""
    head = json.dumps({"kind": kind, "model": model}, sort_keys=True)[:-1]
    return F.sha2(F.concat(F.lit(head + ', "payload": '), F.to_json(F.struct(payload.alias("p"))), F.lit(f', "version": {version}}}')), 256)
