"""Sources and sinks over any file system Spark reads."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import numbered, strip_ws


def lines_with_numbers(spark: SparkSession, path: str | list[str], first: int = 0, separator: str | None = None) -> DataFrame:
    """(file, line_no, line) of text files, numbered in each file from ``first``.

    Lines end at any newline, or at ``separator`` alone. A file is read and numbered split by
    split, plus the lines of its earlier splits, so it may be larger than a task; names should
    differ, since ``file`` is the name without its folder. A final newline adds no line, an
    empty file has none.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    held = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    lined = numbered(held, F.col("split"), "at", name="line_no", by=("path",))
    return lined.select("file", (F.col("line_no") + first).alias("line_no"), "line")


def tuple_source(spark: SparkSession, path: str, run_id: str = "run") -> DataFrame:
    """(tuple_id, key, value, line_num): stripped lines keyed by file and 0-based line; blank ones are left out."""
    held = lines_with_numbers(spark, path).withColumn("value", strip_ws("line")).where("value <> ''")
    number = F.col("line_no").cast("string")
    return held.select(F.concat_ws("_", F.lit(run_id), "file", number).alias("tuple_id"), F.concat_ws(":", "file", number).alias("key"), "value", F.col("line_no").alias("line_num"))


def lines_of_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The lines of a text column: the frame's other columns, line_no (from 1), line."""
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.posexplode(F.split(text, "\n")).alias("_pos", "line")).select(*others, (F.col("_pos") + 1).alias("line_no"), "line")


def file_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def machines(spark: SparkSession, path: str) -> DataFrame:
    """(vm, hostname, ip) rows of a cluster configuration with an array ``vms``."""
    schema = "vms array<struct<id:int,hostname:string,ip:string,log_file:string>>"
    found = spark.read.schema(schema).option("multiLine", True).json(path)
    return found.select(F.explode("vms").alias("v")).select(F.col("v.id").alias("vm"), "v.hostname", "v.ip", "v.log_file")


def log_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """(ts, tag, message) of ``[time] [tag] message`` lines; the tag is optional."""
    part = lambda n: F.regexp_extract(column, r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3})\]\s*(?:\[([^\]]*)\]\s*)?(.*)$", n)
    return lines.select(F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).alias("ts"), part(2).alias("tag"), part(3).alias("message"))


def write_tuples(df: DataFrame, path: str, mode: str = "append") -> None:
    """``key TAB value`` lines."""
    df.select(F.concat_ws("\t", "key", "value").alias("value")).write.mode(mode).text(path)


def save_locally(spark: SparkSession, path: str, local: str) -> None:
    """Copy one file from any file system Spark reads to the driver's own, in pieces; an existing file there is an error."""
    if os.path.exists(local):
        raise FileExistsError(local)
    jvm = spark._jvm.org.apache.hadoop.fs
    source = jvm.Path(path)
    source.getFileSystem(spark._jsc.hadoopConfiguration()).copyToLocalFile(False, source, jvm.Path(os.path.abspath(local)), True)


def write_machines(machines: DataFrame, path: str) -> None:
    """A cluster configuration (vm, hostname, ip, log_file) as one JSON document with an array ``vms``."""
    entry = F.struct(F.col("vm").alias("id"), "hostname", "ip", "log_file")
    machines.agg(F.array_sort(F.collect_list(entry)).alias("vms")).coalesce(1).write.json(path)
