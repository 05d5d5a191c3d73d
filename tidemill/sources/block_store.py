"""A block store on disk: nested metadata as JSON, the blocks' bytes as files of their own or as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import BLOCK_COLUMNS
from ..operators.catalog import stored_blocks

METADATA = "filename string, blocks array<struct<block_id:string,client_id:string,sequence_num:bigint,timestamp:bigint,size:bigint>>"


def write_metadata(blocks: DataFrame, path: str, per_row: int = 4096) -> None:
    """JSON lines (filename, blocks): what is known of each file's blocks but their bytes.

    A row lists at most ``per_row`` blocks of a file in the order of their ids, so a large file
    has several; ``read_metadata`` takes all of them. Numbers are dealt by id, so no file's
    blocks meet in one task.
    """
    entry = F.struct(F.col("block_id").cast("string").alias("block_id"), F.col("client").alias("client_id"), F.col("seq").alias("sequence_num"), F.col("ts").alias("timestamp"), F.octet_length("data").cast("long").alias("size"))
    shares = blocks.groupBy("file").agg(F.ceil(F.count(F.lit(1)) / per_row).alias("shares"))
    dealt = blocks.join(shares, "file").withColumn("share", F.pmod(F.xxhash64("block_id"), F.col("shares")))
    rows = dealt.groupBy(F.col("file").alias("filename"), "share").agg(F.array_sort(F.collect_list(entry)).alias("blocks"))
    rows.select("filename", "blocks").write.json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, block_id, client, seq, ts, size) of the blocks listed; a file without blocks has no rows."""
    listed = spark.read.schema(METADATA).json(path).select(F.col("filename").alias("file"), F.explode("blocks").alias("b"))
    return listed.select("file", "b.block_id", F.col("b.client_id").alias("client"), F.col("b.sequence_num").alias("seq"), F.col("b.timestamp").alias("ts"), "b.size")


def write_block_texts(blocks: DataFrame, path: str) -> None:
    """A folder of one file for each block, its text with a newline behind it."""
    blocks.select(F.col("block_id").cast("string").alias("block"), F.col("data").cast("string").alias("value")).repartition("block").write.partitionBy("block").text(path)


def read_block_files(spark: SparkSession, path: str) -> DataFrame:
    """(block_id, data) of files named after their blocks: ``.../block=<id>/...`` with a newline behind, or ``<id>.blk`` as they are."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    folder, name = F.regexp_extract("path", r"/block=([^/]*)/[^/]*$", 1), F.regexp_extract("path", r"/([^/]*)\.blk$", 1)
    whole = F.substring("content", F.lit(1), F.octet_length("content") - 1)
    held = found.where((folder != "") | (name != ""))
    return held.select(F.when(folder != "", folder).otherwise(name).alias("block_id"), F.when(folder != "", whole).otherwise(F.col("content")).alias("data"))


def read_store(spark: SparkSession, metadata: str, files: str) -> DataFrame:
    """Blocks as they are listed with the bytes that are there; listed blocks whose file is missing are left out."""
    return stored_blocks(read_metadata(spark, metadata), read_block_files(spark, files)).select(*BLOCK_COLUMNS, "size")
