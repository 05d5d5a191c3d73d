"""Catalogue views and administration of block files, tallies of responses, positional joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import numbered
from .blocks import merged, order_violations
from .members import ACTIVE, JOINING
from .ring import cell


def file_id(name: Column | str) -> Column:
    """The short id of a file: the first 16 hexadecimal digits of its name's SHA-1."""
    return F.substring(F.sha1(name), 1, 16)


def stored_blocks(metadata: DataFrame, data: DataFrame) -> DataFrame:
    """Blocks whose data is there; listed blocks without data are left out."""
    return metadata.join(data.select("block_id", "data"), "block_id")


def _are(column: str, wanted: str | DataFrame, placed: DataFrame) -> DataFrame:
    """Rows of which ``column`` is a name, or one of those in a frame of that column."""
    return placed.where(F.col(column) == wanted) if isinstance(wanted, str) else placed.join(wanted.select(column).distinct(), column, "left_semi")


def files_on(placed: DataFrame, node: str | DataFrame) -> DataFrame:
    """Files on a node, or on the nodes of a frame."""
    return _are("node", node, placed).select("file", file_id("file").alias("file_id")).distinct()


def replicas_of(placed: DataFrame, file: str | DataFrame) -> DataFrame:
    """Replicas of a file, or of the files of a frame."""
    return _are("file", file, placed).select("file", file_id("file").alias("file_id"), "node", F.sha1("node").alias("node_pos"), "replica")


def members_by_position(members: DataFrame) -> DataFrame:
    """Members that are up or joining, with their place on the ring and rank in its order."""
    up = members.where(F.col("status").isin(ACTIVE, JOINING)).withColumn("node_pos", F.sha1(F.col("host").cast("string")))
    return numbered(up, cell("node_pos"), "node_pos", name="rank")


def existing(wanted: DataFrame, placed: DataFrame) -> DataFrame:
    return wanted.join(placed.select("file"), "file", "left_semi")


def readable(files: DataFrame, pending: DataFrame, client: str) -> DataFrame:
    """Files that ``client`` may read: those on which it has no write pending."""
    return files.join(pending.where(F.col("client") == client).select("file"), "file", "left_anti")


def replace_blocks(blocks: DataFrame, path: str) -> None:
    """Rewrite the files in ``blocks``, and no others, of a table partitioned by file."""
    blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(path)


def merge_files(copies: DataFrame, staging: str, path: str) -> DataFrame:
    """Merge all copies of blocks and rewrite their files at ``path``; the new blocks, and no others, are returned.

    The merged blocks are written to ``staging`` first. If a client's sequences don't rise
    in a file, nothing at ``path`` changes and ValueError names one such block. Each file's
    folder is replaced on its own: a reader may see some files new and others old meanwhile, and a
    job that ends midway is run again.
    """
    spark, new = copies.sparkSession, merged(copies)
    new.write.parquet(staging)
    held = spark.read.parquet(staging)
    wrong = order_violations(held).first()
    if wrong:
        raise ValueError(f"block {wrong['block_id']} of {wrong['file']} is out of order")
    replace_blocks(held, path)
    # The schema is given, since names of files that look like numbers would be read as such.
    return spark.read.schema(held.schema).parquet(path).join(held.select("file").distinct(), "file", "left_semi")


def without_files(blocks: DataFrame, deleted: DataFrame) -> DataFrame:
    return blocks.join(deleted.select("file"), "file", "left_anti")


def appended(*parts: DataFrame) -> DataFrame:
    """Appends of several clients as one frame, for one write."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def zipped(left: DataFrame, right: DataFrame, coarse: str, order: str) -> DataFrame:
    """Rows of two frames side by side by their position in ``order``; lengths must be equal."""
    a, b = numbered(left, F.col(coarse), order, name="position"), numbered(right, F.col(coarse), order, name="position")
    both = a.select("position", F.struct(*left.columns).alias("left")).join(b.select("position", F.struct(*right.columns).alias("right")), "position", "full")
    whole = F.col("left").isNotNull() & F.col("right").isNotNull()
    return both.withColumn("left", F.when(whole, F.col("left")).otherwise(F.raise_error(F.lit("the frames differ in length"))))


def tally(responses: DataFrame) -> DataFrame:
    """(answered, failed, count, failures): of (vm, count, error) responses of hosts."""
    failed = F.col("error").isNotNull()
    return responses.agg(F.count_if(~failed).alias("answered"), F.count_if(failed).alias("failed"), F.coalesce(F.sum(F.when(~failed, F.col("count"))), F.lit(0)).alias("count"), F.array_sort(F.collect_list(F.when(failed, F.col("vm")))).alias("failures"))


def sequences(blocks: DataFrame) -> DataFrame:
    """(client, first, last, n): the range of sequences of each client; gaps are where n falls short."""
    return blocks.groupBy("client").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count_distinct("seq").alias("n"))


def own_machine(hosts: DataFrame, machines: DataFrame) -> DataFrame:
    """(host, ip, vm): a host's machine by its name, else by its address."""
    by_name = machines.select(F.col("hostname").alias("host"), F.col("vm").alias("_by_name"))
    by_ip = machines.select("ip", F.col("vm").alias("_by_ip"))
    return hosts.join(by_name, "host", "left").join(by_ip, "ip", "left").select("host", "ip", F.coalesce("_by_name", "_by_ip").alias("vm"))


def with_rates(tasks: DataFrame, rates: DataFrame) -> DataFrame:
    """``tasks`` (task, ...) with the latest rate of each, zero for a task that has reported none."""
    latest = rates.groupBy("task").agg(F.max_by("rate", "ts").alias("rate"))
    return tasks.join(latest, "task", "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


def sampled(members: DataFrame, k: int, by: str, seed: int = 7) -> DataFrame:
    """``k`` members for each ``by``, drawn by a seeded hash, so every run draws alike."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col("host").cast("string"))), "host"))
    return members.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
