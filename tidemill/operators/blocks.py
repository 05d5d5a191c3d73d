"""Append-only block files: append, merge, order and gap validation, divergence, content.

Blocks are rows (file, replica, block_id, client, seq, ts, data); ``ts`` in microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_COLUMNS = ("file", "block_id", "client", "seq", "ts", "data")


def allocate_sequence(appends: DataFrame, *order: str) -> DataFrame:
    """Sequence numbers 0, 1, 2, ... of each client, over all its files, in arrival order."""
    return appends.withColumn("seq", (F.row_number().over(Window.partitionBy("client").orderBy(*order)) - 1).cast("long"))


def deduplicated(copies: DataFrame) -> DataFrame:
    """Of the copies of a block the earliest, the lowest replica on a tie; partial aggregation serves it."""
    earliest = F.min_by(F.struct("file", "client", "seq", "ts", "data"), F.struct("ts", "replica"))
    return copies.groupBy("block_id").agg(earliest.alias("b")).select("block_id", "b.*").select(*BLOCK_COLUMNS)


def merged(copies: DataFrame, create_first: bool = False) -> DataFrame:
    """Distinct blocks with their position in the file: by client, sequence, time, then block id.

    Clients sort as text, so the block of the creating client may follow others;
    ``create_first`` puts it at the head. Positions add a client's own rank to the number of
    blocks of the file's earlier clients, so that no file is sorted whole in one task.
    """
    blocks = deduplicated(copies)
    rank = F.when(F.lit(create_first) & (F.col("client") == "create"), "").otherwise(F.col("client"))
    counts = blocks.groupBy("file", "client").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("file").orderBy(rank)) - F.col("n")
    before = counts.select("file", "client", earlier.alias("before"))
    inner = F.row_number().over(Window.partitionBy("file", "client").orderBy("seq", "ts", "block_id"))
    ranked = blocks.withColumn("inner", inner).join(before, ["file", "client"])
    return ranked.select(*BLOCK_COLUMNS, (F.col("before") + F.col("inner")).alias("pos"))


def repaired(merged_blocks: DataFrame, expected: DataFrame) -> DataFrame:
    """The merged blocks on every node that should hold the file."""
    return merged_blocks.join(expected.select("file", "node"), "file")


def order_violations(blocks: DataFrame, pos: str = "pos") -> DataFrame:
    """Blocks whose sequence isn't above that of the client's block before, in file order."""
    last = F.lag("seq").over(Window.partitionBy("file", "client").orderBy(pos))
    return blocks.withColumn("last_seq", last).where(F.col("seq") <= F.col("last_seq"))


def sequence_gaps(blocks: DataFrame) -> DataFrame:
    """(client, seq, missing): sequences that a client's next one skips, over all its files."""
    last = F.lag("seq").over(Window.partitionBy("client").orderBy("seq"))
    held = blocks.select("client", "seq").distinct().withColumn("last_seq", last)
    return held.where(F.col("seq") - F.col("last_seq") > 1).select("client", "seq", (F.col("seq") - F.col("last_seq") - 1).alias("missing"))


def of_replica(copies: DataFrame, replica: int) -> DataFrame:
    """The blocks that one replica holds, each once, in the order of their files: what a read from it gives, gaps and all."""
    return merged(copies.where(F.col("replica") == replica))


def joined_bytes(pieces: Column) -> Column:
    """An array of BINARY values as one, in time that grows with their length."""
    return F.unhex(F.array_join(F.transform(pieces, lambda p: F.hex(p)), ""))


def content(merged_blocks: DataFrame, per_segment: int = 256) -> DataFrame:
    """(file, segment, start, length, data): content in segments of so many blocks, with byte offsets.

    Concatenating the segments by ``start`` gives the file; a whole file may not fit a row. BINARY
    blocks give BINARY segments, null ones count as empty.
    """
    segment = F.floor((F.col("pos") - 1) / per_segment).alias("segment")
    parts = merged_blocks.groupBy("file", segment).agg(F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("parts"))
    pieces = F.transform("parts", lambda p: p["data"])
    text = F.array_join(pieces, "") if dict(merged_blocks.dtypes)["data"] != "binary" else joined_bytes(F.array_compact(pieces))
    joined = parts.select("file", "segment", text.alias("data")).withColumn("length", F.octet_length("data").cast("long"))
    # Only lengths are put in order in a task of their own; the data stays where its segment is.
    lengths = merged_blocks.groupBy("file", segment).agg(F.sum(F.octet_length("data")).alias("length"))
    start = F.sum("length").over(Window.partitionBy("file").orderBy("segment")) - F.col("length")
    starts = lengths.select("file", "segment", F.coalesce(start, F.lit(0)).cast("long").alias("start"))
    return joined.join(starts, ["file", "segment"]).select("file", "segment", "start", "length", "data")


def divergence(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(file, replica, expected, present, surplus) block counts of each replica that differs."""
    have = actual.groupBy("file", "replica", "block_id").agg(F.count(F.lit(1)).alias("copies"))
    held = expected.select("file", "replica", "block_id").join(have, ["file", "replica", "block_id"], "left")
    counted = held.groupBy("file", "replica").agg(F.count(F.lit(1)).alias("expected"), F.count("copies").alias("present"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("surplus"))
    return counted.where("present < expected or surplus > 0")


def duplicate_ids(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("block_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def create_file(blocks: DataFrame, path: str) -> None:
    """A new block file; fails if the path exists."""
    blocks.write.mode("errorifexists").parquet(path)


def append_blocks(blocks: DataFrame, path: str) -> None:
    """Append to an existing block file; fails if it doesn't exist."""
    blocks.sparkSession.read.parquet(path).schema  # noqa: B018  raises for a missing path
    blocks.write.mode("append").parquet(path)


#: Blocks of a run whose lengths are added up in one task, and bytes of the cells by which ranges meet blocks.
RUN, CELL = 1 << 12, 1 << 20


def block_index(merged_blocks: DataFrame) -> DataFrame:
    """(file, pos, start, stop, data): merged blocks with the bytes of the file that each holds, as BINARY.

    Lengths add up by runs of blocks and then over the runs, so that no file's blocks are all
    put in order in one task. A null block is empty.
    """
    held = merged_blocks.select("file", "pos", F.coalesce(F.col("data").cast("binary"), F.lit(b"")).alias("data")).withColumn("run", F.floor(F.col("pos") / RUN))
    length = F.octet_length("data").cast("long")
    runs = held.groupBy("file", "run").agg(F.sum(length).alias("bytes"))
    before = runs.select("file", "run", (F.sum("bytes").over(Window.partitionBy("file").orderBy("run")) - F.col("bytes")).alias("before"))
    stop = F.sum(length).over(Window.partitionBy("file", "run").orderBy("pos"))
    placed = held.withColumn("within", stop).join(before, ["file", "run"])
    return placed.select("file", "pos", (F.col("before") + F.col("within") - length).alias("start"), (F.col("before") + F.col("within")).alias("stop"), "data")


def byte_ranges(index: DataFrame, wanted: DataFrame, cell: int = CELL) -> DataFrame:
    """(file, offset, length, bytes): what ``wanted`` (file, offset, length) asks of block files, one row each.

    A range that runs past the end of its file is cut there, one behind it is empty, and of a
    file without blocks it is null; null or negative offsets and lengths fail the job. Blocks and
    ranges are listed under the cells of bytes that they touch and meet there, so a range reads
    only blocks that overlap it; a pair in several cells counts in its first. Rows that ask for the
    same are answered together and come once each.
    """
    right = F.col("offset").isNotNull() & F.col("length").isNotNull() & (F.col("offset") >= 0) & (F.col("length") >= 0)
    asked = wanted.select("file", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"))
    asked = asked.withColumn("offset", F.when(right, F.col("offset")).otherwise(F.raise_error(F.lit("offsets and lengths of ranges are numbers from 0"))))
    known = asked.distinct()
    cells = lambda start, stop: F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(stop) - 1) / cell)))
    ranges = known.where("length > 0").select("file", "offset", "length", (F.col("offset") + F.col("length")).alias("last")).withColumn("cell", cells("offset", "last"))
    held = index.where("stop > start").withColumn("cell", cells("start", "stop"))
    met = ranges.join(held, ["file", "cell"]).where((F.col("start") < F.col("last")) & (F.col("offset") < F.col("stop")) & (F.col("cell") == F.floor(F.greatest("start", "offset") / cell)))
    skipped = F.greatest(F.col("offset") - F.col("start"), F.lit(0))
    piece = F.substring("data", (skipped + 1).cast("int"), (F.least("stop", "last") - F.greatest("start", "offset")).cast("int"))
    parts = met.groupBy("file", "offset", "length").agg(F.array_sort(F.collect_list(F.struct("start", piece.alias("piece")))).alias("parts"))
    joined = joined_bytes(F.transform("parts", lambda p: p["piece"]))
    there = index.select("file").distinct().withColumn("there", F.lit(True))
    found = asked.join(parts.select("file", "offset", "length", joined.alias("bytes")), ["file", "offset", "length"], "left").join(there, "file", "left")
    return found.select("file", "offset", "length", F.when(F.col("there"), F.coalesce("bytes", F.lit(b""))).alias("bytes"))


def sequence_ranges(blocks: DataFrame) -> DataFrame:
    """(client, first, last, n): runs of consecutive sequences of each client; expanding them gives its sequences.

    Runs are found in cells of sequences and those that touch are joined over cells, so a client
    of any size is the work of many tasks. Repeated sequences count once.
    """
    held = blocks.select("client", F.col("seq").cast("long").alias("seq")).where("seq is not null").distinct().withColumn("cell", F.floor(F.col("seq") / CELL))
    island = F.col("seq") - F.row_number().over(Window.partitionBy("client", "cell").orderBy("seq"))
    runs = held.withColumn("island", island).groupBy("client", "cell", "island").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    order = Window.partitionBy("client").orderBy("first")
    begins = F.coalesce(F.col("first") > F.lag("last").over(order) + 1, F.lit(True))
    joined = runs.withColumn("run", F.sum(begins.cast("int")).over(order)).groupBy("client", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return joined.select("client", "first", "last", (F.col("last") - F.col("first") + 1).alias("n"))
