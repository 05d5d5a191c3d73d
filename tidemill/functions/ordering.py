"""Contiguous numbers in the order of any columns, by range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import scratch

#: Low bits of ``monotonically_increasing_id``, which count within a partition.
WITHIN = (1 << 33) - 1


def in_order(df: DataFrame, *order: Column | str, name: str = "line_num", first: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """The frame with each row's number in the order of ``order``, from ``first``; in each ``by`` if given.

    Spark samples the order, so partitions are ranges of like size whatever the values are: rows
    that tie are told apart by where they were read, and one value of a first column may fill
    many partitions. A row's number is its place in its sorted partition plus the rows of the
    partitions before. Rows are written to the shared folder once they are in order, since a
    second run of the range partitioning could draw other bounds. Nulls come first.
    """
    spark, keys = df.sparkSession, [F.col(c) if isinstance(c, str) else c for c in (*by, *order)]
    kept = df.columns
    # Renamed by position, so that no column's name can clash with those added here.
    held = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)], *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    held = held.withColumn("_read", F.monotonically_increasing_id())
    ranges = [f"_k{i}" for i in range(len(keys))] + ["_read"]
    path = scratch(spark, "in-order")
    held.repartitionByRange(*ranges).sortWithinPartitions(*ranges).withColumn("_place", F.monotonically_increasing_id()).drop("_read").write.parquet(path)
    found = spark.read.schema(held.drop("_read").withColumn("_place", F.lit(0).cast("long")).schema).parquet(path)
    found = found.withColumn("_part", F.shiftright("_place", 33))
    sizes = found.groupBy("_part").agg((F.max(F.col("_place").bitwiseAND(F.lit(WITHIN))) + 1).alias("_n"))
    # A row a range partition, so one task adds them up and all tasks may hold them.
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    number = F.col("_before") + F.col("_place").bitwiseAND(F.lit(WITHIN))
    numbered = found.join(F.broadcast(before), "_part").withColumn("_number", number)
    if by:
        groups = [f"_k{i}" for i in range(len(by))]
        starts = numbered.groupBy(*[F.col(g).alias(f"_g{g}") for g in groups]).agg(F.min("_number").alias("_start"))
        same = F.lit(True)
        for g in groups:
            same = same & F.col(g).eqNullSafe(F.col(f"_g{g}"))
        numbered = numbered.join(starts, same).withColumn("_number", F.col("_number") - F.col("_start"))
    return numbered.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)], (F.col("_number") + first).alias(name))
