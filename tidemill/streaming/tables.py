"""Tables that batches of a stream keep: keyed upserts, and windows with a list of late rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.members import merge_versions


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream over all its source holds; ``write`` gets each batch and its number, again after a failure."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a table of batches holds; an empty frame before its first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


@dataclass
class KeyedTable:
    """The latest record of each host, kept by batches of updates.

    A batch reads the buckets that its hosts fall into as batches before it left them, merges by
    version and writes those buckets whole under its own number. A repeated batch thus reads
    the same and replaces its own files: it changes nothing twice. Buckets that a batch doesn't
    touch are neither read nor written. Only the newest copy of a bucket counts; ``vacuum`` clears
    the rest.
    """

    spark: SparkSession
    path: str
    fields: dict[str, str]
    buckets: int = 16

    @property
    def columns(self) -> list[str]:
        return ["host", "incarnation", "heartbeat", "arrival", *self.fields]

    def _schema(self) -> str:
        kinds = {"host": "long", "incarnation": "long", "heartbeat": "long", "arrival": "long", **self.fields}
        return ", ".join(f"{c} {t}" for c, t in {**kinds, "batch": "long", "bucket": "int"}.items())

    def _newest(self, before: int | None = None, touched: DataFrame | None = None) -> DataFrame:
        held = _stored(self.spark, self.path, self._schema())
        if before is not None:
            held = held.where(F.col("batch") < before)
        if touched is not None:
            held = held.join(F.broadcast(touched), "bucket")  # at most ``buckets`` rows
        newest = held.groupBy("bucket").agg(F.max("batch").alias("batch"))
        return held.join(F.broadcast(newest), ["bucket", "batch"])

    def upsert(self, updates: DataFrame, batch: int) -> None:
        new = updates.select(*self.columns).withColumn("bucket", F.pmod(F.xxhash64("host"), F.lit(self.buckets)).cast("int"))
        touched = new.select("bucket").distinct()
        both = new.unionByName(self._newest(batch, touched).select(*self.columns, "bucket"))
        merged = merge_versions(both, *self.fields, "bucket").withColumn("batch", F.lit(batch).cast("long"))
        # A repeated batch replaces its own partition and no other.
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(self.path)

    def run(self, updates: DataFrame, checkpoint: str) -> DataFrame:
        """Take in all that a stream of updates holds now; the table's records after it."""
        each_batch(updates, self.upsert, checkpoint)
        return self.read()

    def read(self) -> DataFrame:
        return self._newest().select(*self.columns)

    def vacuum(self) -> int:
        """Delete copies of buckets that newer ones replace; how many."""
        held = _stored(self.spark, self.path, self._schema()).select("batch", "bucket").distinct()
        old = held.withColumn("last", F.max("batch").over(Window.partitionBy("bucket"))).where("batch < last").collect()
        for r in old:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={r['batch']}/bucket={r['bucket']}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return len(old)


@dataclass
class WindowedRates:
    """Tuples of each window and key of a stream, and the rows that came too late for theirs.

    The watermark of a batch is ``lateness`` seconds behind the latest event of the batches before
    it. A row is late if its window ended at or before that; it is not counted but listed, with
    the watermark that it missed. Each batch adds its own counts by window under its number, so
    windows are never held in memory and a repeated batch replaces what it wrote. Its latest
    event is stored beside them.
    """

    spark: SparkSession
    path: str
    lateness: int
    window: str = "hour"

    def take(self, batch: DataFrame, number: int) -> None:
        seen = _stored(self.spark, f"{self.path}/seen", "latest timestamp_ntz, batch long").where(F.col("batch") < number).agg(F.max("latest")).first()[0]
        start = F.date_trunc(self.window, "ts").cast("timestamp_ntz")
        watermark = F.lit(seen).cast("timestamp_ntz") - F.expr(f"interval {self.lateness} seconds")
        marked = batch.withColumn("window", start).withColumn("watermark", watermark)
        late = F.coalesce(F.col("window") + F.expr(f"interval 1 {self.window}") <= F.col("watermark"), F.lit(False))
        self._put(marked.where(~late).groupBy("window", "key").agg(F.count(F.lit(1)).alias("n")), "counts", number)
        self._put(marked.where(late).select("id", "ts", "key", "watermark"), "late", number)
        self._put(batch.agg(F.max("ts").alias("latest")), "seen", number)

    def _put(self, rows: DataFrame, name: str, number: int) -> None:
        numbered = rows.withColumn("batch", F.lit(number).cast("long"))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{name}")

    def run(self, stream: DataFrame, checkpoint: str, key: str = "key", id_col: str = "id", time: str = "ts") -> tuple[DataFrame, DataFrame]:
        """Take in all that a stream holds now: (window, key, n) and late (id, ts, key, watermark)."""
        rows = stream.select(F.col(id_col).cast("long").alias("id"), F.col(time).cast("timestamp_ntz").alias("ts"), F.col(key).cast("string").alias("key"))
        each_batch(rows, self.take, checkpoint)
        return self.rates(), self.late()

    def rates(self) -> DataFrame:
        return _stored(self.spark, f"{self.path}/counts", "window timestamp_ntz, key string, n long, batch long").groupBy("window", "key").agg(F.sum("n").alias("n"))

    def late(self) -> DataFrame:
        return _stored(self.spark, f"{self.path}/late", "id long, ts timestamp_ntz, key string, watermark timestamp_ntz, batch long").drop("batch")


def written_in_turn(df: DataFrame, path: str, part: Column, parts: int) -> None:
    """The frame as ``parts`` batches of files, one after another, for a stream that takes a batch at a time."""
    dealt = df.withColumn("_part", part)
    for i in range(parts):
        dealt.where(F.col("_part") == i).drop("_part").repartition(1).write.mode("append").parquet(path)


def in_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
