"""Streams that run until their source is exhausted, and stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scratch import scratch
from ..functions.text import legacy_args
from ..operators.tuples import apply_operator


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A table's files as a stream; ``files_per_batch`` throttles it."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parquet*")


def run_to_end(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run a stream over all its source holds now; the result is read back as a batch frame.

    Append writes through the file sink, whose log makes output exactly-once. Complete writes
    each batch's whole result in place of the last one, so a repeated batch changes nothing.
    Given the same ``checkpoint`` and ``out`` again, only new input is processed.
    """
    spark = stream.sparkSession
    out, checkpoint = out or scratch(spark, "stream-out"), checkpoint or scratch(spark, "stream-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _counted(group: str, order: str) -> Callable:
    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have = state.get[0] if state.exists else 0
        for rows in frames:
            yield pd.DataFrame({group: key[0], order: rows[order].sort_values().to_numpy(), "n": range(have + 1, have + len(rows) + 1)})
            have += len(rows)
        state.update((have,))

    return count


def running_counts(stream: DataFrame, group: str = "grp", order: str = "event_id") -> DataFrame:
    """A row per input row with its group's running count, kept in state across batches.

    Rows are counted as they arrive, one Arrow batch after another, so that a group of any size
    needs the memory of one; ``order`` holds within an Arrow batch, not across them.
    """
    return stream.select(group, order).groupBy(group).applyInPandasWithState(_counted(group, order), f"{group} string, {order} long, n long", "n long", "append", GroupStateTimeout.NoTimeout)


def suspicions(stream: DataFrame, silence: int, expiry: int, lateness: str = "0 seconds") -> DataFrame:
    """(host, ts, status): SUSPECTED after ``silence`` seconds without a sign of life, FAILED ``expiry`` later.

    ``stream`` has host and an event time ts; timers run on the watermark. A sign of life from
    a suspected host reports it ACTIVE again; a failed host's state is forgotten.
    """

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, status = state.get if state.exists else (0, "ACTIVE")
        told = []
        if state.hasTimedOut:
            if status == "ACTIVE":
                told = [(last + silence * 1000, "SUSPECTED")]
                state.update((last, "SUSPECTED"))
                state.setTimeoutTimestamp(max(last + (silence + expiry) * 1000, state.getCurrentWatermarkMs() + 1))
            else:
                told = [(last + (silence + expiry) * 1000, "FAILED")]
                state.remove()
        else:
            seen = max(int(f["ts"].max().value // 1_000_000) for f in frames)
            if status == "SUSPECTED" and seen > last:
                told = [(seen, "ACTIVE")]
            last = max(last, seen)
            state.update((last, "ACTIVE"))
            state.setTimeoutTimestamp(max(last + silence * 1000, state.getCurrentWatermarkMs() + 1))
        if told:
            yield pd.DataFrame({"host": key[0], "ts": pd.to_datetime([t for t, _ in told], unit="ms"), "status": [s for _, s in told]})

    timed = stream.select("host", "ts").withWatermark("ts", lateness)
    return timed.groupBy("host").applyInPandasWithState(watch, "host string, ts timestamp, status string", "last long, status string", "append", GroupStateTimeout.EventTimeTimeout)


def exactly_once(stream: DataFrame, id_col: str = "tuple_id", time_col: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """One row per id across batches and restarts; with an event time the ids kept are bounded."""
    if time_col is None:
        return stream.dropDuplicates([id_col])
    return stream.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark([id_col])


def run_to_console(stream: DataFrame, checkpoint: str, most: int = 20, mode: str = "append") -> None:
    """Print the first ``most`` rows of each batch on the driver until the source is exhausted."""
    stream.writeStream.outputMode(mode).format("console").option("numRows", most).option("truncate", False).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Pipeline:
    """A source and a list of stages, each a frame-to-frame function, run as batch or stream."""

    def __init__(self, *stages: Callable[[DataFrame], DataFrame]):
        self.stages = stages

    @classmethod
    def parse(cls, *specs: str, stages: int | None = None) -> Pipeline:
        """Stages from ``operator:arguments`` texts; their number must be ``stages`` if given."""
        if stages is not None and stages != len(specs):
            raise ValueError(f"{stages} stages were declared, {len(specs)} operators given")
        parsed = [legacy_args(spec) for spec in specs]
        return cls(*[partial(apply_operator, name=name, args=args) for name, args in parsed])

    def apply(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = stage(df)
        return df

    def stream(self, source: DataFrame, dest: str, checkpoint: str, ids: str | None = None) -> DataFrame:
        """Run over all the source holds; with ``ids``, tuples seen before are dropped."""
        return run_to_end(self.apply(exactly_once(source, ids) if ids else source), "append", checkpoint, dest)


def active(spark: SparkSession) -> list[dict]:
    """Running queries, by id and name."""
    return [{"id": q.id, "name": q.name, "active": q.isActive} for q in spark.streams.active]


def stop(spark: SparkSession, query_id: str) -> bool:
    """Stop a running query; whether there was one."""
    query = next((q for q in spark.streams.active if q.id == query_id), None)
    if query:
        query.stop()
    return query is not None


def progress(query) -> list[dict]:
    """Input and processing rates of a query's batches so far."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "input_rate": p["inputRowsPerSecond"], "rate": p["processedRowsPerSecond"]} for p in query.recentProgress]
