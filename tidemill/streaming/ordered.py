"""Stateful stream operators that work in event order: running counts and member states."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.members import ALIVE, JOIN, LEAVE, MemberClock
from .runs import run_to_end

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows of a key that one element of its buffer holds at most.
RUN_ROWS = 1 << 16


def packed(rows: np.ndarray) -> list[tuple[bytes]]:
    return [(rows[i : i + RUN_ROWS].tobytes(),) for i in range(0, len(rows), RUN_ROWS)]


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Operators with several states and timers need RocksDB; queries started inside get it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_ordered(stream: DataFrame, **options: str) -> DataFrame:
    """``run_to_end`` for the operators of this module."""
    with rocksdb(stream.sparkSession):
        return run_to_end(stream, **options)


class Reordered(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them, then hands them on in order.

    Rows are whole numbers (ms, tie, ...) with an event time in milliseconds; subclasses take those up to
    the watermark, sorted, in ``release`` and say when they want to be woken next. The buffer
    holds a key's rows of one lateness, whatever order batches bring them in. It is a list of
    runs of packed rows, so that a call to the state moves up to ``RUN_ROWS`` rows, not one.
    """

    columns: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "rows binary")

    def release(self, key: tuple, rows: np.ndarray, watermark: int) -> tuple[pd.DataFrame | None, int | None]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [np.column_stack([frame[c].astype("int64").to_numpy() for c in self.columns]) for frame in rows if len(frame)]
        if new:
            self.pending.appendList(packed(np.concatenate(new)))
            # Timers at or before the watermark fire with the next batch.
            self.handle.registerTimer(max(int(min(x[:, 0].min() for x in new)), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, width = timerValues.getCurrentWatermarkInMs(), len(self.columns)
        held = np.concatenate([np.zeros((0, width), np.int64), *[np.frombuffer(run, np.int64).reshape(-1, width) for (run,) in self.pending.get()]])
        held = held[np.lexsort(held.T[::-1])]
        n = int(np.searchsorted(held[:, 0], watermark, side="right"))
        if n:
            self.pending.put(packed(held[n:])) if n < len(held) else self.pending.clear()
        out, wake = self.release(key, held[:n], watermark)
        wakes = [t for t in (int(held[n, 0]) if n < len(held) else None, wake) if t is not None]
        if wakes:
            self.handle.registerTimer(min(wakes))
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


class Counting(Reordered):
    """Numbers a group's rows of one cell of time."""

    columns = ("ms", "id")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counted = handle.getValueState("counted", "n long")

    def release(self, key, rows, watermark):
        if not len(rows):
            return None, None
        before = self.counted.get()[0] if self.counted.exists() else 0
        self.counted.update((before + len(rows),))
        return pd.DataFrame({"grp": key[0], "cell": key[1], "ms": rows[:, 0], "id": rows[:, 1], "n": np.arange(before + 1, before + len(rows) + 1)}), None


def ordered_counts(stream: DataFrame, lateness: str, group: str = "grp", order: str = "event_id", time: str = "ts", cell: str = "1 hour") -> DataFrame:
    """(grp, cell, ms, id, n): each row with its place among its group's rows of one cell of time.

    Rows count in the order of (event time in milliseconds, ``order``) however batches bring them; the
    watermark, ``lateness`` behind the latest event, releases them. A group is dealt over cells,
    so a hot one is the work of as many tasks as cells are open. Rows later than that are dropped;
    ``late_rows`` lists them.
    """
    rows = stream.select(F.col(group).alias("grp"), F.col(order).cast("long").alias("id"), F.col(time).cast("timestamp").alias("ts"))
    rows = rows.withWatermark("ts", lateness).withColumn("cell", F.unix_millis(F.window("ts", cell)["start"])).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("grp", "cell").transformWithStateInPandas(Counting(), "grp string, cell long, ms long, id long, n long", "append", "eventTime")


def running_totals(counts: DataFrame) -> DataFrame:
    """Running counts of whole groups from ``ordered_counts``: each cell's number plus the rows of the group's earlier cells."""
    cells = counts.groupBy("grp", "cell").agg(F.max("n").alias("rows"))
    earlier = F.sum("rows").over(Window.partitionBy("grp").orderBy("cell")) - F.col("rows")
    return counts.join(cells.select("grp", "cell", earlier.alias("earlier")), ["grp", "cell"]).select("grp", "ms", "id", (F.col("n") + F.col("earlier")).alias("n"))


class Watching(Reordered):
    """A host's state, moved on by its signs and by the clock."""

    columns = ("ms", "kind")

    def __init__(self, silence: int, expiry: int, cleanup: int):
        self.limits = (silence, expiry, cleanup)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.status = handle.getValueState("status", "status string, since long")

    def release(self, key, rows, watermark):
        clock = MemberClock(*self.limits, *(self.status.get() if self.status.exists() else (None, 0)))
        told = [t for ms, kind in rows.tolist() for t in clock.sign(ms, kind)] + clock.until(watermark + 1)
        if clock.status is None:
            self.status.clear()
        else:
            self.status.update((clock.status, clock.since))
        out = pd.DataFrame({"host": key[0], "ms": [t for t, _ in told], "status": [s for _, s in told]}) if told else None
        return out, clock.deadline()


def member_states(stream: DataFrame, silence: int, expiry: int, cleanup: int, lateness: str = "0 seconds") -> DataFrame:
    """(host, ms, status): each change of a host's state, from a stream of signs (host, ts, kind).

    The states and rules are those of ``members.status_changes``, which gives the same rows for
    a whole table; times are in milliseconds, limits in seconds. Signs are taken in event order
    once the watermark, ``lateness`` behind the latest sign of any host, has passed them.
    """
    rows = stream.select(F.col("host").cast("string").alias("host"), F.col("ts").cast("timestamp").alias("ts"), F.col("kind"))
    code = F.when(F.col("kind") == "JOIN", JOIN).when(F.col("kind") == "LEAVE", LEAVE).otherwise(ALIVE)
    rows = rows.withWatermark("ts", lateness).withColumn("ms", F.unix_millis("ts")).withColumn("kind", code)
    watching = Watching(silence * 1000, expiry * 1000, cleanup * 1000)
    return rows.groupBy("host").transformWithStateInPandas(watching, "host string, ms long, status string", "append", "eventTime")
