"""Throughput by window, and the scaling it calls for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rates(tuples: DataFrame, window: Column, *by: str) -> DataFrame:
    """(window, by..., n): tuples of each window."""
    return tuples.groupBy(window.alias("window"), *by).agg(F.count(F.lit(1)).alias("n"))


def rate_changes(samples: DataFrame, *by: str) -> DataFrame:
    """Each task's cumulative count as a rate since its sample before."""
    w = Window.partitionBy(*by).orderBy("ts")
    seconds = F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts"))
    return samples.withColumn("rate", F.try_divide(F.col("count") - F.lag("count").over(w), seconds))


def decisions(tasks: DataFrame, low: float, high: float, most: int = 10) -> DataFrame:
    """(stage, tasks, rate, decision): UP, DOWN or HOLD by the stage's average rate per task.

    ``tasks`` has a row per task (stage, stateful, rate); a task without a sample counts as
    zero. A stateful stage always holds; a stage keeps between one and ``most`` tasks.
    """
    staged = tasks.groupBy("stage").agg(F.max("stateful").alias("stateful"), F.count(F.lit(1)).alias("tasks"), F.sum(F.coalesce("rate", F.lit(0))).alias("rate"))
    busy, idle = F.col("rate") > high * F.col("tasks"), F.col("rate") < low * F.col("tasks")
    decision = F.when(F.col("stateful"), "HOLD").when(busy & (F.col("tasks") < most), "UP").when(idle & (F.col("tasks") > 1), "DOWN").otherwise("HOLD")
    return staged.select("stage", "tasks", "rate", decision.alias("decision"))


def round_robin(tasks: DataFrame, workers: int, *order: str, by: str) -> DataFrame:
    """Tasks dealt over workers in turn, counting within each ``by``."""
    turn = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return tasks.withColumn("worker", F.pmod(turn, F.lit(workers)))
