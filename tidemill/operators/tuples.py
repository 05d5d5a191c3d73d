"""Operators over (key, value) tuples, and their registry by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_field, first_fields, numbered, strip_ws

#: Numbers of lines that one task counts in order.
CELL = 1 << 16


def identity(df: DataFrame) -> DataFrame:
    return df.select("key", "value")


def filter_literal(df: DataFrame, pattern: str) -> DataFrame:
    """Tuples whose value holds the pattern, literally and with its case."""
    return df.where(F.col("value").contains(F.lit(pattern)))


def transform_fields(df: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` comma fields of each value, untrimmed; the key stays."""
    return df.withColumn("value", first_fields("value", n))


def grouped_by_field(df: DataFrame, index: int) -> DataFrame:
    return df.withColumn("grp", csv_field("value", index))


def running_count(df: DataFrame, index: int, order: str = "line_num") -> DataFrame:
    """A row per input tuple: its group and how many of the group stand up to it.

    ``order`` is a number. A group is counted in cells of it, so that one with a third of all
    rows is many tasks' work.
    """
    counted = numbered(grouped_by_field(df, index).select(order, "grp"), F.floor(F.col(order) / CELL), order, name="n", by=("grp",))
    return counted.select(order, "grp", (F.col("n") + 1).alias("n"))


def final_count(df: DataFrame, index: int) -> DataFrame:
    return grouped_by_field(df, index).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def dedup_tuples(df: DataFrame, id_col: str = "tuple_id") -> DataFrame:
    """One row per tuple id; in a stream the checkpoint remembers the ids seen."""
    return df.dropDuplicates([id_col])


def skip_blank(df: DataFrame, column: str = "value") -> DataFrame:
    return df.where(strip_ws(column) != "")


def partition_of(key: Column | str, n: int) -> Column:
    """A partition by a hash of the key that every process and engine computes alike."""
    return F.pmod(F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long"), F.lit(n))


def upserted(state: Column | str, key: Column | str, value: Column | str) -> Column:
    """A map with ``value`` under ``key``, in place of what stood there; a null map counts as empty, a null key changes nothing."""
    state = F.col(state) if isinstance(state, str) else state
    key, value = (F.col(c) if isinstance(c, str) else c for c in (key, value))
    others = F.map_filter(state, lambda k, _: k != key)
    return F.when(key.isNull(), state).when(state.isNull(), F.create_map(key, value)).otherwise(F.map_concat(others, F.create_map(key, value)))


#: Operators by name; arguments arrive as a list of strings.
OPERATORS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {
    "filter": lambda df, args: filter_literal(df, args[0]),
    "count": lambda df, args: final_count(df, int(args[0])),
    "transform": lambda df, args: transform_fields(df, *map(int, args)),
    "identity": lambda df, args: identity(df),
}


def apply_operator(df: DataFrame, name: str, args: list[str]) -> DataFrame:
    """Apply an operator by name; a missing name or argument fails while planning."""
    if name not in OPERATORS:
        raise ValueError(f"no operator {name!r}; there are {sorted(OPERATORS)}")
    if name in ("filter", "count") and not args:
        raise ValueError(f"operator {name!r} needs an argument")
    return OPERATORS[name](df, args)
