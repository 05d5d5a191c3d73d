"""Table functions for SQL: any number of rows from a tuple, and state over the rows of a partition."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="pos int, field string")
class FieldsWith:
    """``fields_with(value, part)``: the comma fields of a value that hold ``part``, with their places from 0.

    No row for a null value or where no field holds it; an empty ``part`` is in every field.
    """

    def eval(self, value: str, part: str) -> Iterator[tuple[int, str]]:
        for pos, field in enumerate((value or "").split(",") if value is not None else []):
            if (part or "") in field:
                yield pos, field


@udtf(returnType="grp string, id long, n long")
class CountInOrder:
    """``count_in_order(table(select grp, id, ...) partition by grp order by ...)``: each row with its group's count so far.

    Spark sorts each partition and streams it in; of a group only the count is held.
    """

    def __init__(self) -> None:
        self.n = 0

    def eval(self, row: Row) -> Iterator[tuple[str, int, int]]:
        self.n += 1
        yield row["grp"], row["id"], self.n


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql`` by their names."""
    spark.udtf.register("fields_with", FieldsWith)
    spark.udtf.register("count_in_order", CountInOrder)
