"""Labelled samples and fits in a task, shared by the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled rows outside the held-out fold.

    Labels that repeat an id are averaged, null ones don't count. The sample takes the ids of
    smallest hash, so it doesn't depend on order or partitions; its at most ``most`` pairs of
    id and label are the only data broadcast.
    """
    pairs = pick(labels, doc_id="doc_id", label=label).withColumn("doc_id", F.col("doc_id").cast("long"))
    pairs = pairs.where(F.col("label").isNotNull() & (fold("doc_id", folds) != held))
    pairs = pairs.groupBy("doc_id").agg(F.avg("label").alias("label"))
    known = docs.select("doc_id", "text")
    chosen = pairs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return known.join(F.broadcast(chosen), "doc_id").select("text", "label")


def fit_in_task(rows: DataFrame, fit: Callable[[pa.Table], bytes]) -> bytes | None:
    """Run ``fit`` over a bounded frame in one task; None if it has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([fit(pa.Table.from_batches(held))], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(found[0]["model"]) if found else None
