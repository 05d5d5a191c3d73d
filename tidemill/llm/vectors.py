"""Vectors as whole numbers, and exact inner products of blocks of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Beyond this a component's multiple is no longer told apart from its neighbours as a double.
LARGEST = float(1 << 53)


def whole_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str, **more: str) -> DataFrame:
    """(id, vector, more...) rows that take part, each component as ``floor(scale * component)``.

    Rows with a null id, a null vector or a null or non-finite component take no part, nor do
    those of another length than most vectors have (of equally frequent ones the shortest).
    Zero vectors do. A component beyond ``LARGEST`` fails the job by naming its row.
    """
    rows = pick(vectors, id=id_col, vector=vector_col, **more).withColumn("id", F.col("id").cast("long"))
    rows = rows.where("id is not null and vector is not null and forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vector") == (usual["n"] if usual else 0))
    large = F.expr(f"exists(vector, v -> abs({scale}D * double(v)) > {LARGEST}D)")
    error = F.raise_error(F.concat(F.lit("vector "), F.col("id").cast("string"), F.lit(" has a component too large for exact scores")))
    whole = F.expr(f"transform(vector, v -> floor({scale}D * double(v)))")
    return rows.withColumn("vector", F.when(large, error).otherwise(whole))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long number lists as a matrix of int64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two int64 matrices.

    Doubles carry them where every partial sum is a whole number below 2^53, else int64; a
    product that might not fit 64 bits raises OverflowError.
    """
    most = int(abs(a).max(initial=0)) * int(abs(b).max(initial=0)) * max(1, a.shape[1])
    if most >= 1 << 63:
        raise OverflowError("scores of these vectors do not fit 64 bits")
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest of one row of scores, ties to smaller ids, best first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= least)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]


def past_blocks(keys: tuple[str, ...], rows_of: Callable, answers: Callable) -> Callable:
    """A function for ``mapInArrow`` over a stream sorted by ``keys`` and ``asks``: blocks of rows, each followed by its queries.

    A block's rows (``asks`` 0) are gathered in the order of their ids; ``answers(ids, x, batch)``
    then yields what it finds for a batch of its queries (``asks`` 1). One block and one batch
    are held at a time, however many queries stream past. Queries of a block without rows find nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, ids, x = None, [], None, None
        for batch in batches:
            held = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*keys, "asks")], axis=1)
            starts = np.flatnonzero(np.r_[True, (held[1:] != held[:-1]).any(axis=1)]) if len(held) else []
            for start, stop in zip(starts, [*starts[1:], len(held)]):
                key, piece = tuple(held[start][:-1]), batch.slice(start, stop - start)
                if key != at:
                    at, parts, ids = key, [], None
                if not held[start][-1]:
                    parts.append((piece.column("id").to_numpy(), rows_of(piece.column("vector"))))
                elif parts:
                    if ids is None:
                        ids = np.concatenate([p[0] for p in parts])
                        order = np.argsort(ids, kind="stable")
                        ids, x = ids[order], np.concatenate([p[1] for p in parts])[order]
                    yield from answers(ids, x, piece)

    return run
