"""Exact top-k search by inner product over a pivot-distance index."""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .training import fit_in_task
from .vectors import best_of, matrix, past_blocks, products, whole_vectors

#: Vectors in the fit at most, pivots at most, annuli of a pivot.
MOST_SAMPLED, MOST_PIVOTS, ANNULI = 8192, 4096, 16
#: Rows of a block, queries that meet one in a task, rows that a first look takes at least.
BLOCK_ROWS, GROUP_QUERIES, FIRST_ROWS = 4096, 16384, 4096
#: Rows of distances held at once, query rows of one Arrow batch sent, rounds of the fit.
AT_ONCE, SENT, ROUNDS = 64, 4096, 6
#: Relative slack of bounds, far above the rounding of double-precision distances.
SLACK = 1e-9


class Index:
    """Pivots, the edges of each one's annuli and, once counted, what every annulus holds.

    A vector's cell is its nearest pivot's number times ``ANNULI`` plus the annulus its distance
    falls into. Pivots come from a bounded sample, so they and the cells have a proven bound.
    """

    def __init__(self, pivots: np.ndarray, edges: np.ndarray):
        self.pivots, self.edges = pivots, edges
        self.low = self.high = self.norm = self.rows = self.slices = np.zeros(0)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Distances of each row to each pivot."""
        return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2 * x @ self.pivots.T + (self.pivots**2).sum(axis=1)))

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row and its distance to that cell's pivot."""
        nearest = np.concatenate([self.distances(x[i : i + AT_ONCE]).argmin(axis=1) for i in range(0, len(x), AT_ONCE)])
        distance = np.sqrt(((x - self.pivots[nearest]) ** 2).sum(axis=1))
        return nearest * ANNULI + (distance[:, None] >= self.edges[nearest]).sum(axis=1), distance

    def counted(self, found: list) -> Index:
        """The index with the extent, largest squared norm, rows and blocks of every cell.

        A crowded cell, such as copies of one vector make, has many blocks.
        """
        cells = len(self.pivots) * ANNULI
        self.low, self.high, self.norm, self.rows = np.full(cells, np.inf), np.full(cells, -np.inf), np.zeros(cells), np.zeros(cells, np.int64)
        for r in found:
            self.low[r["cell"]], self.high[r["cell"]], self.norm[r["cell"]], self.rows[r["cell"]] = r["low"], r["high"], r["norm"], r["n"]
        self.slices = np.maximum(1, -(-self.rows // BLOCK_ROWS))
        return self

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """What no row of a cell can exceed as inner product with a query; minus infinity for empty cells.

        With x at distance d(x, p) from its pivot, d(q, x) >= |d(q, p) - d(x, p)|, and q.x is
        (|q|^2 + |x|^2 - d(q, x)^2) / 2; also q.x = q.p + q.(x - p) <= q.p + |q| d(x, p).
        """
        each = lambda values: np.repeat(values, ANNULI, axis=1)
        there, size = each(self.distances(q)), (q * q).sum(axis=1)[:, None]
        held = self.rows > 0
        low, high = np.where(held, self.low, 0), np.where(held, self.high, 0)
        gap = np.maximum(0.0, np.maximum(low - there, there - high))
        scale = size + self.norm + there * there + high * high + 1
        gap = np.maximum(0.0, gap - SLACK * np.sqrt(scale))
        apart = (size + self.norm - gap * gap) / 2
        along = each(q @ self.pivots.T) + np.sqrt(size) * high
        return np.where(held, np.minimum(apart, along) + SLACK * scale, -np.inf)


def fit(sample: pa.Table, pivots: int) -> bytes:
    """Pivots by k-means over the sampled vectors, and quantiles of the distances to each as edges."""
    x = np.unique(matrix(sample.column("vector")), axis=0).astype(np.float64)
    pivots = max(1, min(pivots, len(x)))
    centres = x[np.random.default_rng(11).permutation(len(x))[:pivots]].copy()
    index = Index(centres, np.full((pivots, ANNULI - 1), np.inf))
    for turn in range(ROUNDS + 1):
        cells, distance = index.keys(x)
        nearest = cells // ANNULI
        for p in np.unique(nearest):
            if turn < ROUNDS:
                centres[p] = x[nearest == p].mean(axis=0)
            else:
                index.edges[p] = np.quantile(distance[nearest == p], np.arange(1, ANNULI) / ANNULI)
    out = io.BytesIO()
    np.savez(out, pivots=centres, edges=index.edges)
    return out.getvalue()


def _loaded(model: bytes) -> Index:
    with np.load(io.BytesIO(model)) as held:
        return Index(held["pivots"], held["edges"])


def _keyed(model: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _loaded(model)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vector")).astype(np.float64)
                cell, distance = index.keys(x)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(distance), pa.array((x * x).sum(axis=1))], ["id", "vector", "cell", "distance", "norm"])

    return run


def open_cells(index: Index, q: np.ndarray, least: np.ndarray, first: bool) -> list[np.ndarray]:
    """The cells each query looks into, in order of their bounds.

    At first it is those of the highest bounds that hold ``FIRST_ROWS`` rows between them; then
    all whose bound reaches ``least``, the score of the k-th best found so far.
    """
    bounds = index.bounds(q)
    order = np.argsort(-bounds, axis=1, kind="stable")
    if first:
        seen = np.cumsum((index.rows // index.slices)[order], axis=1)
        n = np.minimum((seen < FIRST_ROWS).sum(axis=1) + 1, (index.rows > 0).sum())
    else:
        n = ((bounds >= least[:, None]) & (index.rows > 0)).sum(axis=1)
    return [o[:m] for o, m in zip(order, n)]


def _asking(index: Index, first: bool) -> Callable:
    """Each query once per block it looks into; of a crowded cell's blocks the first look takes one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                held = batch.slice(i, AT_ONCE)
                q, least = matrix(held.column("vector")).astype(np.float64), held.column("least").to_numpy(zero_copy_only=False)
                cells = open_cells(index, q, least, first)
                for row, found in enumerate(cells):
                    n = np.ones(len(found), np.int64) if first else index.slices[found]
                    cell = np.repeat(found, n)
                    part = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
                    if first:
                        part = held.column("id")[row].as_py() % index.slices[found]
                    for j in range(0, len(cell), SENT):
                        taken = held.take(pa.array(np.full(len(cell[j : j + SENT]), row)))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell[j : j + SENT], pa.int32()), pa.array(part[j : j + SENT], pa.int32())], ["id", "vector", "least", "cell", "slice"])

    return run


def _matched(k: int) -> Callable:
    """Each query's k best of one block, from a stream of the block's rows followed by its queries."""

    def answers(ids: np.ndarray, x: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(0, batch.num_rows, 256):
            asked = batch.slice(i, 256)
            scores, out = products(matrix(asked.column("vector")), x), []
            queries, least = asked.column("id").to_pylist(), asked.column("least").to_numpy(zero_copy_only=False)
            # Most blocks hold nothing better than what a query has: only rows with a find are looked at one by one.
            for row in np.flatnonzero((scores >= least[:, None]).any(axis=1)):
                own = slice(*np.searchsorted(ids, [queries[row], queries[row] + 1]))
                s = np.delete(scores[row], own)
                kept = np.delete(np.arange(len(ids)), own)
                near = np.flatnonzero(s >= least[row])
                near = near[best_of(s[near], kept[near], k)]
                out += [(queries[row], i, v) for i, v in zip(ids[kept[near]].tolist(), s[near].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    return past_blocks(("cell", "slice", "grp"), matrix, answers)


def _scored(asked: DataFrame, index: DataFrame, groups: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k best of every block it looks into.

    A task holds one block and streams past it at most ``GROUP_QUERIES`` queries or so.
    """
    rows = index.select("cell", F.pmod(F.xxhash64("id", "vector"), F.col("slices")).cast("int").alias("slice"), "id", "vector")
    rows = rows.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("least", F.lit(0.0)).withColumn("asks", F.lit(0))
    queries = asked.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("asks", F.lit(1))
    key = ("cell", "slice", "grp")
    streamed = rows.unionByName(queries).select(*key, "asks", "id", "vector", "least").repartition(*key).sortWithinPartitions(*key, "asks")
    return streamed.mapInArrow(_matched(k), "query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query: str, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest inner products of every query row with other rows: query_id, rank (from 1), vec_id, score.

    ``is_query`` is an SQL condition on ``id``. Components count as ``floor(scale * component)``
    and scores are exact. The index keys every row by its nearest pivot and the annulus of its
    distance to it. A query first looks into the annuli of highest bound; the k-th best score
    found closes all annuli whose bound, by the triangle inequality, stays below it, and the
    query then goes through all that are open. So results are exact whatever the sample.

    Pivots grow with the root of the rows up to ``MOST_PIVOTS``; beyond, annuli are cut into more
    blocks. Vectors without structure leave most annuli open: the work is then that of all
    queries against all rows, in blocks of ``BLOCK_ROWS`` rows.

    Rows without an id, null vectors, null or non-finite components and unusual lengths take no
    part, zero vectors do. Of query rows that repeat an id the smallest vector asks; rows with the
    query's id are its own and no candidates; other repeated rows are candidates each. Equal
    scores are ranked by id. Vectors of any length and further columns, whatever their names,
    are fine. An empty table gives no rows; a score beyond 64 bits fails the job.
    """
    rows = whole_vectors(vectors, scale, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(MOST_SAMPLED).select("vector")
    pivots = min(MOST_PIVOTS, 1 + math.isqrt(rows.count()) // 4)
    model = fit_in_task(sample, lambda held: fit(held, pivots))
    if model is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index = materialise(rows.mapInArrow(_keyed(model), "id long, vector array<bigint>, cell int, distance double, norm double"), "pivot-index")
    held = _loaded(model).counted(index.groupBy("cell").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n")).collect())
    asked = index.where(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    groups = max(1, -(-asked.count() // GROUP_QUERIES))
    # At most ``MOST_PIVOTS * ANNULI`` rows, whatever the input.
    slices = vectors.sparkSession.createDataFrame([(c, int(n)) for c, n in enumerate(held.slices)], "cell int, slices int")
    index = index.join(F.broadcast(slices), "cell")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    shape = "id long, vector array<bigint>, least double, cell int, slice int"
    looked = _scored(asked.withColumn("least", F.lit(-math.inf)).mapInArrow(_asking(held, True), shape), index, groups, k)
    ranked = looked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
    least = ranked.select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least"))
    bounded = materialise(asked.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(-math.inf))), "pivot-bounds")
    found = _scored(bounded.mapInArrow(_asking(held, False), shape), index, groups, k)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "id % 50 = 0")
