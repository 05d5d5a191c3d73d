"""Approximate nearest neighbours by learned partitions of a neighbour graph."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, pick, table
from .training import fit_in_task
from .vectors import past_blocks

#: Vectors in a fit at most, rows of a part and of a block, fewest parts, rows a part has at least.
MOST_SAMPLED, PART_ROWS, BLOCK_ROWS, LEAST_PARTS, LEAST_ROWS = 8000, 3000, 4096, 16, 100
#: Parts from which a second level divides them, parts that the first then has, and parts of one of them at most.
ONE_LEVEL, TOP_PARTS, INNER_PARTS = 64, 64, 512
#: Queries that meet one block in a task, queries of one matrix product, rows of one Arrow batch sent.
GROUP_QUERIES, AT_ONCE, SENT = 16384, 256, 4096
#: Neighbours in the graph, slack of a part, refinement rounds, recall to reach on the sample.
GRAPH, SLACK, PASSES, AIM = 10, 1.1, 6, 0.95
HIDDEN, EPOCHS, BATCH, RATE = 64, 60, 256, 0.01


def sample_neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Indexes of each row's k nearest others, by brute force in blocks."""
    norms, out = (x * x).sum(axis=1), []
    for i in range(0, len(x), 512):
        d = norms[None, :] - 2 * (x[i : i + 512] @ x.T)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each row: median splits along main directions, then moves that cut fewer graph edges."""
    part, spans = np.zeros(len(x), np.int64), [(np.arange(len(x)), 0, parts)]
    while spans:
        rows, low, n = spans.pop()
        if n == 1 or not len(rows):
            part[rows] = low
            continue
        centred, axis = x[rows] - x[rows].mean(axis=0), np.ones(x.shape[1])
        for _ in range(10):
            axis = centred.T @ (centred @ axis)
            axis /= max(np.linalg.norm(axis), 1e-12)
        order, cut = rows[np.argsort(centred @ axis, kind="stable")], len(rows) * (n // 2) // n
        spans += [(order[:cut], low, n // 2), (order[cut:], low + n // 2, n - n // 2)]
    back: list[list[int]] = [[] for _ in x]
    for i, near in enumerate(graph.tolist()):
        for j in near:
            back[j].append(i)
    near_of = [np.array(near.tolist() + back[i]) for i, near in enumerate(graph)]
    room, size = int(SLACK * len(x) / parts) + 1, np.bincount(part, minlength=parts)
    for _ in range(PASSES):
        moved = 0
        for i, near in enumerate(near_of):
            votes = np.bincount(part[near], minlength=parts)
            votes = np.where(size < room, votes, 0)
            best = int(votes.argmax())
            if best != part[i] and votes[best] > (part[near] == part[i]).sum():
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


def likelihoods(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Unnormalised log probability of each part."""
    h = np.maximum(0, ((x - model["mean"]) / model["scale"]) @ model["w"] + model["b"])
    return h @ model["v"] + model["c"]


def fit(sample: pa.Table, parts: int, k: int) -> bytes:
    """Graph, parts, classifier and the number of parts to probe, from the sampled vectors.

    The classifier learns in which parts a vector's neighbours lie. The number of probes is
    the least with which queries from the sample find their own nearest by brute force.
    """
    x = np.unique(np.array(sample.column("vector").to_pylist(), np.float64), axis=0)
    mean, scale = x.mean(axis=0), x.std() or 1.0
    p = {"mean": mean, "scale": np.array(scale), "w": np.zeros((x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "v": np.zeros((HIDDEN, parts)), "c": np.zeros(parts)}
    probes = 1
    if parts > 1 and len(x) > 2 * GRAPH:
        graph = sample_neighbours(x, GRAPH)
        part = balanced_parts(x, graph, parts)
        target = np.zeros((len(x), parts))
        np.add.at(target, (np.repeat(np.arange(len(x)), GRAPH), part[graph].ravel()), 0.8 / GRAPH)
        target[np.arange(len(x)), part] += 0.2
        random = np.random.default_rng(5)
        p["w"], p["v"] = random.normal(0, x.shape[1] ** -0.5, p["w"].shape), random.normal(0, HIDDEN**-0.5, p["v"].shape)
        first, second = ({q: np.zeros_like(p[q]) for q in "wbvc"} for _ in range(2))
        scaled, done, total = (x - mean) / scale, 0, EPOCHS * -(-len(x) // BATCH)
        for _ in range(EPOCHS):
            order = random.permutation(len(x))
            for i in range(0, len(x), BATCH):
                s, t = scaled[order[i : i + BATCH]], target[order[i : i + BATCH]]
                h = np.maximum(0, s @ p["w"] + p["b"])
                e = h @ p["v"] + p["c"]
                e = np.exp(e - e.max(axis=1, keepdims=True))
                g = (e / e.sum(axis=1, keepdims=True) - t) / len(s)
                back = (g @ p["v"].T) * (h > 0)
                done += 1
                for q, d in (("w", s.T @ back), ("b", back.sum(axis=0)), ("v", h.T @ g), ("c", g.sum(axis=0))):
                    first[q], second[q] = 0.9 * first[q] + 0.1 * d, 0.999 * second[q] + 0.001 * d * d
                    p[q] = p[q] - RATE * (1 - done / (total + 1)) * first[q] / (1 - 0.9**done) / (np.sqrt(second[q] / (1 - 0.999**done)) + 1e-8)
        ranked = np.argsort(-likelihoods(p, x), axis=1)
        near = sample_neighbours(x, min(k, len(x) - 1))
        place = np.argsort(ranked, axis=1)  # rank of every part for every row
        needed = place[np.repeat(np.arange(len(x)), near.shape[1]), ranked[near.ravel(), 0]] + 1
        probes = int(np.searchsorted(np.cumsum(np.bincount(needed, minlength=parts + 1)) / len(needed), AIM))
        probes = min(parts, max(1, probes))
    out = io.BytesIO()
    np.savez(out, probes=np.array(probes), **p)
    return out.getvalue()


def _loaded(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as held:
        return dict(held)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Router:
    """Which parts vectors lie in and queries look into: one network, or one over others.

    Leaves are numbered by part and place in it. A query looks into the parts that its network
    ranks first, as many as the fit found to be needed, and in each into as many of its inner ones.
    """

    def __init__(self, top: bytes, inner: dict[int, bytes]):
        self.top, self.inner = _loaded(top), {p: _loaded(m) for p, m in inner.items()}

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        part = likelihoods(self.top, x).argmax(axis=1)
        leaf = part * INNER_PARTS
        for p, model in self.inner.items():
            rows = np.flatnonzero(part == p)
            if len(rows):
                leaf[rows] += likelihoods(model, x[rows]).argmax(axis=1)
        return leaf

    def probed(self, x: np.ndarray, sizes: dict[int, int], least: int) -> list[np.ndarray]:
        """The leaves each query looks into; all that its probes say, and more until they hold ``least`` rows."""
        order = np.argsort(-likelihoods(self.top, x), axis=1, kind="stable")
        ranked = {p: np.argsort(-likelihoods(m, x), axis=1, kind="stable") for p, m in self.inner.items()}
        out = []
        for i, parts in enumerate(order):
            chosen: list[int] = []
            seen = 0
            for rank, p in enumerate(parts.tolist()):
                if rank >= int(self.top["probes"]) and seen >= least:
                    break
                inner = ranked[p][i].tolist() if p in ranked else [0]
                needed = int(self.inner[p]["probes"]) if p in ranked else 1
                for place, c in enumerate(inner):
                    if place >= needed and seen >= least:
                        break
                    leaf = p * INNER_PARTS + c
                    if size := sizes.get(leaf, 0):
                        chosen.append(leaf)
                        seen += size
            out.append(np.array(chosen, np.int64))
        return out


def _routed(router: Callable[[], Router]) -> Callable:
    """Every row with its leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = router()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.leaves(_matrix(batch.column("vector"))), pa.int32())], ["id", "vector", "leaf"])

    return run


def _probing(router: Callable[[], Router], sizes: dict[int, int], slices: dict[int, int], least: int) -> Callable:
    """Every query once per block of the leaves it looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = router()
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                asked = batch.slice(i, AT_ONCE)
                for row, leaves in enumerate(held.probed(_matrix(asked.column("vector")), sizes, least)):
                    n = np.array([slices[leaf] for leaf in leaves.tolist()], np.int64)
                    leaf = np.repeat(leaves, n)
                    place = np.arange(len(leaf)) - np.repeat(np.cumsum(n) - n, n)
                    for j in range(0, len(leaf), SENT):
                        taken = asked.take(pa.array(np.full(len(leaf[j : j + SENT]), row)))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaf[j : j + SENT], pa.int32()), pa.array(place[j : j + SENT], pa.int32())], ["id", "vector", "leaf", "slice"])

    return run


def nearest_in_block(ids: np.ndarray, x: np.ndarray, asked: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """Each query's k nearest rows of one block, in double precision, ties to smaller ids.

    A matrix product gives all distances but for rounding; what may be among the k nearest is then
    measured exactly.
    """
    norms = (x * x).sum(axis=1)
    for i in range(0, asked.num_rows, AT_ONCE):
        piece = asked.slice(i, AT_ONCE)
        q, names = _matrix(piece.column("vector")), piece.column("id").to_pylist()
        about = (q * q).sum(axis=1)[:, None] + norms - 2 * (q @ x.T)
        out: list[tuple] = []
        for name, v, d in zip(names, q, about):
            d[ids == name] = np.inf
            kept = min(k, len(d) - int((ids == name).sum()))
            if kept:
                limit = np.partition(d, kept - 1)[kept - 1] + 1e-9 * (float(v @ v) + norms.max() + 1)
                near = np.flatnonzero(d <= limit)
                exact = np.sqrt(((x[near] - v) ** 2).sum(axis=1))
                best = np.lexsort((ids[near], exact))[:kept]
                out += [(name, int(ids[near[b]]), float(exact[b])) for b in best]
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) rows that take part: an id, finite components, not all zero, the usual length."""
    rows = pick(vectors, id=id_col, vector=vector_col).select(F.col("id").cast("long").alias("id"), "vector")
    rows = rows.where("id is not null and vector is not null and size(vector) > 0")
    rows = rows.where("forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(vector, v -> v <> 0)")
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (usual["n"] if usual else 0))


def inner_models(indexed: DataFrame, sizes: dict[int, int], part_rows: int, k: int) -> dict[int, bytes]:
    """A graph, parts and a network for each part of the first level, from a bounded sample of its own rows.

    Parts are fitted side by side, each in a task; their networks, at most ``TOP_PARTS`` of some
    300 KB, are what comes back.
    """
    own = F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("id"), "id", "vector"))
    sample = indexed.withColumn("_own", own).where(F.col("_own") <= MOST_SAMPLED).select("leaf", "vector")

    def fitted(key: tuple, rows: pa.Table) -> pa.Table:
        leaf = key[0].as_py()
        parts = max(1, min(INNER_PARTS, round(sizes[leaf] / part_rows)))
        return pa.table({"part": pa.array([leaf // INNER_PARTS], pa.int32()), "model": pa.array([fit(rows, parts, k)], pa.binary())})

    return {r["part"]: bytes(r["model"]) for r in sample.groupBy("leaf").applyInArrow(fitted, "part int, model binary").collect()}


def search(vectors: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", part_rows: int = PART_ROWS) -> DataFrame:
    """The k nearest others of every query row: query_id, rank (from 1), vec_id, score.

    ``is_query`` is an SQL condition on ``id``. The graph, its balanced parts and the
    classifier come from at most ``MOST_SAMPLED`` rows (those of smallest hash); every row is
    indexed under its most probable part. From ``ONE_LEVEL`` parts of ``part_rows`` on there are two
    levels: ``TOP_PARTS`` parts, each divided by a graph and a classifier of its own, from as
    large a sample of its own rows. So the sample grows with the parts, of which there are up
    to ``TOP_PARTS * INNER_PARTS`` (for 100 million rows at ``PART_ROWS``; beyond, parts grow). Below
    2 * ``LEAST_ROWS`` rows there is one part, that is, brute force.

    Parts divide into blocks of about ``BLOCK_ROWS`` by a hash of the id, so copies of one vector
    fill many blocks. A query visits every block of the parts it probes; a task holds one block
    and streams at most ``GROUP_QUERIES`` queries or so past it.

    Rows with a null id or vector, a zero vector, null or non-finite components, or another
    length than most vectors take no part. Of query rows that repeat an id the smallest vector
    asks; candidates with the query's id are its own rows and are left out. A query never
    probes so few parts that it misses candidates while fewer than k are found. Vectors of any
    length and further columns, whatever their names, are fine. No rows: no result.
    """
    rows = usable(vectors, id_col, vector_col)
    total = rows.count()
    parts = max(1, round(total / part_rows), min(LEAST_PARTS, total // LEAST_ROWS))
    levels = 1 if parts <= ONE_LEVEL else 2
    sample = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(MOST_SAMPLED).select("vector")
    top = fit_in_task(sample, lambda held: fit(held, parts if levels == 1 else TOP_PARTS, k))
    if top is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = rows.schema["vector"].dataType.simpleString()
    placed = f"id long, vector {kind}, leaf int"

    def counted(held: DataFrame) -> dict[int, int]:
        return {r["leaf"]: r["count"] for r in held.groupBy("leaf").count().collect()}

    inner: dict[int, bytes] = {}
    indexed = materialise(rows.mapInArrow(_routed(lambda: Router(top, {})), placed), "ann-index")
    if levels == 2:
        inner = inner_models(indexed, counted(indexed), part_rows, k)
        indexed = materialise(rows.mapInArrow(_routed(lambda: Router(top, inner)), placed), "ann-index")
    sizes = counted(indexed)
    slices = {leaf: -(-n // BLOCK_ROWS) for leaf, n in sizes.items()}
    asked = indexed.where(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    groups = max(1, -(-asked.count() // GROUP_QUERIES))
    queries = asked.mapInArrow(_probing(lambda: Router(top, inner), sizes, slices, k + 1), f"{placed}, slice int")
    queries = queries.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("asks", F.lit(1))
    # At most as many rows as there can be leaves.
    cut = vectors.sparkSession.createDataFrame(list(slices.items()), "leaf int, slices int")
    held = indexed.join(F.broadcast(cut), "leaf").withColumn("slice", F.pmod(F.xxhash64("id", "vector"), F.col("slices")).cast("int")).drop("slices")
    held = held.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("asks", F.lit(0))
    key = ("leaf", "slice", "grp")
    streamed = held.unionByName(queries).select(*key, "asks", "id", "vector").repartition(*key).sortWithinPartitions(*key, "asks")
    near = streamed.mapInArrow(past_blocks(key, _matrix, lambda ids, x, batch: nearest_in_block(ids, x, batch, k)), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "id % 100 = 0")
