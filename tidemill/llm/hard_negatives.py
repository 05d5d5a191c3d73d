"""Hard negatives by a block matrix multiply over row shards and dimension chunks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, squeeze, table, unsqueeze
from .vectors import best_of, matrix, products, whole_vectors

#: Hash parts of the labels, rows and anchors of a tile, dimensions of a chunk at least, chunks at most.
PARTS, TILE_ROWS, TILE_ANCHORS, CHUNK, MOST_CHUNKS = 64, 4096, 256, 32, 8

TILE = "part int, shard int, block int, chunk int, cells binary, anchors binary, wanted binary, windows binary, ids binary, labels binary"
SIDE = ("part", "shard", "block", "chunk")


def _partial(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """The partial scores of one tile: some anchors by some rows over one chunk of the dimensions.

    The first chunk's tile brings along which anchors and rows these are.
    """
    anchors, rows = anchors.sort_by("row"), rows.sort_by("of_row")
    out = []
    if len(anchors) and len(rows):
        part, shard, block, chunk = (k.as_py() for k in key)
        tile = products(matrix(anchors.column("vector")), matrix(rows.column("of_vector")))
        sides = [anchors.column("id"), anchors.column("label"), anchors.column("windows"), rows.column("of_id"), rows.column("of_label")]
        held = [squeeze((matrix(c).ravel() if i == 2 else c.to_numpy()).astype(np.int64)) for i, c in enumerate(sides)] if chunk == 0 else [None] * 5
        out = [(part, shard, block, chunk, squeeze(tile.ravel()), *held)]
    kinds = [pa.int32()] * 4 + [pa.binary()] * 6
    return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], [c.split()[0] for c in TILE.split(", ")])


def _summed(tiles: pa.Table) -> tuple[np.ndarray, ...]:
    """Whole scores of a tile from its partial ones, with the ids, labels and windows of its sides."""
    chunks = tiles.column("chunk").to_pylist()
    at = chunks.index(0)
    anchors, wanted, windows, ids, labels = (unsqueeze(tiles.column(c)[at].as_py(), np.int64) for c in ("anchors", "wanted", "windows", "ids", "labels"))
    scores = np.zeros(len(anchors) * len(ids), np.int64)
    for i in range(len(chunks)):
        scores += unsqueeze(tiles.column("cells")[i].as_py(), np.int64)
    return scores.reshape(len(anchors), -1), anchors, wanted, windows.reshape(len(anchors), -1), ids, labels


def _reduced(k: int, same: bool, low: int, high: int) -> Callable[[pa.Table], pa.Table]:
    """The k best rows of a tile for each anchor (``same`` label) or each of its windows (other labels).

    Windows are given by positive scores p: a row counts if low * p <= 100 * score <= high * p.
    """

    def run(tiles: pa.Table) -> pa.Table:
        scores, anchors, wanted, windows, ids, labels = _summed(tiles)
        out = []
        # Percentages without leaving 64 bits: p * high / 100 from p / 100 and p % 100.
        share = lambda p, n: p // 100 * n + p % 100 * n // 100
        for a, label, positives, s in zip(anchors.tolist(), wanted.tolist(), windows, scores):
            apart = (ids != a) if same else (labels != label)
            spans = [(None, None)] if same else [(-share(-int(p), low), share(int(p), high)) for p in positives]
            kept = np.flatnonzero(apart & (labels == label)) if same else np.flatnonzero(apart)
            for place, (least, most) in enumerate(spans):
                found = kept if same else kept[(s[kept] >= least) & (s[kept] <= most)]
                found = found[best_of(s[found], ids[found], k)]
                out += [(a, place, i, v) for i, v in zip(ids[found].tolist(), s[found].tolist())]
        return pa.table([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], ["anchor_id", "place", "other_id", "score"])

    return run


def _of_part(values: dict[int, int]) -> Column:
    """A number for each of the at most ``PARTS`` parts; zero elsewhere."""
    return F.coalesce(F.create_map(*[F.lit(v) for kv in (values or {-1: 0}).items() for v in kv])[F.col("part")], F.lit(0))


def _multiplied(anchors: DataFrame, rows: DataFrame, chunks: int, width: int, reduce: Callable) -> DataFrame:
    """Tiles of anchors by rows, both keyed by (part, shard, block), as partial products, their sums and what ``reduce`` keeps."""
    cut = lambda df: df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("vector", F.slice("vector", F.col("chunk") * width + 1, F.lit(width)))
    # Both sides come from one table: columns of one are named anew, so that none is taken for the other's.
    ours = cut(anchors).select(*SIDE, "row", "id", "label", "windows", "vector")
    theirs = cut(rows).select(*[F.col(c).alias(f"of_{c}") for c in (*SIDE, "row", "id", "label", "vector")])
    partial = ours.groupBy(*SIDE).cogroup(theirs.groupBy(*[f"of_{c}" for c in SIDE])).applyInArrow(_partial, TILE)
    return partial.groupBy("part", "shard", "block").applyInArrow(reduce, "anchor_id long, place long, other_id long, score long")


def mine(vectors: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``is_anchor`` is an SQL condition on ``id``. An anchor's positives are its ``positives`` best
    other rows of its label by exact inner product of ``floor(scale * component)``; for each, the
    ``negatives`` best rows of other labels with low * p <= 100 * n <= high * p for the scores p
    and n. Equal scores are ranked by id.

    Rows are sharded by label part and id, anchors into blocks, dimensions into chunks. A task
    multiplies one block by one shard over one chunk; partial tiles meet by (block, shard), are
    added as int64 and reduced to the best of each window before anything else is shuffled.
    The first pass multiplies within labels only and the second elsewhere only, so no tile is kept
    or made twice unless labels share a part. Work is anchors times rows, in tiles of
    ``TILE_ANCHORS`` by ``TILE_ROWS`` whatever label is frequent.

    Rows with a null id, label or vector, a null or non-finite component or an unusual length
    take no part. Of anchor rows that repeat an id the smallest (label, vector) asks, and rows
    with its id are no positives of it; other repeated rows count each. Vectors of any length
    and further columns, whatever their names, are fine. Anchors without positives have no
    rows, nor has an empty table. A score beyond 64 bits fails the job.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, scale, id_col, vector_col, label=label_col).where("label is not null")
    marked = whole.select(F.col("label").cast("long").alias("label"), "id", "vector", F.monotonically_increasing_id().alias("row"))
    held = materialise(marked.withColumn("part", F.pmod(F.xxhash64("label"), F.lit(PARTS)).cast("int")), "labelled-vectors")
    asking = F.expr(is_anchor)
    parts = held.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first"), F.max("label").alias("last"), F.count_if(asking).alias("anchors"), F.max(F.size("vector")).alias("width")).collect()
    if not any(r["anchors"] for r in parts):
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = max(r["width"] for r in parts)
    chunks = max(1, min(MOST_CHUNKS, -(-width // CHUNK)))
    width = max(1, -(-width // chunks))
    shards = {r["part"]: -(-r["n"] // TILE_ROWS) for r in parts}
    sharded = held.withColumn("shard", F.pmod(F.xxhash64("id", "row"), _of_part(shards)).cast("int"))
    anchors = held.where(asking).groupBy("id").agg(F.min(F.struct("label", "vector", "part", "row")).alias("a")).select("id", "a.*")
    spread = lambda df, n: df.withColumn("block", F.pmod(F.xxhash64("id"), n).cast("int"))
    everywhere = lambda df: df.withColumn("shard", F.explode(F.sequence(F.lit(0), (_of_part(shards) - 1).cast("int"))))
    every_block = lambda df, n: df.withColumn("block", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))

    # Within labels: anchors meet the shards of their own part.
    blocks = {r["part"]: -(-r["anchors"] // TILE_ANCHORS) for r in parts if r["anchors"]}
    own = spread(everywhere(anchors), _of_part(blocks)).withColumn("windows", F.array(F.lit(0).cast("long")))
    others = every_block(sharded.where(_of_part(blocks) > 0), _of_part(blocks))
    near = _multiplied(own, others, chunks, width, _reduced(positives, True, low, high))
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    ranked = near.withColumn("at", F.row_number().over(first) - 1).where(F.col("at") < positives)
    pairs = materialise(ranked.select("anchor_id", F.col("at").cast("long").alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # Elsewhere: an anchor with its windows meets all parts but one that holds its label alone.
    scores = pairs.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    windows = F.transform("p", lambda p: p["positive_score"])
    # Windows of an anchor with fewer positives repeat its last; what they find is dropped by the join below.
    filled = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.element_at(windows, F.least(i, F.size("p"))))
    asked = anchors.drop("part").join(scores.select(F.col("anchor_id").alias("id"), filled.alias("windows")), "id")
    alone = {r["part"]: 1 for r in parts if r["first"] == r["last"]}
    asked = asked.withColumn("part", F.explode(F.array(*[F.lit(r["part"]) for r in parts])))
    asked = asked.where((F.col("part") != F.pmod(F.xxhash64("label"), F.lit(PARTS))) | (_of_part(alone) == 0))
    n = F.lit(-(-sum(r["anchors"] for r in parts) // TILE_ANCHORS))
    far = _multiplied(spread(everywhere(asked), n), every_block(sharded, n), chunks, width, _reduced(negatives, False, low, high))
    best = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "other_id")
    kept = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return kept.join(pairs, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", shifted), "id % 100 = 0")
