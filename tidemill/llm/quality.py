"""Quality classifier by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, pick, table
from .training import fit_in_task, fold, labelled_sample

#: Bytes of one passage, labelled documents in a fit at most, and the fold held out.
PASSAGE, MOST_LABELLED, FOLDS, HELD = 400, 8000, 4, 2
#: Bytes encoded at a time, and of a run of passages of one text.
CHUNK_BYTES, RUN_BYTES = 1 << 19, 2000 * PASSAGE
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY = 24, 12, 30, 64, 0.005, 1e-4

#: Byte classes; the encoding counts each pair of neighbours' classes.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"|", b"'\"()[]{}<>", b"@#$%&*^~+=_\\/-`", b"\t\r\x0b\x0c")
N = len(CLASSES) + 1
CLASS_OF = np.full(256, N - 1, np.int32)
for _k, _members in enumerate(CLASSES):
    CLASS_OF[list(_members)] = _k
WIDTH = N * N + 3
#: Separators end a word; odd multipliers tell its bytes' places apart.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[list(b" \t\r\n\x0b\x0c")] = True
PLACE = np.random.default_rng(3).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def encode_passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and how many passages each text has (at least one).

    A passage is encoded by the frequencies of neighbouring byte classes, its length, whether
    it is empty, and the share of its words that repeat the word before. Long texts are encoded
    in runs of passages; nothing is compared across the ends of runs.
    """
    runs, of = [], []
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        runs += [raw[at : at + RUN_BYTES] for at in range(0, max(1, len(raw)), RUN_BYTES)]
        of += [i] * (len(runs) - len(of))
    held, some, size = [], [], 0
    for k, raw in enumerate(runs):
        some.append(raw)
        size += len(raw)
        if size >= CHUNK_BYTES or k == len(runs) - 1:
            held.append(encode_runs(some))
            some, size = [], 0
    counts = np.bincount(of, np.concatenate([c for _, c in held]), len(texts)).astype(np.int64)
    return np.concatenate([x for x, _ in held]), counts


def encode_runs(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the passages of each run of bytes, and their number."""
    sizes = np.array([len(r) for r in raw], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    joined = np.frombuffer(b"".join(raw), np.uint8)
    kinds = CLASS_OF[joined]
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(raw)), sizes)
    passage = first[doc] + (np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // PASSAGE
    total = int(counts.sum())
    pair = kinds[:-1] * N + kinds[1:]
    inside = doc[:-1] == doc[1:]
    hits = np.bincount((passage[:-1] * (N * N) + pair)[inside], minlength=total * N * N).reshape(total, N * N)
    length = np.bincount(passage, minlength=total)
    features = np.empty((total, WIDTH), np.float32)
    features[:, : N * N] = np.sqrt(hits / np.maximum(1, length)[:, None])
    features[:, -3] = length / PASSAGE
    features[:, -2] = length == 0
    features[:, -1] = repeated_words(joined, doc, passage, total)
    return features, counts


def repeated_words(joined: np.ndarray, doc: np.ndarray, passage: np.ndarray, total: int) -> np.ndarray:
    """Share of each passage's words that equal the word before in the same text."""
    inside = ~SEPARATORS[joined]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(total)
    at = np.arange(len(joined)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(joined)]))
    hashes = np.add.reduceat(joined * PLACE[at & 63] * inside, starts)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[starts[1:]] == doc[starts[:-1]])
    words = np.bincount(passage[starts], minlength=total)
    return np.bincount(passage[starts], same, total) / np.maximum(1, words)


class Model:
    """Hidden passage representation, gated attention over passages, logistic document score."""

    SHAPES = {"w": (WIDTH, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION), "a": (ATTENTION,), "c": (HIDDEN,), "d": (1,)}

    def __init__(self, weights: dict[str, np.ndarray]):
        self.p = weights

    @classmethod
    def fresh(cls) -> Model:
        random = np.random.default_rng(7)
        return cls({k: random.normal(0, 1 / np.sqrt(shape[0]), shape) if len(shape) > 1 or k in "ac" else np.zeros(shape) for k, shape in cls.SHAPES.items()})

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple:
        p, starts = self.p, np.cumsum(counts) - counts
        h = np.concatenate([np.tanh(x[i : i + 4096] @ p["w"] + p["b"]) for i in range(0, len(x), 4096)])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        weight = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(weight[:, None] * h, starts)
        return 1 / (1 + np.exp(-(z @ p["c"] + p["d"]))), h, t, g, weight, z

    def gradient(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (s, h, t, g, weight, z) = self.p, self.forward(x, counts)
        at = (s - y) / len(y)
        dz = np.repeat(at[:, None] * p["c"], counts, axis=0)
        score = (dz * h).sum(axis=1)
        mean = np.add.reduceat(weight * score, np.cumsum(counts) - counts)
        de = weight * (score - np.repeat(mean, counts))
        dt, dg = de[:, None] * p["a"] * g * (1 - t**2), de[:, None] * p["a"] * t * g * (1 - g)
        dh = (weight[:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - h**2)
        return {"w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ at, "d": np.array([at.sum()])}

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Model:
        with np.load(io.BytesIO(raw)) as held:
            return cls(dict(held))


def fit(sample: pa.Table) -> bytes:
    """Adam over the log loss; rows come as (counts, features, label) and are put in a fixed order."""
    rows = sorted(zip(sample.column("features").to_pylist(), sample.column("label").to_pylist()))
    bags = [np.frombuffer(f, np.float16).reshape(-1, WIDTH) for f, _ in rows]
    y = np.array([label for _, label in rows])
    counts = np.array([len(b) for b in bags])
    model, random = Model.fresh(), np.random.default_rng(11)
    first = {k: np.zeros(s) for k, s in Model.SHAPES.items()}
    second = {k: np.zeros(s) for k, s in Model.SHAPES.items()}
    epochs = max(EPOCHS, min(400, 60_000 // max(1, len(y))))
    done, total = 0, epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = random.permutation(len(y))
        for i in range(0, len(y), BATCH):
            part = order[i : i + BATCH]
            done += 1
            for k, g in model.gradient(np.concatenate([bags[j] for j in part]).astype(np.float64), counts[part], y[part]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9**done) / (np.sqrt(second[k] / (1 - 0.999**done)) + 1e-8)
                model.p[k] -= RATE * (1 - done / (total + 1)) * (move + DECAY * model.p[k])
    return model.save()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", CHUNK_BYTES):
        x, counts = encode_passages(batch.column("text").to_pylist())
        packed = [part.astype(np.float16).tobytes() for part in np.split(x, np.cumsum(counts)[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column("label")], ["features", "label"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> bytes | None:
    """Fit on at most ``most`` labelled documents outside the held-out fold; None if there are none.

    ``docs`` has doc_id and text. Every passage of a sampled document takes part.
    """
    sample = labelled_sample(docs, labels, label, FOLDS, HELD, most)
    return fit_in_task(sample.mapInArrow(_features, "features binary, label double"), fit)


def score(text: str, model: bytes | None) -> Column:
    """Score column of a text column.

    All passages of a text count. Equal texts get equal scores; a null text scores as an
    empty one; without a model every score is 0.5.
    """
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        held, out = Model.load(model), [np.zeros(0)]
        for batch in chunks(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", CHUNK_BYTES):
            x, counts = encode_passages(batch.column("text").to_pylist())
            out.append(held.forward(x, counts)[0].round(9))
        return pa.array(np.concatenate(out), pa.float64())

    return scored(text)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from the ``quality`` label.

    Null ids are never held out and their labels never learned; repeated ids are scored row by
    row. Texts of any length are read whole; further columns, clashing or not, are ignored. No
    documents: no result. No usable labels: every score is 0.5.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = docs.select("doc_id", score("text", train(docs, labels)).alias("score"))
    held = F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
