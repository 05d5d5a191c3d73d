"""Substring deduplication by Rabin-Karp hashes of fixed-length word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, chunks, pick, squeeze, table, text_bytes, unsqueeze

#: Base of the polynomial hash modulo 2**64: odd, so that every power of it has an inverse.
BASE = 0x9E3779B97F4A7C15 | 1
#: Text bytes that one map step hashes together, one window bucket covers, one document block holds.
CHUNK_BYTES, BUCKET_BYTES, BLOCK_BYTES = 8 << 20, 4 << 20, 4 << 20
LEAST_BUCKETS = 256
#: Text bytes whose windows or documents one shuffle partition holds; the number of partitions follows from it.
PARTITION_BYTES = 32 << 20
KNOWN_WORDS = 100_000
#: Spread ids over blocks; the product stays below 2**63.
MIX_MODULUS, MIX_FACTOR = 2147483647, 2654435761

BLOCK_SCHEMA = "bucket long, hashes binary, ids binary, starts binary, known boolean"
MARK_SCHEMA = "block long, ids binary, starts binary"
RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,stop:int>>, kept_text string"


def word_hashes(text: str, memo: Memo) -> np.ndarray:
    words = text.encode().split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def rolling_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every run of ``width`` word hashes, by joining runs of doubled length."""
    def joined(a: np.ndarray, b: np.ndarray, a_len: int, b_len: int) -> np.ndarray:
        n = max(0, len(words) - a_len - b_len + 1)
        return a[:n] * np.uint64(pow(BASE, b_len, 1 << 64)) + b[a_len : a_len + n]

    result, have, power, size = None, 0, words, 1
    while have < width:
        if width & size:
            result, have = (power, size) if result is None else (joined(power, result, size, have), have + size)
        if have < width:
            power, size = joined(power, power, size, size), size * 2
    return result


def window_positions(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end: document index, start in it and place of every window."""
    windows = np.maximum(counts - width + 1, 0)
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), windows)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.int32)
    return doc, start, np.repeat(np.cumsum(counts) - counts, windows) + start


def first_of_equal(hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the earliest window of each hash, and of windows that start later than it."""
    order = np.argsort(hashes)
    same = np.r_[False, np.diff(hashes[order]) == 0, False]
    alone = ~(same[1:] | same[:-1])
    shared = order[~alone]
    shared = shared[np.lexsort((starts[shared], ids[shared], hashes[shared]))]
    h, d, s = hashes[shared], ids[shared], starts[shared]
    new = np.r_[True, h[1:] != h[:-1]][: len(h)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else new
    later = (d > d[head]) | (s > s[head]) & (d == d[head])
    return np.concatenate([order[alone], shared[new]]), shared[later]


def by_block(d: np.ndarray, s: np.ndarray, blocks: int) -> list[tuple[int, bytes, bytes]]:
    """Packed (block, ids, starts) of late windows, a row for each document block."""
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    block = doc_block(d, blocks)
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
    return [(int(block[part[0]]), squeeze(d[part]), squeeze(s[part])) for part in np.split(order, cuts[1:])] if len(d) else []


def _windows(width: int, buckets: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(xxhash.xxh3_64_intdigest, KNOWN_WORDS)
        for batch in chunks(batches, "text", CHUNK_BYTES):
            hashed = [word_hashes(t, memo) for t in batch.column("text").to_pylist()]
            doc, start, place = window_positions(np.array([len(x) for x in hashed]), width)
            if not len(doc):
                continue
            hashes = rolling_hashes(np.concatenate(hashed), width)[place]
            ids = batch.column("doc_id").to_numpy()[doc]
            del hashed, doc, place
            first, later = first_of_equal(hashes, ids, start)
            first.sort()
            later.sort()
            # Windows known to be late need no more comparing: they are spread like their documents and stay packed.
            rows = [(b % buckets, b.to_bytes(8, "little"), d, s, True) for b, d, s in by_block(ids[later], start[later], blocks)]
            bucket = (hashes[first] % np.uint64(buckets)).astype(np.int64)
            order = first[np.argsort(bucket, kind="stable")]
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            for b in np.unique(bucket):
                part = order[ends[b - 1] if b else 0 : ends[b]]
                rows.append((int(b), hashes[part].tobytes(), squeeze(ids[part]), squeeze(start[part]), False))
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()))], ["bucket", "hashes", "ids", "starts", "known"])

    return run


def doc_block(ids: np.ndarray, blocks: int) -> np.ndarray:
    """Block of each document id; the same rule as the SQL expression in ``remove_repeats``."""
    return ((np.mod(ids, MIX_MODULUS) * MIX_FACTOR) >> 20) % blocks


def _late_windows(blocks: int):
    def run(group: pa.Table) -> pa.Table:
        hashes, ids, starts, rows = [], [], [], []
        for h, d, s, known in zip(*(group.column(c).to_pylist() for c in ("hashes", "ids", "starts", "known"))):
            if known:
                rows.append((int.from_bytes(h, "little"), d, s))
            else:
                hashes.append(np.frombuffer(h, np.uint64))
                ids.append(unsqueeze(d, np.int64))
                starts.append(unsqueeze(s, np.int32))
        if hashes:
            d, s = np.concatenate(ids), np.concatenate(starts)
            _, later = first_of_equal(np.concatenate(hashes), d, s)
            rows += by_block(d[later], s[later], blocks)
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["block", "ids", "starts"])

    return run


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals that windows at ``starts`` cover; touching ones merge."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    cut = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + width).tolist()))


def _cleaned(width: int):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        d = np.concatenate([np.zeros(0, np.int64), *(unsqueeze(x, np.int64) for x in marks.column("ids").to_pylist())])
        s = np.concatenate([np.zeros(0, np.int32), *(unsqueeze(x, np.int32) for x in marks.column("starts").to_pylist())])
        order = np.argsort(d, kind="stable")
        d, s = d[order], s[order]
        rows = []
        for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()):
            words = (text or "").encode().split()
            a, b = (0, 0) if doc_id is None else np.searchsorted(d, [doc_id, doc_id + 1])
            spans = [(x, min(y, len(words))) for x, y in intervals(s[a:b], width) if x < len(words)]
            kept, at = [], 0
            for x, y in spans:
                kept += words[at:x]
                at = y
            kept += words[at:]
            rows.append((doc_id, len(words), len(words) - len(kept), [{"start": x, "stop": y} for x, y in spans], b" ".join(kept).decode()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.string())
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "n_words", "n_removed", "removed", "kept_text"])

    return run


def _unmarked(width: int):
    """Rows that no window marks, whatever they hold; a batch at a time."""
    clean, none = _cleaned(width), pa.table({"ids": pa.array([], pa.binary()), "starts": pa.array([], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK_BYTES):
            yield from clean(pa.Table.from_batches([batch]), none).to_batches()

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """Remove words that a window of ``width`` words covers if that window also starts earlier.

    Earlier means a smaller id, or the same id and an earlier start. Every window's Rabin-Karp
    hash is kept once per map step (its earliest place); packed hash blocks meet by bucket,
    where all but the earliest window of a hash are late; late windows return to their
    documents by block and merge into maximal intervals. Windows are equal if their 64-bit
    hashes are: n distinct windows hold about n^2 / 2^65 false pairs, so one is to be expected
    from some 6e9 windows (about 35 GB of text) on.

    Words are runs of bytes other than ASCII white space. Result: doc_id, n_words, n_removed,
    removed (word intervals, stop exclusive), kept_text (kept words joined by one space).

    A null or empty text has no words. A row with a null id keeps all its words and marks no
    other. Rows that repeat an id share their marks, and equal (id, start) places are not
    earlier than each other, so exact repeats of a row get equal results. Texts of any length
    are read whole; further columns, clashing or not, are ignored. No rows: no result.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    size = text_bytes(docs, "text")
    buckets, blocks = max(LEAST_BUCKETS, size // BUCKET_BYTES), max(LEAST_BUCKETS, size // BLOCK_BYTES)
    windows = docs.where("doc_id is not null and text is not null").mapInArrow(_windows(width, buckets, blocks), BLOCK_SCHEMA)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES)
    marks = windows.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_late_windows(blocks), MARK_SCHEMA).repartition(parts, "block")
    place = F.shiftright(F.pmod("doc_id", F.lit(MIX_MODULUS)) * MIX_FACTOR, 20) % blocks
    held = docs.where("doc_id is not null").withColumn("block", place).repartition(parts, "block")
    cleaned = held.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_cleaned(width), RESULT_SCHEMA)
    # Rows without an id need no marks and so no shuffle, however many there are of one text.
    return cleaned.unionByName(docs.where("doc_id is null").mapInArrow(_unmarked(width), RESULT_SCHEMA))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
