"""Sequence packing as a cutting-stock problem solved by column generation."""

from __future__ import annotations

import base64
import json
import os
import re
import warnings
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialise, pick, table
from .training import fit_in_task

END_ID = 1
#: Length classes between 1 and the sequence length; the linear program has a row for each.
CLASSES = 256
#: Tokens that one packing step ranks and packs together, and shortest piece cut to fill a gap.
STEP_TOKENS, LEAST_PIECE = 12_000_000, 64
CHUNK_BYTES = 1 << 20
#: The linear program ends once its value is proven to be within this share of the optimum.
GAP = 0.005
#: Runs of white space from this length on are encoded as the pieces they are: the pattern would backtrack over them.
LONG_RUN = 1 << 16
#: Unicode's White_Space characters, which is what the pattern's ``\\s`` stands for.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of whole texts as little-endian bytes.

    The vocabulary is read as ranks, which give the same ids as its tokenizer. A text that
    spells out special tokens is cut at them, as the tokenizer does.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.run = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")
        self.kind = "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def ordinary(self, text: str) -> list[np.ndarray]:
        """Ids of a text without special tokens.

        White space before a word gives its last character to the word, so a long run is one
        piece up to that character, and nothing before or after it depends on the cut.
        """
        parts, at = [], 0
        for found in self.run.finditer(text) if len(text) >= LONG_RUN else ():
            stop = found.end() if found.end() == len(text) else found.end() - 1
            parts.append(self.fast.encode_to_numpy(text[at : found.start()], disallowed_special=()))
            parts.append(np.array(self.fast._encode_single_piece(text[found.start() : stop])))
            at = stop
        return [*parts, self.fast.encode_to_numpy(text[at:], disallowed_special=())]

    def encode(self, text: str) -> bytes:
        parts = []
        for piece in self.cut.split(text) if self.cut else [text]:
            parts += [np.array([self.special[piece]])] if piece in self.special else self.ordinary(piece)
        return b"".join(x.astype(self.kind).tobytes() for x in (*parts, np.array([END_ID])))


@lru_cache(maxsize=2)
def encoder_for(vocabulary: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(vocabulary)


def _tokens(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary)
        size = np.dtype(encoder.kind).itemsize
        for batch in chunks(batches, "text", CHUNK_BYTES):
            ids = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // size for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([size] * len(ids), pa.int32())], ["doc_id", "n_tokens", "ids", "id_bytes"])

    return run


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, n_tokens, ids, id_bytes): each text's ids and the end id, packed little-endian."""
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(_tokens(vocabulary), "doc_id long, n_tokens long, ids binary, id_bytes int")


def best_patterns(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: for every class the most valuable pattern that holds it.

    ``sizes`` ascend. Returns the patterns' worths and their counts, a row for each class.
    """
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        fit = int(np.searchsorted(sizes, c, side="right"))
        if fit:
            offered = best[c - sizes[:fit]] + values[:fit]
            k = int(offered.argmax())
            if offered[k] > best[c] + 1e-12:
                best[c], taken[c] = offered[k], k
    rest, counts, rows = room - sizes, np.eye(len(sizes)), np.arange(len(sizes))
    worth = values + best[rest]
    while (rest > 0).any():
        k = np.where(rest > 0, taken[np.maximum(rest, 0)], -1)
        counts[rows[k >= 0], k[k >= 0]] += 1
        rest = rest - np.where(k >= 0, sizes[k], 1)
    return worth, counts


def cutting_patterns(demand: dict[int, int], room: int = CLASSES, gap: float = GAP, most_rounds: int = 200) -> list[tuple[dict[int, int], float]]:
    """Patterns (class -> count) and how often to use each, fewest sequences in all.

    The master linear program covers the histogram ``demand`` of length classes; its basis
    starts from single-class patterns. Each round solves it over the columns known so far by
    simplex pivots; then the knapsack program prices new ones against the dual values, the best
    column of every class. Prices divided by the best pattern's worth are feasible duals, so
    what the demand is worth at them bounds the optimum from below: rounds end once the value
    is at most 1 + ``gap`` times the best bound. Should ``most_rounds`` not reach that, a
    warning names the gap; the patterns still cover the demand.
    """
    sizes = np.array(sorted(k for k, v in demand.items() if v > 0))
    if not len(sizes):
        return []
    wanted = np.array([float(demand[k]) for k in sizes])
    wanted *= 1 + 1e-7 * np.random.default_rng(2).random(len(wanted))  # else ties stall the pivots
    basis = np.diag((room // sizes).astype(float))
    pool, bound = best_patterns(sizes / room, sizes, room)[1], float((sizes * wanted).sum() / room)
    inverse, pivots = np.linalg.inv(basis), 0
    level = inverse @ wanted
    for _ in range(most_rounds):
        while True:
            worth = pool @ inverse.sum(axis=0)
            enter = int(worth.argmax())
            if worth[enter] <= 1 + 1e-9 or level.sum() <= (1 + gap) * bound:
                break
            step = inverse @ pool[enter]
            ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
            out, pivots = int(ratio.argmin()), pivots + 1
            basis[:, out] = pool[enter]
            if pivots % 256 == 0:
                inverse = np.linalg.inv(basis)
            else:
                inverse[out] /= step[out]
                step[out] = 0
                inverse -= step[:, None] * inverse[out]
            level = np.maximum(inverse @ wanted, 0)
        prices = np.maximum(0, inverse.sum(axis=0))
        worth, columns = best_patterns(prices, sizes, room)
        bound = max(bound, float(prices @ wanted / worth.max()))
        if level.sum() <= (1 + gap) * bound or worth.max() <= 1 + 1e-9:
            break
        pool = np.unique(np.vstack([pool, columns[worth > 1 + 1e-9]]), axis=0)
    if level.sum() > (1 + gap) * bound + 1e-6:
        warnings.warn(f"the packing program ended {level.sum() / bound - 1:.2%} from its proven bound", stacklevel=2)
    return [({int(s): int(n) for s, n in zip(sizes, basis[:, j]) if n}, float(level[j])) for j in np.argsort(-level)]


def solve_histogram(counted: pa.Table) -> bytes:
    """Rows and patterns of a histogram (class, count), as JSON."""
    demand = dict(zip(counted.column("class").to_pylist(), counted.column("count").to_pylist()))
    patterns = cutting_patterns({c: n for c, n in demand.items() if c})
    return json.dumps([sum(demand.values()), [(list(p.items()), level) for p, level in patterns]]).encode()


def pack_step(lengths: list[int], ranks: list[tuple], patterns: list[tuple[dict[int, int], float]], share: float, room: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one step's documents.

    Whole sequences are cut off first; what remains of each document is ranked within its
    length class (longest first) and handed to rounded-down patterns, then to any pattern
    still filled by what is left. Documents left over are cut to fill gaps and new sequences.
    """
    unit = room // CLASSES
    pieces, sequence = [], 0
    classes: dict[int, list[int]] = {}
    for d in sorted(range(len(lengths)), key=lambda d: (-(lengths[d] % room), *ranks[d])):
        for k in range(lengths[d] // room):
            pieces.append((d, k * room, room, sequence, 0))
            sequence += 1
        if lengths[d] % room:
            classes.setdefault(-(-(lengths[d] % room) // unit), []).append(d)
    for held in classes.values():
        held.reverse()  # pop() gives the longest
    gaps = []
    for limit in (lambda level: int(level * share), lambda level: 1 << 60):
        for pattern, level in patterns:
            for _ in range(min(limit(level), *(len(classes.get(c, ())) // n for c, n in pattern.items()))):
                at = 0
                for c, n in pattern.items():
                    for d in (classes[c].pop() for _ in range(n)):
                        rest = lengths[d] % room
                        pieces.append((d, lengths[d] - rest, rest, sequence, at))
                        at += rest
                if room - at >= LEAST_PIECE:
                    gaps.append((sequence, at))
                sequence += 1
    gaps.reverse()
    for c in sorted(classes, reverse=True):
        for d in reversed(classes[c]):
            start = lengths[d] // room * room
            while start < lengths[d]:
                if not gaps:
                    gaps.append((sequence, 0))
                    sequence += 1
                to, at = gaps.pop()
                length = min(room - at, lengths[d] - start)
                pieces.append((d, start, length, to, at))
                start += length
                if at + length < room:
                    gaps.append((to, at + length))
    return pieces


def _packed(patterns: list, total: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, tokens = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal base
            ranks = [(doc_id is None, doc_id or 0, i) for i, (doc_id, *_) in enumerate(held)]
            pieces = pack_step([n for _, n, _, _ in held], ranks, patterns, len(held) / total, room)
            for i in range(0, len(pieces), 5000):
                rows = []
                for d, start, length, sequence, at in pieces[i : i + 5000]:
                    doc_id, n, ids, size = held[d]
                    wide = np.frombuffer(ids, f"<u{size}", length, start * size).astype("<u4").tobytes()
                    rows.append((doc_id, start, length, wide, n, base + sequence, at))
                kinds = [pa.binary() if name == "ids" else pa.int64() for name in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
            base += max(p[3] for p in pieces) + 1

        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids", "id_bytes"))):
                held.append(row)
                tokens += row[1]
                if tokens >= STEP_TOKENS:
                    yield from packed()
                    held, tokens = [], 0
        if held:
            yield from packed()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", room: int = 2048, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Pack all documents into sequences of at most ``room`` tokens.

    Texts are encoded once and written to the shared folder. One task solves the linear program
    over the histogram of remainder lengths (at most ``CLASSES`` + 1 counts); its patterns go to
    the tasks, each packing bounded steps of its own documents, so no token is shuffled. Result, one row per piece: doc_id, start, length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Rows with a null id, or that repeat an id, are
    packed like others, each row's pieces covering its own text. A text of any length or run of
    white space is encoded whole and cut into full sequences. Further columns, clashing or not,
    are ignored. No rows: no result.
    """
    if room % CLASSES:
        raise ValueError(f"the sequence length must be a multiple of {CLASSES}")
    tokens = materialise(tokenize(docs, id_col, text_col, vocabulary), "tokens")
    rest = F.ceil(F.col("n_tokens") % room / (room // CLASSES)).cast("int")
    solved = fit_in_task(tokens.groupBy(rest.alias("class")).count(), solve_histogram)
    total, found = json.loads(solved or b"[1, []]")
    patterns = [(dict(map(tuple, p)), level) for p, level in found]
    return tokens.mapInArrow(_packed(patterns, total, room), PIECE_SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
