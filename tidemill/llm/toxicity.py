"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialise, pick, table
from .training import fit_in_task, fold, labelled_sample
from .words import STEMS, Words, hash_of, known, slices

#: Labelled documents whose words are mined at most, and the fold held out.
MOST_LABELLED, FOLDS, HELD = 12_000, 3, 1
CHUNK_BYTES = 4 << 20
#: Lexicon words must be toxic this often, in so many different texts; size of a lexicon and of the classifier.
PRECISION, LEAST_TEXTS, MOST_WORDS, MOST_FEATURES = 0.8, 3, 400, 4000
MIXES = np.random.default_rng(5).integers(0, 1 << 63, 6, np.uint64) * np.uint64(2) + np.uint64(1)
ROUNDS, L1, L2 = 300, 3e-5, 1e-5

# English insults, and second persons of English, German, French and Spanish.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "scum", "trash", "garbage", "loser", "losers", "pathetic", "worthless", "disgusting", "clown", "fool", "vermin", "filth", "imbecile", "crap")
PERSONS = ("you", "your", "you're", "yours", "du", "dich", "dir", "dein", "deine", "tu", "te", "toi", "ton", "vous", "usted", "ustedes", "eres")

#: Voters, in the order of their bits. Lexicons: insults and their stems, words mined from
#: either half of the labelled texts, stems of three lengths mined from all of them.
#: Obfuscation: an insult spelled with digits, letters replaced by marks. Repetition: several
#: suspicious words, many of them among the text's words, two close together. Address: a second person
#: beside a suspicious word. Punctuation: runs of exclamation marks.
VOTERS = ("insults", "insult_stems", "words_even", "words_odd", "stems_4", "stems_5", "stems_6", "digits", "marks", "several", "dense", "close", "addressed", "exclaims")
#: So many of them are lexicons; the label model starts from their votes.
LEXICONS = 7
_DIGITS = bytes.maketrans(b"0134578", b"oieastb")
_MARKS = re.compile(r"\*(?<=[A-Za-z]\*)\*{0,8}[A-Za-z]")


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: hashes of its distinct words and of their stems, each as often as words have it."""
    for batch in chunks(batches, "text", CHUNK_BYTES):
        texts = batch.column("text").to_pylist()
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for numbers, parts in slices(texts):
            held = Words(numbers, parts)
            doc, word = held.pairs()
            cuts = np.searchsorted(doc, np.arange(numbers[0], numbers[-1] + 2))
            for i, a, b in zip(range(numbers[0], numbers[-1] + 1), cuts[:-1], cuts[1:]):
                found[i].append(held.features[word[a:b]])
        rows = []
        for text, parts in zip(texts, found):
            # A word met in several slices of a long text counts once.
            own = np.unique(np.concatenate(parts), axis=0) if len(parts) > 1 else parts[0]
            values = np.sort(own.ravel())
            rows.append((xxhash.xxh3_64_intdigest(text or "") >> 1, values[np.searchsorted(values, 1) :].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), batch.column("label")], ["text_hash", "features", "label"])


def _distinct_texts(sample: pa.Table) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """The sample in a fixed order, near copies with the same label left out.

    Else words that only stand in many copies of one text would look like toxic words. Texts
    count as near copies if the three smallest-hash words of one of two triples are the same.
    """
    seen, kept = set(), []
    for h, f, label in sorted(zip(*(sample.column(c).to_pylist() for c in ("text_hash", "features", "label")))):
        values = np.frombuffer(f, np.uint64)
        least = [int((values * m).min()) for m in MIXES] if len(values) else [h] * 6
        keys = {(label >= 0.5, *least[:3]), (label >= 0.5, *least[3:])}
        if not keys & seen:
            kept.append((h, values, label))
        seen |= keys
    return [r[0] for r in kept], [r[1] for r in kept], np.array([r[2] for r in kept])


def among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Indexes in the sorted ``values`` of those of ``found`` that are there."""
    if not len(values):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(values, found), len(values) - 1)
    return at[values[at] == found]


def mine(sample: pa.Table) -> bytes:
    """Lexicon hashes of the mined voters, from different labelled texts, and the share of toxic ones.

    The lexicons of words come from half of the texts each, that of stems from all.
    """
    hashes, features, labels = _distinct_texts(sample)
    even = np.array([h % 2 == 0 for h in hashes], bool)

    def lexicon(chosen: np.ndarray) -> np.ndarray:
        toxic = [np.unique(features[i]) for i in np.flatnonzero(chosen & (labels >= 0.5))]
        if not toxic:
            return np.zeros(0, np.uint64)
        values, count = np.unique(np.concatenate(toxic), return_counts=True)
        values, count = values[count >= LEAST_TEXTS], count[count >= LEAST_TEXTS]
        total = np.zeros(len(values), np.int64)
        for i in np.flatnonzero(chosen):
            total[np.unique(among(values, features[i]))] += 1
        sure = (count + 0.5) / (total + 1) >= PRECISION
        order = np.lexsort((values[sure], -count[sure]))[:MOST_WORDS]
        return values[sure][order]

    found = [np.sort(lexicon(chosen)).tolist() for chosen in (even, ~even, np.ones(len(hashes), bool))]
    return json.dumps([float(np.mean(labels >= 0.5)) if len(labels) else 0.0, *found]).encode()


class Voters:
    """Votes of many texts: a bit for each voter that calls the text toxic; others do not."""

    def __init__(self, mined: bytes):
        self.prior, *found = json.loads(mined)
        self.even, self.odd, self.both = (np.array(x, np.uint64) for x in found)
        rows = [hash_of(w) for w in INSULTS]
        self.insults = np.sort([r[0] for r in rows])
        self.insult_stems = np.sort([r[2] for r in rows if r[2]])
        self.persons = np.sort([hash_of(w)[0] for w in PERSONS])

    def of_words(self, held: Words) -> np.ndarray:
        """The word voters' bits of each distinct word."""
        f = held.features
        columns = [known(self.insults, f[:, 0]), known(self.insult_stems, f[:, 2]), known(self.even, f[:, 0]), known(self.odd, f[:, 0])]
        columns += [known(self.both, f[:, k]) for k in range(1, 1 + len(STEMS))]
        spelled, mixed = np.zeros(len(f), bool), np.flatnonzero((held.digits > 0) & (held.digits < held.size[held.first]))
        if len(mixed):
            read = Words([0], [b" ".join(held.spelled(w).translate(_DIGITS) for w in mixed)])
            spelled[mixed] = known(self.insults, read.features[:, 0])[read.word]
        return sum(c.astype(np.int64) << k for k, c in enumerate([*columns, spelled]))

    def vote(self, texts: list[str | None]) -> np.ndarray:
        votes, hits, words = (np.zeros(len(texts), np.int64) for _ in range(3))
        bit = {name: np.int64(1 << k) for k, name in enumerate(VOTERS)}
        for numbers, parts in slices(texts):
            held = Words(numbers, parts)
            bits = self.of_words(held)
            doc, word = held.pairs()
            some = bits[word] != 0
            np.bitwise_or.at(votes, doc[some], bits[word[some]])
            hits += np.bincount(doc[some], minlength=len(texts))
            words += np.bincount(doc, minlength=len(texts))
            at = np.flatnonzero(bits[held.word])
            near = (np.diff(at) <= 8) & (np.diff(held.doc[at]) == 0)
            votes[held.doc[at[1:][near]]] |= bit["close"]
            person = np.r_[known(self.persons, held.features[:, 0])[held.word], False]
            for step in (-2, -1, 1, 2):
                other = at + step
                good = (other >= 0) & (other < len(held.word))
                good[good] &= person[other[good]] & (held.doc[other[good]] == held.doc[at[good]])
                votes[held.doc[at[good]]] |= bit["addressed"]
        votes |= np.where(hits > 1, bit["several"], 0) | np.where((hits > 0) & (hits >= 0.02 * words), bit["dense"], 0)
        votes |= np.array([bit["marks"] if t and "*" in t and _MARKS.search(t) else 0 for t in texts], np.int64)
        votes |= np.array([bit["exclaims"] if t and "!!" in t else 0 for t in texts], np.int64)
        return votes


@lru_cache(maxsize=1)
def voters_of(mined: bytes) -> Voters:
    """One set of voters for each Python worker."""
    return Voters(mined)


def dependency_tree(joint: np.ndarray, share: np.ndarray) -> list[tuple[int, int]]:
    """(voter, the voter it depends on or -1) in an order that has parents first.

    ``joint[y, i, j]`` is how often both vote toxic under class y (on the diagonal: how often
    one does). The tree has the greatest sum of mutual information given the class.
    """
    m = joint.shape[1]
    one = np.stack([np.diag(j) for j in joint])
    info = np.zeros((m, m))
    for y in range(2):
        p, q = one[y][:, None], one[y][None, :]
        for both, a, b in ((joint[y], p, q), (p - joint[y], p, 1 - q), (q - joint[y], 1 - p, q), (1 - p - q + joint[y], 1 - p, 1 - q)):
            both = np.maximum(both, 1e-12)
            info += share[y] * both * np.log(both / np.maximum(a * b, 1e-12))
    order, best, parent = [(0, -1)], info[0].copy(), np.zeros(m, int)
    left = set(range(1, m))
    while left:
        k = max(left, key=lambda j: (best[j], -j))
        left.remove(k)
        order.append((k, int(parent[k])))
        for j in left:
            if info[k, j] > best[j]:
                best[j], parent[j] = info[k, j], k
    return order


def label_model(votes: np.ndarray, weight: np.ndarray, prior: float, leaders: int | None = None, rounds: int = 200) -> np.ndarray:
    """Posterior of toxic for every row of ``votes`` (0 or 1 a voter), by expectation maximisation.

    The model of either class is a tree over the voters: how often a voter calls a text toxic
    depends on the class and on what one other voter says. A round estimates all pairs'
    frequencies under the present posteriors, and with them both the accuracies and the tree of
    correlations that fits best; so voters that repeat each other do not count twice. A voter
    that would call clean texts toxic more often than toxic ones brings no evidence.

    No label takes part. ``prior``, the share of toxic texts, says how many texts start as
    toxic: those for which the first ``leaders`` voters (default: all) cast the rarest votes.
    ``weight`` counts the texts of each row.
    """
    n, m = votes.shape
    v, weight = votes.astype(float), weight.astype(float)
    prior = min(0.5, max(0.001, prior))
    leading = v[:, :leaders]
    rarity = (leading * -np.log(((weight[:, None] * leading).sum(axis=0) + 0.5) / (weight.sum() + 1))).sum(axis=1)
    order = np.argsort(-rarity, kind="stable")
    before = np.cumsum(weight[order]) - weight[order]
    posterior = np.full(n, 0.01)
    posterior[order[(before < prior * weight.sum()) & (rarity[order] > 0)]] = 0.95
    for _ in range(rounds):
        total = np.stack([weight * (1 - posterior), weight * posterior])
        size = total.sum(axis=1)
        both = np.einsum("yp,pi,pj->yij", total, v, v)
        seen = np.einsum("yp,pi->yi", total, v)
        joint = (both + 0.25) / (size[:, None, None] + 1)
        joint[:, np.arange(m), np.arange(m)] = (seen + 0.5) / (size[:, None] + 1)
        evidence = np.full(n, math.log(prior / (1 - prior)))
        for k, parent in dependency_tree(joint, size / max(size.sum(), 1e-9)):
            if joint[1, k, k] <= joint[0, k, k]:
                continue
            rate = np.empty((2, 2))  # by class and what the parent says
            for y in range(2):
                if parent < 0:
                    rate[y] = joint[y, k, k]
                else:
                    with_, all_ = both[y, k, parent], seen[y, parent]
                    # A rare combination leans on the voter's own rate.
                    rate[y, 1] = (with_ + 2 * joint[y, k, k]) / (all_ + 2)
                    rate[y, 0] = (seen[y, k] - with_ + 2 * joint[y, k, k]) / (size[y] - all_ + 2)
            rate = np.clip(rate, 1e-6, 1 - 1e-6)
            said = votes[:, parent] if parent >= 0 else np.zeros(n, int)
            evidence += np.where(votes[:, k] == 1, np.log(rate[1] / rate[0])[said], np.log((1 - rate[1]) / (1 - rate[0]))[said])
        new = 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))
        done = np.abs(new - posterior).max(initial=0) < 1e-9
        posterior = new
        if done:
            break
    return posterior


def fit_label_model(counted: pa.Table, prior: float) -> bytes:
    """Posterior of each pattern of votes, as JSON, from the patterns' counts over all texts."""
    rows = sorted(zip(counted.column("votes").to_pylist(), counted.column("count").to_pylist()))
    bits = np.array([b for b, _ in rows], np.int64)
    votes = (bits[:, None] >> np.arange(len(VOTERS)) & 1).astype(int)
    return json.dumps(dict(zip(bits.tolist(), label_model(votes, np.array([n for _, n in rows]), prior, LEXICONS).tolist()))).encode()


def train_linear(sample: pa.Table) -> bytes:
    """Sparse logistic regression on posterior labels by accelerated proximal gradient steps.

    A feature's value is in how many of a text's distinct words it stands. Candidates are those
    whose texts are mostly toxic by posterior; the L1 term keeps few of them.
    """
    _, features, y = _distinct_texts(sample)
    likely = [np.unique(f) for f, label in zip(features, y) if label >= 0.5]
    values, texts = np.unique(np.concatenate(likely or [np.zeros(0, np.uint64)]), return_counts=True)
    values = values[texts >= LEAST_TEXTS]
    places = [among(values, f) for f in features]
    texts, toxic = np.zeros(len(values)), np.zeros(len(values))
    for held, label in zip(places, y):
        own = np.unique(held)
        texts[own] += 1
        toxic[own] += label
    sure = np.flatnonzero(toxic >= 0.5 * texts)
    keep = sure[np.lexsort((values[sure], -toxic[sure]))][:MOST_FEATURES]
    doc = np.repeat(np.arange(len(places)), [len(f) for f in places])
    where = np.concatenate(places or [np.zeros(0, np.int64)])
    column = np.full(len(values), -1)
    column[keep] = np.arange(len(keep))
    used = column[where] >= 0
    doc, col = doc[used], column[where][used]
    share = min(0.99, max(0.01, y.mean())) if len(y) else 0.5
    weights = np.where(y >= 0.5, 0.5 / share, 0.5 / (1 - share)) / max(1, len(y))
    w, b, look, look_b, momentum = np.zeros(len(keep)), 0.0, np.zeros(len(keep)), 0.0, 1.0
    held = np.bincount(doc, minlength=len(y)) + 1
    # Each step is as long as the curvature of its own feature allows, given how many a text holds.
    rate = 1 / (0.25 * np.bincount(col, (weights * held)[doc], len(keep)) + L2)
    rate_b = 1 / (0.25 * (weights * held).sum() + L2)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, look[col], len(y)) + look_b, -30, 30)))
        g = weights * (p - y)
        new = look - rate * (np.bincount(col, g[doc], len(keep)) + L2 * look)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * L1, 0)
        new_b = look_b - rate_b * g.sum()
        ahead = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        look, look_b = new + (momentum - 1) / ahead * (new - w), new_b + (momentum - 1) / ahead * (new_b - b)
        w, b, momentum = new, new_b, ahead
    some = np.flatnonzero(w)
    return np.float64(b).tobytes() + values[keep[some]].tobytes() + w[some].tobytes()


class Linear:
    def __init__(self, raw: bytes):
        n = (len(raw) - 8) // 16
        self.bias = float(np.frombuffer(raw, np.float64, 1)[0])
        values, weights = np.frombuffer(raw, np.uint64, n, 8), np.frombuffer(raw, np.float64, n, 8 + 8 * n)
        order = np.argsort(values)
        self.values, self.weights = values[order], weights[order]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts; a word counts once, however often and in whichever slice it stands."""
        docs, hashes, worth = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0)]
        for numbers, parts in slices(texts):
            held = Words(numbers, parts)
            own = np.zeros(len(held.hashes))
            for k in range(held.features.shape[1]):
                hit = np.flatnonzero(known(self.values, held.features[:, k]))
                own[hit] += self.weights[np.searchsorted(self.values, held.features[hit, k])]
            doc, word = held.pairs()
            some = own[word] != 0
            docs.append(doc[some])
            hashes.append(held.hashes[word[some]])
            worth.append(own[word[some]])
        doc, h, w = map(np.concatenate, (docs, hashes, worth))
        order = np.lexsort((h, doc))
        doc, h, w = doc[order], h[order], w[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])][: len(doc)]
        # Sums run in the order of hashes within a text, so that equal texts get equal scores.
        logit = self.bias + np.bincount(doc[new], w[new], len(texts))
        return (1 / (1 + np.exp(-np.clip(logit, -30, 30)))).round(9)


@lru_cache(maxsize=1)
def linear_of(model: bytes) -> Linear:
    """One classifier for each Python worker."""
    return Linear(model)


def _in_chunks(column: pa.Array, run) -> np.ndarray:
    """``run`` over lists of texts of about ``CHUNK_BYTES``, joined."""
    out = [np.zeros(0)]
    for batch in chunks(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text", CHUNK_BYTES):
        out.append(run(batch.column("text").to_pylist()))
    return np.concatenate(out)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED) -> bytes | None:
    """Classifier weights, or None without labelled documents outside the held-out fold.

    At most ``most`` labelled documents give the mined voters their lexicons and the label
    model its prior; that is all labels are used for. The votes of all documents, counted by pattern
    (of 14 bits, so at most 16,384), fit the label model in a task; its posteriors, not the
    labels, train the classifier on the sampled texts.
    """
    texts = docs.select("doc_id", "text")
    sample = materialise(labelled_sample(texts, labels, label, FOLDS, HELD, most), "toxicity-sample")
    mined = fit_in_task(sample.mapInArrow(_sampled, "text_hash long, features binary, label double"), mine)
    if mined is None:
        return None
    prior = json.loads(mined)[0]

    @F.arrow_udf("int")
    def votes(column: pa.Array) -> pa.Array:
        return pa.array(_in_chunks(column, voters_of(mined).vote).astype(np.int32))

    counted = texts.select(votes("text").alias("votes")).groupBy("votes").count()
    posterior = {int(k): p for k, p in json.loads(fit_in_task(counted, lambda held: fit_label_model(held, prior))).items()}

    @F.arrow_udf("double")
    def believed(column: pa.Array) -> pa.Array:
        return pa.array([posterior[v] for v in _in_chunks(column, voters_of(mined).vote).tolist()], pa.float64())

    soft = sample.select("text", believed("text").alias("label"))
    return fit_in_task(soft.mapInArrow(_sampled, "text_hash long, features binary, label double"), train_linear)


def score(text: str, model: bytes | None) -> Column:
    """Score column of a text column; equal texts get equal scores, null scores as empty, 0.5 without a model."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(_in_chunks(column, linear_of(model).score), pa.float64())

    return scored(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from the ``toxic`` label.

    Null ids are never held out and their labels never learned; repeated ids are scored row by
    row. Texts of any length are read whole, in slices cut between words; further columns,
    clashing or not, are ignored. No documents: no result. No usable labels: every score is 0.5.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = docs.select("doc_id", score("text", train(docs, labels)).alias("score"))
    held = F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
