"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, chunks, materialise, pick, table
from .substring_dedup import rolling_hashes
from .words import mixed

BITS = 64
CHUNK_BYTES = 4 << 20
#: Short fingerprints that a text has, and most bits of each.
TABLES, CODE_BITS = 3, 42
#: Texts sampled for common shingles, sampled texts that make one common, and the most of them.
SAMPLED, COMMON, MOST_COMMON = 20_000, 5, 200_000
KNOWN_WORDS = 100_000
#: Texts of a shingle's largest label that others meet in a guided round, and the number of such rounds.
GUIDES, GUIDED_ROUNDS = 4, 2
#: First shingles of a text by which a pair that has met already is known.
LEADS = 3
#: Shingles of two texts together from which one number says how far their fingerprints may be apart.
LEAST_PRINTED = 60


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the lower-cased (A-Z) word shingles of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = (ends - [len(w) + 1 for w in words]).tolist()
    last = (ends - 1).tolist()[min(shingle, len(words)) - 1 :]
    digest, ones, step = xxhash.xxh64_digest, np.zeros(BITS, np.int64), 1 << 16
    for at in range(0, len(last), step):
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(begins[at : at + step], last[at : at + step])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(last)).tobytes(), "big", signed=True)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda text: fingerprint(text, shingle), 200)  # exact copies often stand close together
        for batch in chunks(batches, "text", CHUNK_BYTES):
            found = pa.array([memo[t] for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; a null or wordless text has fingerprint zero."""
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def ball_links(distinct: DataFrame, radius: int = 2, bits: int = BITS) -> DataFrame:
    """Verified links (a, b), a < b, that connect all fingerprints at most ``radius`` bits apart.

    ``distinct`` has one row per fingerprint ``fp``, of which the lowest ``bits`` bits are flipped. Each emits every variant within half the
    radius, so two fingerprints meet in a variant exactly if they differ by at most ``radius``
    bits. An even radius of 2 needs one flipped bit; a variant's colliding fingerprints are
    then the variant with one bit flipped, and a bit set of constant size holds them all: it
    is what the shuffle aggregates. All members of one variant lie within the radius of each
    other, so links from the smallest to the others lose no connection.
    """
    if radius != 2:
        raise ValueError("only a radius of 2 is supported")
    # Rows grow by the number of variants: deal them out first, however few files they lie in. By a
    # hash of their own, since dealing by fp again after a grouping by fp would be optimised away.
    dealt = distinct.repartition(max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), F.xxhash64("fp"))
    emitted = dealt.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(bits - 1))).alias("bit")).selectExpr(
        "if(bit < 0, fp, fp ^ shiftleft(1L, bit)) as variant",
        "if(bit < 0, 0L, shiftleft(1L, bit)) as flipped",
        "if(bit < 0, 1, 0) as own",
    )
    met = emitted.groupBy("variant").agg(F.expr("bit_or(flipped)").alias("flipped"), F.max("own").alias("own"))
    met = met.where("bit_count(flipped) + own >= 2")
    flips = F.expr(f"transform(filter(sequence(0, {bits - 1}), b -> getbit(flipped, b) = 1), b -> variant ^ shiftleft(1L, b))")
    members = F.when(F.col("own") == 1, F.array_append(flips, F.col("variant"))).otherwise(flips)
    star = met.select(members.alias("m")).select(F.array_min("m").alias("a"), F.explode("m").alias("b"))
    return star.where("a <> b").distinct().where(f"bit_count(a ^ b) <= {radius}")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``links`` (a, b), for every row of ``nodes``.

    Every round takes the smallest label among neighbours, then the label's own label (pointer
    jumping), and writes the labels to the shared folder; it ends when no label moved.
    """
    both = materialise(links.select("a", "b").unionAll(links.select("b", "a")), "links")
    # Only linked nodes take part in the rounds.
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"), F.lit(True).alias("moved")), "labels")
    while not labels.where("moved").isEmpty():
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        labels = materialise(lower.join(jump, "low", "left").select("node", F.coalesce(F.least("low", "far"), "low").alias("label"), (F.coalesce(F.least("low", "far"), "low") < F.col("old")).alias("moved")), "labels")
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """Fingerprint and component of every document: (doc_id, fp, component_id).

    Documents link if their fingerprints differ by at most ``radius`` bits; component_id is the
    smallest id reachable. Equal fingerprints are one class before any link is sought, so
    groups of copies cost one row. Null, empty and wordless texts have fingerprint zero and
    link like others. A null id gets its component's smallest id (null if all are null); rows
    that repeat an id stay separate rows. Texts of any length count whole; further columns,
    clashing or not, are ignored. No rows: no result.
    """
    found = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = ball_links(classes.select("fp"), radius)
    labelled = components(classes.select(F.col("fp").alias("node")), links).withColumnRenamed("node", "fp")
    labelled = materialise(labelled.join(classes, "fp"), "classes")
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    known = labelled.join(smallest, "label").select("fp", "component_id")
    return found.join(known, "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(text: str | None, shingle: int, memo: Memo) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word shingles, ascending; a wordless text has the one hash zero.

    Words are lower-cased (A-Z); a text of fewer words is one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    found = np.sort(mixed(rolling_hashes(hashes, min(shingle, len(words))) + np.uint64(min(shingle, len(words)))))
    return found[np.r_[True, found[1:] != found[:-1]]]


def word_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, KNOWN_WORDS)


def wide_fingerprint(text: str | None, shingle: int, memo: Memo) -> bytes:
    """A 128-bit SimHash over the distinct shingles of one text."""
    found = shingle_hashes(text, shingle, memo)
    ones, rows = np.zeros(128, np.int64), np.stack([found, mixed(found + np.uint64(1))], axis=1).view(np.uint8)
    for at in range(0, len(rows), 1 << 15):
        ones += np.unpackbits(rows[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(rows)).tobytes()


def _wide_fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in chunks(batches, "text", CHUNK_BYTES):
            prints = b"".join(wide_fingerprint(t, n, memo) for t in batch.column("text").to_pylist() for n in (2, shingle))
            parts = np.frombuffer(prints, ">i8").astype(np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("text_id"), *[pa.array(parts[:, i].copy()) for i in range(4)]], ["text_id", "high", "low", "high_s", "low_s"])

    return run


def candidate_links(prints: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) of texts of which a table's ``bits`` bits differ in at most two places.

    Texts of one code link to its first text; codes at most two bits apart are linked by ball
    hashing, so a crowded variant is a bit set of constant size and a crowded code costs a link
    a text. Links stay if the whole fingerprints differ by at most a quarter.
    """
    # The 128 bits in three runs: 42 of the high half, 42 of the low half, and the 22 left over of each, in turn.
    cut = lambda x: f"(({x}) & {(1 << CODE_BITS) - 1}L)"
    codes = ["shiftrightunsigned(high, 22)", "shiftrightunsigned(low, 22)", "shiftleft(high & 4194303L, 20) | (low & 1048575L)"]
    codes = [f"cast({t} as bigint) * {1 << CODE_BITS}L + shiftright({cut(c)}, {CODE_BITS - bits})" for t, c in enumerate(codes)]
    coded = prints.select("text_id", F.explode(F.array(*map(F.expr, codes))).alias("fp"))
    first = materialise(coded.groupBy("fp").agg(F.min("text_id").alias("first")), "codes")
    same = coded.join(first, "fp").select(F.col("first").alias("a"), F.col("text_id").alias("b")).where("a <> b")
    near = ball_links(first.select("fp"), 2, bits)
    of = lambda side: first.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_text"))
    near = near.join(of("a"), "a").join(of("b"), "b").select(F.least("a_text", "b_text").alias("a"), F.greatest("a_text", "b_text").alias("b"))
    links = same.unionAll(near.where("a <> b")).distinct()
    side = lambda of: prints.select(F.col("text_id").alias(of), F.col("high").alias(f"high_{of}"), F.col("low").alias(f"low_{of}"))
    both = links.join(side("a"), "a").join(side("b"), "b")
    return both.where("bit_count(high_a ^ high_b) + bit_count(low_a ^ low_b) <= 32").select("a", "b")


def similarity(a: str, b: str, shingle: int):
    """Jaccard similarity of the word shingles of two text columns."""

    @F.arrow_udf("double")
    def jaccard(left: pa.Array, right: pa.Array) -> pa.Array:
        memo, out, last, held = word_memo(), [], None, np.zeros(0, np.uint64)
        for x, y in zip(left, right):
            x, y = x.as_py(), shingle_hashes(y.as_py(), shingle, memo)
            if x != last:
                last, held = x, shingle_hashes(x, shingle, memo)
            both = len(np.intersect1d(held, y, assume_unique=True))
            out.append(both / (len(held) + len(y) - both))
        return pa.array(out, pa.float64())

    return jaccard(a, b)


def _hashes(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in chunks(batches, "text", CHUNK_BYTES):
            found = [shingle_hashes(text, shingle, memo) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["token"])

    return run


def needed(n, least: float):
    """Shingles that a text of ``n`` shares with any text of similarity ``least``."""
    return np.maximum(1, np.ceil(least * n - 1e-9))


def _postings(shingle: int, least: float, common: np.ndarray, ranks: np.ndarray):
    def prefix(text: str | None, memo: Memo) -> tuple[np.ndarray, int]:
        held = shingle_hashes(text, shingle, memo).view(np.int64)
        rank = np.zeros(len(held), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, held), len(common) - 1)
            rank = np.where(common[at] == held, ranks[at], 0)
        return held[np.lexsort((held, rank))][: len(held) - int(needed(len(held), least)) + 1], len(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in chunks(batches, "text", CHUNK_BYTES):
            found = [prefix(t, memo) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(f) for f, _ in found])
            ids, n = np.repeat(batch.column("text_id").to_numpy(), sizes), np.repeat([n for _, n in found], sizes)
            place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f for f, _ in found])), pa.array(ids), pa.array(n.astype(np.int64)), pa.array(place)], ["token", "text_id", "n", "place"])

    return run


def relabelled(met: DataFrame, labels: DataFrame) -> DataFrame:
    """``met`` with the label of each text; only texts that others are linked to are looked up."""
    moved = labels.where("node <> label").select(F.col("node").alias("text_id"), "label")
    return met.drop("label").join(moved, "text_id", "left").withColumn("label", F.coalesce("label", "text_id"))


def crossing_prefixes(distinct: DataFrame, labels: DataFrame, texts: int, shingle: int, least: float) -> DataFrame:
    """(token, text_id, n, place) of the prefix shingles that texts of different labels have.

    n counts a text's shingles, place is the shingle's among them in the order.

    In any one order of shingles, two texts of similarity ``least`` or more share one of the
    first n - needed(n) + 1 shingles of each: prefix filtering, which is complete at every number of
    texts and for every kind of edit. The order puts shingles last that are common in a sample
    of the texts, so few texts meet in them; the sample changes the work, never the result.
    """
    share = max(1, texts // SAMPLED)
    drawn = distinct.where(F.pmod(F.xxhash64("text_id"), F.lit(share)) == 0).select("text").mapInArrow(_hashes(shingle), "token long")
    often = drawn.groupBy("token").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "token").limit(MOST_COMMON).collect()
    often = np.array([(r["token"], r["count"]) for r in often], np.int64).reshape(-1, 2)
    often = often[np.argsort(often[:, 0])]
    postings = distinct.mapInArrow(_postings(shingle, least, often[:, 0].copy(), often[:, 1].copy()), "token long, text_id long, n long, place long")
    postings = materialise(postings, "shingle-prefixes")
    crossing = relabelled(postings, labels).groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    return materialise(postings.join(materialise(crossing, "crossing-shingles"), "token"), "crossing-prefixes")


def bits_differ(shared: int, own: int, other: int) -> float:
    """Chance that a fingerprint bit differs between sets of so many shared shingles and shingles of their own.

    Exact over all outcomes; a bit is set if more than half of a set's shingles set it, so ties clear it.
    """
    walk = lambda n: np.array([math.comb(n, k) / 2**n for k in range(n + 1)])
    sums = 2 * np.arange(shared + 1) - shared
    over = lambda n: ((sums[:, None] + 2 * np.arange(n + 1) - n > 0) * walk(n)).sum(axis=1)
    x, y = over(own), over(other)
    return float((walk(shared) * (x * (1 - y) + y * (1 - x))).sum())


def beyond(share: float, cut: int) -> float:
    """Chance that more than ``cut`` of 128 bits differ."""
    return sum(math.comb(128, k) * share**k * (1 - share) ** (128 - k) for k in range(cut + 1, 129))


def apart(least: float) -> list[int]:
    """Bits of 128 in which fingerprints of similar texts may differ, by the shingles of both together.

    Sets of that Jaccard similarity have a cosine of 2 s / (1 + s) at least, and each bit of
    large ones differs with the share that their angle has of a half turn: for 0.8 that is 19.4
    bits in the mean and, five deviations on, at most 39. Of few shingles, sums tie and bits
    differ more often: below ``LEAST_PRINTED`` the least number is taken that more bits exceed with
    a chance of 10^-5 at most, whichever way the shingles fall. The last number is for all from there on.
    """
    share = math.acos(2 * least / (1 + least)) / math.pi
    cuts = []
    for together in range(LEAST_PRINTED):
        shared = math.ceil(together * least / (1 + least) - 1e-9)
        worst = max((bits_differ(shared, a, together - 2 * shared - a) for a in range((together - 2 * shared) // 2 + 1)), default=0.0)
        cuts.append(next(c for c in range(129) if beyond(worst, c) <= 1e-5))
    return [*cuts, int(128 * share + 5 * math.sqrt(128 * share * (1 - share)))]


def middles(met: DataFrame) -> DataFrame:
    """(token, middle_h, middle_l): of the fingerprints (h, l) that meet in a shingle, each bit that over half of them have.

    Near copies of one text differ in places of their own, so this is the fingerprint of what they are copies of.
    """
    # One sum counts two bits, 32 places apart.
    pairs = [F.sum(F.expr(f"shiftrightunsigned({c}, {i}) & 4294967297L")).alias(f"{c}{i}") for c in "hl" for i in range(32)]
    counted = met.groupBy("token").agg(F.count(F.lit(1)).alias("texts"), *pairs)
    bit = lambda count, i: f"if(2 * ({count}) > texts, shiftleft(1L, {i}), 0L)"
    middle = lambda c: " | ".join(bit(f"{c}{i} & 4294967295L", i) + " | " + bit(f"shiftrightunsigned({c}{i}, 32)", i + 32) for i in range(32))
    return counted.selectExpr("token", f"{middle('h')} as middle_h", f"{middle('l')} as middle_l")


def with_leads(crossing: DataFrame) -> DataFrame:
    """``crossing`` with the array ``lead`` of the crossing shingles among the first ``LEADS`` of each text."""
    leads = crossing.where(f"place < {LEADS}").groupBy("text_id").agg(F.collect_list("token").alias("lead"))
    return crossing.join(leads, "text_id", "left").withColumn("lead", F.coalesce("lead", F.array().cast("array<bigint>")))


def meetings(met: DataFrame, labels: DataFrame, least: float, guides: int | None = None, seed: int = 0) -> DataFrame:
    """Links (a, b), some repeated, of texts of different labels that meet in a prefix shingle and may be similar.

    Of a shingle the texts outside its largest label meet all others; with ``guides``, only so
    many of the largest label, those whose fingerprints are nearest to its middle, and only in
    crowded shingles, so that links are in proportion to the texts. A shingle counts for two texts if it may
    be the first they share, and their fingerprints must not be further ``apart`` than similar texts
    of as many shingles have them. Without guides, texts that share one of their first ``LEADS``
    shingles meet in none behind those: shingles have one order, so the first shared one always counts.
    """
    met = relabelled(met, labels)
    sizes = met.groupBy("token", "label").count()
    main = sizes.groupBy("token").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("count").alias("crowd")).where(f"labels > 1 and crowd > {2 * guides if guides else 1}").drop("labels", "crowd")
    held = met.join(main, "token")
    x = held.where("label <> main").select("token", F.col("text_id").alias("x"), F.col("n").alias("nx"), F.col("place").alias("px"), F.col("label").alias("lx"), "main", F.col("h").alias("hx"), F.col("l").alias("wx"), F.col("lead").alias("leadx"))
    y = held.select("token", F.col("text_id").alias("y"), F.col("n").alias("ny"), F.col("place").alias("py"), F.col("label").alias("ly"), F.col("h").alias("hy"), F.col("l").alias("wy"), F.col("lead").alias("leady"))
    if guides:
        of_main = held.where("label = main")
        apart_by = F.expr("bit_count(h ^ middle_h) + bit_count(l ^ middle_l)")
        part = F.pmod(F.xxhash64("text_id", F.lit(seed)), F.lit(guides))
        nearest = [F.min_by(F.struct("text_id", "n", "place", "label", "h", "l"), F.when(part == i, F.struct(apart_by, "text_id"))) for i in range(guides)]
        guided = of_main.join(middles(of_main), "token").groupBy("token").agg(F.array_compact(F.array(*nearest)).alias("of"))
        y = guided.select("token", F.explode("of").alias("g")).select("token", F.col("g.text_id").alias("y"), F.col("g.n").alias("ny"), F.col("g.place").alias("py"), F.col("g.label").alias("ly"), F.col("g.h").alias("hy"), F.col("g.l").alias("wy"))
    # Similar texts share so many shingles; from the first they share on, each has that many left.
    shared = f"ceil((nx + ny) * {least / (1 + least)!r} - 1e-9)"
    alike = f"bit_count(hx ^ hy) + bit_count(wx ^ wy) <= array({', '.join(map(str, apart(least)))})[cast(least(nx + ny, {LEAST_PRINTED}) as int)]"
    new = "true" if guides else f"(px < {LEADS} or not arrays_overlap(leadx, leady))"
    pairs = x.join(y, "token").where(f"lx <> ly and (ly = main or x < y) and nx - px >= {shared} and ny - py >= {shared} and {alike} and {new}")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def meeting_links(met: DataFrame, labels: DataFrame, least: float, guides: int | None = None, seed: int = 0) -> DataFrame:
    """The distinct links of ``meetings``."""
    return meetings(met, labels, least, guides, seed).distinct()


def similar_rows(rows: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(row_id, doc_id, component_id, first) of rows (row_id, doc_id, text) whose row_id tells them apart.

    Rows belong together if their texts are linked by similar word shingles; component_id is
    the smallest doc_id of a component, and ``first`` marks one of its rows with that id (the
    smallest row_id). Rows that repeat an id stay apart, with equal or different texts.
    """
    held = rows.select("row_id", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = held.select("row_id", "doc_id", F.sha2("text", 256).alias("hash"))
    # Equal texts are one class. Written first, so that a join can split the copies of one text over tasks.
    classes = materialise(hashed.groupBy("hash").agg(F.min(F.struct("doc_id", "row_id")).alias("head")), "distinct-texts")
    known = materialise(hashed.join(classes, "hash").select("row_id", "doc_id", F.col("head.row_id").alias("text_id"), F.col("head.doc_id").alias("least")), "text-classes")
    heads = known.where("row_id = text_id")
    distinct = held.join(heads.select("row_id"), "row_id", "left_semi").select(F.col("row_id").alias("text_id"), "text")
    prints = materialise(distinct.mapInArrow(_wide_fingerprints(shingle), "text_id long, high long, low long, high_s long, low_s long"), "wide-fingerprints")
    texts = prints.count()
    nodes, bits = prints.select(F.col("text_id").alias("node")), min(CODE_BITS, max(1, texts).bit_length() + 8)
    left, right = (distinct.select(F.col("text_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")

    def verified(links: DataFrame) -> DataFrame:
        held = materialise(links, "candidate-links").join(left, "a").join(right, "b")
        return materialise(held.where(similarity("text_a", "text_b", shingle) >= least).select("a", "b"), "similar-links")

    similar = verified(candidate_links(prints, bits))
    labels = materialise(components(nodes, similar), "text-labels")
    met = materialise(with_leads(crossing_prefixes(distinct, labels, texts, shingle, least)).join(prints.select("text_id", F.col("high_s").alias("h"), F.col("low_s").alias("l")), "text_id"), "crossing-fingerprints")
    # Guided rounds connect what they can of crowded shingles; the last round compares all that is left.
    for seed, guides in enumerate((*[GUIDES] * GUIDED_ROUNDS, None)):
        more = verified(meeting_links(met, labels, least, guides, seed))
        if not more.isEmpty():
            similar = similar.unionAll(more)
            labels = materialise(components(nodes, similar), "text-labels")
    # Of a text no other is linked to nothing moves; the smallest id of a component is known by its label.
    labels = labels.withColumnRenamed("node", "text_id")
    heads = heads.join(labels, "text_id").groupBy("label").agg(F.min(F.struct("least", "row_id")).alias("head"))
    named = labels.join(heads, "label").select("text_id", F.col("head.least").alias("component_id"), F.col("head.row_id").alias("kept"))
    return known.join(named, "text_id").select("row_id", "doc_id", "component_id", (F.col("row_id") == F.col("kept")).alias("first"))


def numbered_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a row_id, in the shared folder: an id of its own for each row, kept whatever runs again."""
    return materialise(docs.withColumn("row_id", F.monotonically_increasing_id()), "numbered-rows")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row with an id: texts linked by similar word shingles.

    Equal texts are one class first. First candidates come from ball hashing of three short
    fingerprints of two-word shingles, which near copies hardly change; only those whose
    five-word shingles (``shingle``) have a Jaccard similarity of ``least`` are linked. That
    connects large groups cheaply but misses pairs; prefix filtering then brings every such
    pair that is not yet connected and whose fingerprints allow it, so that components are those
    of all pairs, but for one pair in 10^5 at most (``apart``) of those that nothing else
    connects, and for equal 64-bit hashes of different shingles within two texts. Null, empty and wordless texts are
    one class; null ids are left out; rows that repeat an id stay separate rows. Texts of any
    length count whole; further columns, clashing or not, are ignored. No rows: no result.
    """
    held = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id is not null")
    return similar_rows(numbered_rows(held), shingle, least).select("doc_id", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
