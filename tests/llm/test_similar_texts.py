import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import simhash

WORDS = [f"w{i}" for i in range(50_000)]


def shingle_set(text, shingle):
    words = (text or "").lower().split()
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def linked(spark, rows):
    return {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def all_components(rows, least=0.8):
    """Smallest id of each component over all pairs."""
    sets, label = {i: shingle_set(t, 5) for i, t in rows}, {i: i for i, _ in rows}
    for i in sets:
        for j in sets:
            if i < j and label[i] != label[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("before", [0, 50])
def test_blocks_added_at_exactly_the_least_similarity(spark, before):
    random, rows = np.random.default_rng(before), []
    for _ in range(300):
        words = list(random.choice(WORDS, 254, replace=False))
        rows += [(len(rows), " ".join(words[before : before + 204])), (len(rows) + 1, " ".join(words))]
    a, b = (shingle_set(t, 5) for _, t in rows[:2])
    assert len(a & b) == 200 and len(a | b) == 250
    assert linked(spark, rows) == {i: i - i % 2 for i, _ in rows}


def test_near_copies_inside_a_template_family(spark):
    random, template = np.random.default_rng(3), WORDS[:240]
    rows = []
    for i in range(160):
        # An own block of words in the template's place: members are below the least similarity to each other.
        words, at = template.copy(), int(random.integers(200))
        words[at : at + 36] = random.choice(WORDS[300:], 36, replace=False)
        rows.append((i, " ".join(words)))
        if i >= 100:
            words[int(random.integers(240))] = "changed"
            rows.append((i + 1000, " ".join(words)))
    expected = all_components(rows)
    assert expected[1100] == 100 and len(set(expected.values())) > 50
    assert linked(spark, rows) == expected


def test_a_hub_hides_no_pair(spark):
    """Texts 2 and 3 are near each other; 1 shares a short fingerprint with both and nothing else."""
    random = np.random.default_rng(8)
    words = list(random.choice(WORDS, 200, replace=False))
    mixed = [*words[100:], *words[:100]]
    random.shuffle(mixed)
    rows = [(1, " ".join(mixed)), (2, " ".join(words)), (3, " ".join([*words[:-3], "x", "y", "z"]))]
    rows += [(i, " ".join(random.permutation(words))) for i in range(10, 40)]
    assert linked(spark, rows) == all_components(rows) and linked(spark, rows)[3] == 2


def test_random_groups_against_all_pairs(spark):
    random, rows = np.random.default_rng(12), []
    for g in range(25):
        base = list(random.choice(WORDS, int(random.integers(3, 120))))
        for _ in range(12):
            words = base.copy()
            for _ in range(int(random.integers(0, 1 + len(words) // 12))):
                at = int(random.integers(len(words)))
                words[at : at + int(random.integers(0, 3))] = random.choice(WORDS, int(random.integers(0, 3)))
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, t) for i, t in enumerate(("", " \t", "one", "One", "one two", None))]
    assert linked(spark, rows) == all_components(rows)


def test_rows_that_repeat_an_id(spark):
    long = " ".join(WORDS[:100])
    rows = [(5, 1, long), (6, 1, long), (7, 2, long + " more"), (8, 2, "another text"), (9, 3, "another text"), (10, 2, "a third one")]
    found = {r["row_id"]: (r["component_id"], r["first"]) for r in simhash.similar_rows(spark.createDataFrame(rows, "row_id long, doc_id long, text string")).collect()}
    assert found == {5: (1, True), 6: (1, False), 7: (1, False), 8: (2, True), 9: (2, False), 10: (2, True)}


@pytest.mark.parametrize("together", [2, 9, 10, 11, 13, 27, 29, 58, 59, 60, 61, 80, 99, 150, 301])
def test_fingerprints_lose_one_pair_of_100000_at_most(together):
    shared = int(np.ceil(together * 0.8 / 1.8 - 1e-9))
    own, cuts = together - 2 * shared, simhash.apart(0.8)
    assert len(cuts) == simhash.LEAST_PRINTED + 1
    for a in range(own // 2 + 1):
        assert simhash.beyond(simhash.bits_differ(shared, a, own - a), cuts[min(together, simhash.LEAST_PRINTED)]) < 1e-5


def test_bits_differ_as_in_random_sets():
    draw = np.random.default_rng(4)
    signs = draw.choice([-1, 1], size=(200_000, 5))
    differ = ((signs[:, :4].sum(axis=1) > 0) != (signs.sum(axis=1) > 0)).mean()
    assert simhash.bits_differ(4, 0, 1) == 0.1875 and abs(differ - 0.1875) < 0.005


def test_short_texts_at_exactly_the_least_similarity(spark):
    """Nine words and the first eight of them: five shingles and four, of which many tie."""
    draw, rows = np.random.default_rng(6), []
    for words in np.array(WORDS)[draw.integers(len(WORDS), size=(20_000, 9))]:
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:8]))]
    assert linked(spark, rows) == {i: i - i % 2 for i, _ in rows}


def met_texts(spark, texts):
    """What meetings() takes: all texts by themselves but for the first 61, which are linked."""
    rows = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i <= 60 else i) for i in range(len(texts))], "node long, label long")
    prints = rows.mapInArrow(simhash._wide_fingerprints(5), "text_id long, high long, low long, h long, l long").select("text_id", "h", "l")
    return simhash.with_leads(simhash.crossing_prefixes(rows, labels, len(texts), 5, 0.8)).join(prints, "text_id").localCheckpoint(), labels


def family(changes):
    """A text, and copies of it with as many single words changed, each in places of its own."""
    draw = np.random.default_rng(17)
    template = list(draw.choice(WORDS, 400, replace=False))
    texts = [" ".join(template)]
    for n in changes:
        words = template.copy()
        for at in draw.choice(80, n, replace=False):
            words[5 * at] = f"own{len(texts)}x{at}"
        texts.append(" ".join(words))
    return texts


def test_guides_are_the_texts_that_others_are_copies_of(spark):
    """Thirty outsiders are similar to the template alone, one text of 61 that are linked."""
    texts = family([5] * 60 + [8] * 30)
    sets = [shingle_set(t, 5) for t in texts]
    alike = {(j, i) for i in range(61, 91) for j in range(61) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert alike == {(0, i) for i in range(61, 91)}
    met, labels = met_texts(spark, texts)
    found = {(r["a"], r["b"]) for r in simhash.meeting_links(met, labels, 0.8, simhash.GUIDES, 0).collect()}
    assert alike <= found


def test_a_pair_meets_in_few_shingles(spark, monkeypatch):
    """Of pairs that share most of their shingles, none of them common in the sample, none is lost and few are made often."""
    monkeypatch.setattr(simhash, "COMMON", 1000)
    met, labels = met_texts(spark, family([5] * 60 + [8] * 15))
    made = simhash.meetings(met, labels, 0.8)
    plain = simhash.meetings(met.withColumn("lead", F.array().cast("array<bigint>")), labels, 0.8)
    pairs = {tuple(r) for r in made.distinct().collect()}
    assert pairs == {tuple(r) for r in plain.distinct().collect()} and len(pairs) > 800
    assert made.count() <= (simhash.LEADS + 1) * len(pairs) and made.count() < plain.count() / 3
