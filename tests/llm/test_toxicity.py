import itertools
import math

import numpy as np
import pytest

from tidemill.llm import toxicity, words

BIT = {name: 1 << k for k, name in enumerate(toxicity.VOTERS)}


def votes_of(*texts):
    found = toxicity.Voters(b"[0.1, [], [], []]").vote(list(texts))
    return [{n for n, b in BIT.items() if v & b} for v in found.tolist()]


def test_voters():
    assert votes_of(None, "", "a clean text", "you idiot") == [set(), set(), set(), {"insults", "addressed", "dense"}]
    assert votes_of("1d10t", "f**k off", "no !! no", "2024 was fine") == [{"digits", "dense"}, {"marks"}, {"exclaims"}, set()]
    long = " ".join(f"x{i}y" for i in range(300)) + " moron " + "y " * 100 + "Idiotic fool"
    assert votes_of(long, long + " z" * words.SLICE_BYTES) == [{"insults", "insult_stems", "several", "close"}] * 2


def plain_words(text):
    return set((text or "").lower().encode().translate(words._SEPARATE).split())


def test_words_and_stems_in_slices():
    texts = ["Grün grüne grünes", None, "ab abcd abcde abcdef", "", "w%d " * 3 % (1, 2, 1), "x" * 3000]
    whole = [set() for _ in texts]
    for numbers, parts in words.slices(texts, 7):
        held = words.Words(numbers, parts)
        for i, w in zip(*held.pairs()):
            whole[i].add(held.spelled(w))
    assert whole == [plain_words(t) for t in texts]
    held = words.Words([0], ["grün grüne grünes grübeln".encode()])
    row = {held.spelled(w).decode(): f for w, f in enumerate(held.features.tolist())}
    assert row["grün"][1] == 0 and row["grüne"][1] == row["grünes"][1] != row["grübeln"][1] != 0
    assert row["grünes"][2] != 0 == row["grünes"][3]


def test_scores_do_not_depend_on_slices(monkeypatch):
    random = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in random.integers(0, 60, n)) for n in (5, 300, 2000)] + ["", None]
    rows = [words.hash_of(f"w{i}")[0] for i in range(0, 60, 3)]
    weight = random.normal(size=len(rows))
    model = toxicity.Linear(np.float64(0.3).tobytes() + np.array(rows, np.uint64).tobytes() + weight.tobytes())
    want = [1 / (1 + math.exp(-(0.3 + sum(w for i, w in zip(range(0, 60, 3), weight) if b"w%d" % i in plain_words(t))))) for t in texts]
    assert model.score(texts) == pytest.approx(want, abs=1e-8)
    whole = model.score(texts)
    monkeypatch.setattr(toxicity, "slices", lambda held: words.slices(held, 50))
    assert (model.score(texts) == whole).all()


def plain_tree_model(rows, prior, rounds):
    """The same model text by text: posterior of each row of votes."""
    m, believed = len(rows[0]), None
    share = [sum(r[k] for r in rows) for k in range(m)]
    rare = [sum(-math.log((share[k] + 0.5) / (len(rows) + 1)) for k in range(m) if r[k]) for r in rows]
    kinds = sorted(set(rows))
    order = sorted(kinds, key=lambda r: (-rare[rows.index(r)], r))
    believed, before = {}, 0
    for r in order:
        believed[r] = 0.95 if before < prior * len(rows) and any(r) else 0.01
        before += rows.count(r)
    for _ in range(rounds):
        total = [[b if y else 1 - b for b in (believed[r] for r in rows)] for y in (0, 1)]
        size = [sum(t) for t in total]
        both = [[[sum(t * r[i] * r[j] for t, r in zip(total[y], rows)) for j in range(m)] for i in range(m)] for y in (0, 1)]
        rate = [[(both[y][k][k] + 0.5) / (size[y] + 1) for k in range(m)] for y in (0, 1)]
        info = {}
        for i, j in itertools.combinations(range(m), 2):
            info[i, j] = 0.0
            for y in (0, 1):
                p11 = (both[y][i][j] + 0.25) / (size[y] + 1)
                for a, b, p in ((1, 1, p11), (1, 0, rate[y][i] - p11), (0, 1, rate[y][j] - p11), (0, 0, 1 - rate[y][i] - rate[y][j] + p11)):
                    q = (rate[y][i] if a else 1 - rate[y][i]) * (rate[y][j] if b else 1 - rate[y][j])
                    info[i, j] += size[y] / sum(size) * max(p, 1e-12) * math.log(max(p, 1e-12) / q)
        edges, group = [], list(range(m))  # Kruskal
        for i, j in sorted(info, key=lambda e: -info[e]):
            if group[i] != group[j]:
                edges.append((i, j))
                group = [group[i] if g == group[j] else g for g in group]
        parent, reached = {0: -1}, [0]
        for k in reached:
            for e in edges:
                if k in e and (o := e[0] + e[1] - k) not in parent:
                    parent[o] = k
                    reached.append(o)
        for r in kinds:
            logit = math.log(prior / (1 - prior))
            for k, p in parent.items():
                if rate[1][k] <= rate[0][k]:
                    continue
                like = []
                for y in (0, 1):
                    if p < 0:
                        like.append(rate[y][k])
                    else:
                        n = both[y][p][p] if r[p] else size[y] - both[y][p][p]
                        hit = both[y][k][p] if r[p] else both[y][k][k] - both[y][k][p]
                        like.append((hit + 2 * rate[y][k]) / (n + 2))
                logit += math.log(like[1] / like[0]) if r[k] else math.log((1 - like[1]) / (1 - like[0]))
            believed[r] = 1 / (1 + math.exp(-logit))
    return believed


def drawn(n, seed=4):
    random = np.random.default_rng(seed)
    truth = random.random(n) < 0.2
    votes = np.stack([random.random(n) < np.where(truth, hit, false) for hit, false in ((0.9, 0.01), (0.8, 0.02), (0.7, 0.05), (0.3, 0.3), (0.6, 0.1))], axis=1)
    # Two voters that repeat the third, mistakes included: together worth little more than it alone.
    return truth, np.hstack([votes, votes[:, 2:3], votes[:, 2:3] ^ (random.random((n, 1)) < 0.02)]).astype(int)


def test_label_model_against_plain_expectation_maximisation():
    _, votes = drawn(300)
    rows = [tuple(r) for r in votes.tolist()]
    want = plain_tree_model(rows, 0.2, 8)
    kinds, count = np.unique(votes, axis=0, return_counts=True)
    found = toxicity.label_model(kinds, count, 0.2, rounds=8)
    assert found == pytest.approx([want[tuple(k)] for k in kinds.tolist()], abs=1e-6)


def test_label_model_finds_the_truth_among_copied_voters():
    truth, votes = drawn(20_000)
    kinds, place, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    found = toxicity.label_model(kinds, count, 0.2)[place]
    assert ((found > 0.5) == truth).mean() > 0.97
    # Texts that only the copied voters call toxic are seldom toxic, and the model knows.
    only = (votes == [0, 0, 1, 0, 0, 1, 1]).all(axis=1)
    assert only.sum() > 100 and abs(found[only].mean() - truth[only].mean()) < 0.1
    assert len(toxicity.label_model(np.zeros((0, 7), int), np.zeros(0), 0.2)) == 0
