import math
import random
import re

import numpy as np

from tidemill.llm import quality, toxicity

TEXTS = ["", "a", "Hello, world! " * 60, "spam spam spam | buy " * 50, "Ünïcödé 123\n\n" * 40, "x" * 1000, " lead  and trail ", "word " * 81]


def plain_passages(text):
    """Features of each passage by counting one byte after another."""
    raw = text.encode()
    total = max(1, math.ceil(len(raw) / quality.PASSAGE))
    rows = np.zeros((total, quality.WIDTH))
    length = [len(raw[i * quality.PASSAGE : (i + 1) * quality.PASSAGE]) for i in range(total)]
    for i in range(len(raw) - 1):
        rows[i // quality.PASSAGE, quality.CLASS_OF[raw[i]] * quality.N + quality.CLASS_OF[raw[i + 1]]] += 1
    words = [(m.start() // quality.PASSAGE, m[0]) for m in re.finditer(rb"[^ \t\r\n\x0b\x0c]+", raw)]
    for p in range(total):
        rows[p, : quality.N**2] = np.sqrt(rows[p, : quality.N**2] / max(1, length[p]))
        rows[p, -3], rows[p, -2] = length[p] / quality.PASSAGE, length[p] == 0
        own = [(j, w) for j, (at, w) in enumerate(words) if at == p]
        rows[p, -1] = sum(j > 0 and words[j - 1][1] == w for j, w in own) / max(1, len(own))
    return rows


def plain_attention(p, rows):
    """Score of one document, passage by passage."""
    hidden = [np.tanh(r @ p["w"] + p["b"]) for r in rows]
    energy = [float(p["a"] @ (np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"]))))) for h in hidden]
    share = [math.exp(e - max(energy)) for e in energy]
    z = sum(s / sum(share) * h for s, h in zip(share, hidden))
    return 1 / (1 + math.exp(-(float(z @ p["c"]) + float(p["d"][0]))))


def test_quality_scores_passage_by_passage():
    draw, model = random.Random(1), quality.Model.fresh()
    model.p["d"] += 0.3
    texts = TEXTS + ["".join(draw.choice("ab C1.!|\n é") for _ in range(draw.randrange(2000))) for _ in range(20)]
    x, counts = quality.encode_passages(texts)
    plain = [plain_passages(t) for t in texts]
    assert counts.tolist() == [len(r) for r in plain] and np.allclose(x, np.concatenate(plain), atol=1e-6)
    assert np.allclose(model.forward(x, counts)[0], [plain_attention(model.p, r) for r in plain], atol=1e-6)


def test_toxicity_scores_add_up_word_by_word(spark, documents, labels):
    """The classifier is linear: a text's log odds are those of its distinct words."""
    linear = toxicity.Linear(toxicity.train(documents, labels))
    odds = lambda texts: np.log(linear.score(texts) / (1 - linear.score(texts)))
    bias = odds([""])[0]
    texts = [r["text"] for r in documents.where("length(text) between 20 and 400").limit(60).collect()]
    assert abs(bias - linear.bias) < 1e-4  # scores have nine places
    for text, found in zip(texts, odds(texts)):
        words = sorted(set(text.lower().split()))
        want = bias + sum(o - bias for o in odds(words))
        assert abs(found - want) < 0.02 or abs(want) > 15
