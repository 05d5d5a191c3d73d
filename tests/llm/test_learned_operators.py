import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import ann, mixing, quality, toxicity
from tidemill.llm.training import fit_in_task

BIG = "/root/testdata/sf0.01"


def judged(found, labels, label):
    rows = found.join(labels, "doc_id").select("held_out", "score", "predicted", F.col(label).alias("y")).toPandas()
    return rows[rows["held_out"]]


def auc(rows):
    rank, ones = rows["score"].rank(), rows["y"] == 1
    n1, n0 = ones.sum(), (~ones).sum()
    return (rank[ones].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_quality_on_held_out_labels(spark):
    held = judged(quality.op9_quality(spark, BIG), spark.read.parquet(f"{BIG}/labels.parquet"), "quality")
    assert len(held) > 50 and auc(held) > 0.97 and (held["predicted"] == held["y"]).mean() > 0.95


def test_toxicity_on_held_out_labels(spark):
    large = "/root/testdata/sf0.1"
    held = judged(toxicity.op3_toxicity(spark, large), spark.read.parquet(f"{large}/labels.parquet"), "toxic")
    called = held["predicted"] == 1
    assert len(held) > 1000 and auc(held) > 0.95
    assert (held["y"][called] == 1).mean() > 0.95 and called[held["y"] == 1].mean() > 0.85


def test_quality_holds_little_beside_its_texts():
    texts = pa.RecordBatch.from_arrays([pa.array(["Plain words, in lines.\n" * 100] * 2000), pa.array([1.0, 0.0] * 1000)], ["text", "label"])
    tracemalloc.start()
    found = pa.Table.from_batches(quality._features(iter([texts])))
    encoding = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    quality.fit(found.slice(0, 64))
    before = tracemalloc.get_traced_memory()[0]
    quality.fit(pa.concat_tables([found] * 2))
    fitting = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert found.num_rows == 2000 and encoding < 60e6 and fitting < 3 * 2 * found.nbytes


@pytest.mark.parametrize("run", [quality.score_quality, toxicity.score_toxicity])
def test_scores_of_odd_rows(odd, empty, labels, no_labels, run):
    found = run(odd, labels.unionByName(labels.select(F.lit(None).cast("long").alias("doc_id"), F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic")))).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (1, 5)}) == 1  # equal texts
    assert len({r["score"] for r in found if r["doc_id"] in (2, 3)}) == 1  # null as empty
    assert {r["held_out"] for r in found if r["doc_id"] is None} == {False}
    assert {(r["score"], r["predicted"]) for r in run(odd, no_labels).collect()} == {(0.5, 0)}
    assert run(empty, labels).count() == 0


def test_gradient_of_attention():
    random = np.random.default_rng(1)
    model, counts = quality.Model.fresh(), np.array([3, 1, 4])
    x, y = random.normal(size=(8, quality.WIDTH)), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean([t * np.log(s) + (1 - t) * np.log(1 - s) for s, t in zip(model.forward(x, counts)[0], y)])
    for name, g in model.gradient(x, counts, y).items():
        at = tuple(int(random.integers(n)) for n in g.shape)
        model.p[name][at] += 1e-6
        up = loss()
        model.p[name][at] -= 2e-6
        down = loss()
        model.p[name][at] += 1e-6
        assert abs((up - down) / 2e-6 - g[at]) < 1e-6


def test_passages_cover_whole_texts():
    x, counts = quality.encode_passages(["a" * 1000, None, "", "X X X y"])
    assert counts.tolist() == [3, 1, 1, 1] and x[:3, -3].sum() == pytest.approx(1000 / quality.PASSAGE)
    assert x[5, -1] == 0.5 and x[3, -2] == 1


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def plain_search(rows, k):
    held = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for q, x in held:
        if q % 20 == 0:
            found = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in held if i != q)[:k]
            out[q] = [(i, d) for d, i in found]
    return out


def test_few_vectors_are_searched_exactly(spark):
    random = np.random.default_rng(2)
    good = [(i, random.normal(size=4).astype(np.float32).tolist()) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(15)]
    bad = [(200, None, 0), (220, [0.0] * 4, 0), (240, [1.0, None, 0.0, 0.0], 0), (260, [float("nan"), 1.0, 1.0, 1.0], 0), (280, [float("inf"), 1.0, 1.0, 1.0], 0), (None, [1.0] * 4, 0), (300, [1.0], 0), (320, [], 0)]
    found = ann.search(vectors(spark, [(i, v, 0) for i, v in good] + bad), "id % 20 = 0", 10).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = plain_search(good, 10)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a - b) < 1e-12 for q in want for (_, a), (_, b) in zip(got[q], want[q]))


def test_fewer_candidates_than_wanted(spark):
    found = ann.search(vectors(spark, [(0, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [0.0, 2.0], 0)]), "id % 20 = 0", 10).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in found] == [(1, 1, 0.0), (2, 2, 1.0)]
    assert ann.search(vectors(spark, []), "id % 20 = 0").count() == 0
    assert ann.search(vectors(spark, [(0, None, 0)]), "id % 20 = 0").count() == 0


def test_recall_over_many_parts(spark):
    random = np.random.default_rng(9)
    centres = random.normal(size=(12, 16)) * 3
    rows = [(i, (centres[i % 12] + random.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[0][1]) for i in range(800)]
    found = ann.search(vectors(spark, [(i, v, 0) for i, v in rows]), "id % 20 = 0", 10, part_rows=300).toPandas()
    x, ids = np.array([v for _, v in rows], np.float32).astype(float), np.array([i for i, _ in rows])
    hits = total = 0
    for q, near in found.groupby("query_id")["score"]:
        d = np.sort(np.sqrt(((x - x[q]) ** 2).sum(axis=1))[ids != q])[:10]
        hits += (near.sort_values().to_numpy() <= d[-1] + 1e-9).sum()
        total += 10
    assert found["query_id"].nunique() == sum(i % 20 == 0 for i in ids) and hits / total >= 0.9


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(600, 8))
    part = ann.balanced_parts(x, ann.sample_neighbours(x, 10), 7)
    assert np.bincount(part, minlength=7).max() <= ann.SLACK * 600 / 7 + 1


def test_rates_meet_targets(spark):
    found = mixing.op7_mixing(spark, BIG).toPandas()
    n = found["n_tokens"].sum()
    for d, share in mixing.TARGETS.items():
        assert (found["n_tokens"] * found["rate"] * found[f"p_{d}"]).sum() == pytest.approx(share * n, abs=0.01 * n)
    assert (found["rate"] >= 0).all() and np.allclose(found[[f"p_{d}" for d in mixing.DOMAINS]].sum(axis=1), 1)
    assert abs(found["copies"].mean() - found["rate"].mean()) < 0.05
    assert ((found["copies"] - found["rate"]).abs() < 1).all()


def test_rates_against_plain_projected_gradient(spark):
    random = np.random.default_rng(6)
    p = random.dirichlet([0.3, 0.3, 0.3], 40)
    n = random.integers(1, 500, 40)
    cells = spark.createDataFrame(pd.DataFrame({f"p_{d}": p[:, k] for k, d in enumerate(mixing.DOMAINS)} | {"n": n}))
    targets = dict(zip(mixing.DOMAINS, (0.9, 0.1, 0.0)))
    history = mixing.fit_rates(cells, targets)
    rate = np.array([r["r"] for r in cells.withColumn("r", mixing.rate_after(history)).orderBy("n").collect()])
    p, n = p[np.argsort(n, kind="stable")], np.sort(n)
    want = np.array([0.9, 0.1, 0.0]) * n.sum()
    weigh = np.linalg.inv((p * n[:, None]).T @ p + 1e-6 * n.sum() * np.eye(3))
    plain = np.ones(40)
    for _ in range(len(history)):
        plain = np.maximum(0, plain - (p @ (weigh @ ((n * plain) @ p - want)) + mixing.PULL * (plain - 1)) / (1 + mixing.PULL))
    error = lambda r: float(((n * r) @ p - want) @ weigh @ ((n * r) @ p - want))
    assert error(rate) <= error(np.ones(40)) and abs(error(rate) - error(plain)) < 1e-3 * max(1.0, error(np.ones(40)))


def test_posteriors_against_plain_regression(spark):
    """Multinomial regression by plain gradient steps over the same features."""
    words = [["good", "fine", "calm"], ["||", "spam", "buy"], ["vile", "bad", "rude"]]
    draw, rows = np.random.default_rng(3), []
    for i in range(90):
        rows.append((i, " ".join(draw.choice(words[i % 3] + words[0], 6))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 1 else 1, int(i % 3 == 2)) for i in range(60)], "doc_id long, quality int, toxic int")
    held = mixing.membership(docs, labels).toPandas().sort_values("doc_id")
    vectors = mixing.featured(docs).toPandas().sort_values("doc_id")["features"]
    used = sorted({int(j) for v in vectors for j in v.indices})
    x = np.array([[v[j] for j in used] for v in vectors])
    y, w, b = np.eye(3)[np.arange(60) % 3], np.zeros((len(used), 3)), np.zeros(3)
    soft = lambda z: np.exp(z - z.max(axis=1, keepdims=True)) / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)
    for _ in range(20_000):
        error = (soft(x[:60] @ w + b) - y) / 60
        w, b = w - 1.0 * (x[:60].T @ error + mixing.PENALTY * w), b - 1.0 * error.sum(axis=0)
    found = held[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert np.allclose(found.sum(axis=1), 1) and (found >= 0).all()
    assert abs(found - soft(x @ w + b)).max() < 0.03


def test_mixing_of_few_labels_and_far_targets(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    one = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: (r["p_clean"], r["p_low"], r["p_toxic"]) for r in mixing.mix(docs, one).collect()}
    assert found == {1: (0, 1, 0), 2: (0, 1, 0)}
    monkeypatch.setattr(mixing, "MOST_STEPS", 1)
    cells = spark.createDataFrame([(0.9, 0.1, 0.0, 50), (0.2, 0.8, 0.0, 70), (0.3, 0.3, 0.4, 60)], "p_clean double, p_low double, p_toxic double, n long")
    with pytest.warns(UserWarning, match="still miss a target"):
        mixing.fit_rates(cells, {"clean": 1.0, "low": 0.0, "toxic": 0.0})


def test_mixing_of_odd_rows(odd, empty, labels, no_labels):
    for held in (labels, no_labels, labels.unionByName(labels)):
        found = mixing.mix(odd, held).collect()
        assert len(found) == odd.count() and all(r["rate"] >= 0 for r in found)
        assert {r["n_tokens"] for r in found if r["doc_id"] in (2, 3, 4)} == {0}
    assert mixing.mix(empty, labels).count() == 0
    plan = mixing.mix(odd, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_route_keeps_types():
    assert ann._matrix(pa.array([[1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float32()))).tolist() == [[1, 2], [3, 4]]


def test_recall_of_the_query_itself(spark, monkeypatch):
    """Over ``embeddings``, against brute force, in several parts of which not all are read."""
    fitted = []
    monkeypatch.setattr(ann, "fit_in_task", lambda rows, fit: fitted.append(fit_in_task(rows, fit)) or fitted[-1])
    found = ann.op6_ann(spark, "/root/testdata/sf0.1").toPandas()
    held = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toPandas().dropna()
    x, ids = np.array(held["embedding"].tolist(), float), held["vec_id"].to_numpy()
    hits = 0
    for q, near in found.groupby("query_id")["score"]:
        d = np.sort(np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))[ids != q])[:10]
        hits += (near.to_numpy() <= d[-1] + 1e-9).sum()
    model = ann._loaded(fitted[0])
    assert hits >= 0.9 * len(found) and len(found) == 10 * (ids % 100 == 0).sum()
    assert model["v"].shape[1] >= 4 and model["probes"] < model["v"].shape[1]


@pytest.mark.parametrize("levels", [1, 2])
def test_clustered_vectors_leave_most_rows_unread(spark, monkeypatch, levels):
    draw = np.random.default_rng(12)
    centres = draw.normal(size=(60, 16))
    at = np.where(draw.random(5000) < 0.3, 0, draw.integers(0, 60, 5000))  # one cluster with a third of all
    x = (centres[at] + 0.15 * draw.normal(size=(5000, 16))).astype(np.float32)
    for name, value in (("ONE_LEVEL", 64 if levels == 1 else 4), ("TOP_PARTS", 8), ("BLOCK_ROWS", 100), ("GROUP_QUERIES", 20)):
        monkeypatch.setattr(ann, name, value)
    held, probing = [], ann._probing
    monkeypatch.setattr(ann, "_probing", lambda *a: held.append(a) or probing(*a))
    found = ann.search(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), "id % 50 = 0", 10, part_rows=100 if levels == 2 else 300).toPandas()
    q = x[::50].astype(float)
    d = np.sqrt(((q[:, None] - x[None].astype(float)) ** 2).sum(axis=2))
    d[np.arange(len(q)), np.arange(0, 5000, 50)] = np.inf
    tenth = np.sort(d, axis=1)[:, 9]
    hits = sum((near.to_numpy() <= tenth[i // 50] + 1e-9).sum() for i, near in found.groupby("query_id")["score"])
    assert len(found) == 1000 and hits >= 900
    router, sizes, slices, least = held[0]
    read = [sum(sizes[leaf] for leaf in leaves) for leaves in router().probed(q, sizes, least)]
    assert np.mean(read) <= 0.5 * 5000 and len(router().inner) == (8 if levels == 2 else 0)
    assert len(sizes) > 8 and max(sizes[c] / slices[c] for c in sizes) <= 100
