import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import hard_negatives, pivot_search, registry, vectors

DIR = "/root/testdata/sf0.001"
SHAPE = "vec_id long, embedding array<float>, label int"


def found_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["op11_exact_search", "op12_hard_negatives"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DIR}/embeddings.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    found = registry.queries()[name](spark, DIR)
    assert found.columns == want.columns and found_rows(found) == sorted(want.fetchall()) != []


def plain_search(rows, k, every):
    held = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows]
    asked = {}
    for q, x in held:
        if q % every == 0 and (q not in asked or tuple(x) < tuple(asked[q])):
            asked[q] = x
    out = []
    for q, x in asked.items():
        best = sorted((-int(v @ x), i) for i, v in held if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def clustered(n, seed=3, spread=0.02):
    """Clusters of unequal size, one with a third of the rows, copies and repeated ids among them."""
    random = np.random.default_rng(seed)
    centres = random.normal(size=(20, 16))
    at = np.where(random.random(n) < 0.33, 0, random.integers(0, 20, n))
    x = (centres[at] + spread * random.normal(size=(n, 16))).astype(np.float32)
    x[at == 0] = x[at == 0][0]
    return x, at


def test_search_finds_all(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "BLOCK_ROWS", 64)
    monkeypatch.setattr(pivot_search, "FIRST_ROWS", 64)
    monkeypatch.setattr(pivot_search, "GROUP_QUERIES", 7)
    x, _ = clustered(1500)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(40, x[3].tolist(), 0), (7, x[7].tolist(), 0), (-20, (-x[5]).tolist(), 1)]
    found = pivot_search.search(spark.createDataFrame(rows, SHAPE), "id % 20 = 0")
    assert found_rows(found) == plain_search([(i, v) for i, v, _ in rows], 5, 20)


def test_bounds_hold_and_close_annuli():
    x, _ = clustered(4000)
    x = np.floor(256 * x.astype(float))
    sample = pa.table({"vector": pa.array(x[::2].astype(np.int64).tolist())})
    index = pivot_search._loaded(pivot_search.fit(sample, 16))
    cell, distance = index.keys(x)
    norm = (x * x).sum(axis=1)
    found = [{"cell": c, "low": distance[cell == c].min(), "high": distance[cell == c].max(), "norm": norm[cell == c].max(), "n": (cell == c).sum()} for c in np.unique(cell)]
    index.counted(found)
    q = x[::40]
    scores = q @ x.T
    assert (scores <= index.bounds(q)[:, cell]).all()
    least = np.sort(scores, axis=1)[:, -6]
    opened = [index.rows[c].sum() for c in pivot_search.open_cells(index, q, least.astype(float), False)]
    assert np.mean(opened) < 0.5 * len(x)  # clusters: most annuli stay closed


def test_products_are_exact():
    big = np.array([[1 << 29, 3], [-(1 << 29), 5]])
    assert vectors.products(big, big).tolist() == [[(1 << 58) + 9, 15 - (1 << 58)], [15 - (1 << 58), (1 << 58) + 25]]
    with pytest.raises(OverflowError):
        vectors.products(big << 10, big << 10)


ODD = [(0, [1.0, 0.5], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 2), (4, [float("inf"), 0.0], 2), (5, [0.0, 0.0], 2), (6, [1.0], 2), (7, [], 2), (None, [1.0, 1.0], 2), (8, [0.5, 0.25], 1), (8, [0.5, 0.25], 1), (9, [0.5, 0.25], None), (10, [0.3, 0.2], 2), (11, [0.3, 0.2], 2)]


def odd_rows(spark):
    df = spark.createDataFrame(ODD, SHAPE)
    for i, _ in enumerate(("id", "vector", "score", "rank", "EMBEDDING", "cell", "row")):
        df = df.withColumn(f"x{i}", F.lit(1))
    return df.toDF("vec_id", "embedding", "label", "id", "vector", "score", "rank", "EMBEDDING", "cell", "row")


def test_search_of_odd_rows(spark):
    found = found_rows(pivot_search.search(odd_rows(spark), "id = 0", k=9))
    assert found == [(0, 1, 8, 40960), (0, 2, 8, 40960), (0, 3, 9, 40960), (0, 4, 10, 25984), (0, 5, 11, 25984), (0, 6, 5, 0)]
    assert pivot_search.search(spark.createDataFrame([], SHAPE), "id = 0").collect() == []
    large = spark.createDataFrame([(0, [1e30], 1), (1, [1.0], 1)], SHAPE)
    with pytest.raises(Exception, match="too large"):
        pivot_search.search(large, "id = 0").collect()


def plain_negatives(rows, every, k, n, low, high):
    held = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int), y) for i, v, y in rows]
    out = []
    for a, x, label in held:
        if a % every == 0:
            scored = sorted((-int(v @ x), i, y) for i, v, y in held)
            for p, i, _ in [s for s in scored if s[2] == label and s[1] != a][:k]:
                kept = [(s, j) for s, j, y in scored if y != label and low * -p <= 100 * -s <= high * -p][:n]
                out += [(a, i, r + 1, j, -p, -s) for r, (s, j) in enumerate(kept)]
    return sorted(out)


@pytest.mark.parametrize("parts", [64, 3])
def test_negatives_in_many_tiles(spark, monkeypatch, parts):
    for name, value in (("TILE_ROWS", 50), ("TILE_ANCHORS", 4), ("CHUNK", 5), ("PARTS", parts)):
        monkeypatch.setattr(hard_negatives, name, value)
    x, at = clustered(600, spread=0.3)
    rows = [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, at))]
    found = hard_negatives.mine(spark.createDataFrame(rows, SHAPE), "id % 30 = 0", 4, 6, 10, 80)
    want = plain_negatives(rows, 30, 4, 6, 10, 80)
    assert found_rows(found) == want and len(want) > 100


def test_negatives_of_odd_rows(spark):
    found = found_rows(hard_negatives.mine(odd_rows(spark), "id % 4 = 0", low=0, high=100))
    # Row 8 stands twice: one of it asks, and both are positives of row 0.
    assert [r for r in found if r[0] == 0] == [(0, 8, r, i, 40960, s) for r, i, s in ((1, 10, 25984), (2, 11, 25984), (3, 5, 0)) for _ in range(2)]
    assert {r[0] for r in found} == {0, 8} and hard_negatives.mine(odd_rows(spark), "id = 99").collect() == []
    assert hard_negatives.mine(spark.createDataFrame([], SHAPE), "id = 0").collect() == []
