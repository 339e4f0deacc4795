"""Whitening against eigenvectors of the covariance, mining against brute force and SQL, both on rows out of the ordinary."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import duck, spark_rows
from trajecta.llm import mining, queries, whitening

ROWS = "vec_id long, embedding array<float>, label int, v int, w int, n int, score int"


def eigen(x):
    """(n*n times squared distances, whitened, explained) of whole numbers, by the covariance matrix."""
    n, total = len(x), x.sum(axis=0)
    away = n * x - total
    c = away / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:8]
    return (away.astype(object) ** 2).sum(axis=1), c @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_equals_eigenvectors(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").toPandas().sort_values("vec_id")
    squares, whitened, explained = eigen(np.floor(1024 * np.stack(table.embedding).astype(float)).astype(np.int64) + 100_000)
    got = queries.QUERIES["op11_whitening"](spark, data).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 8 * len(table) and set(got.n) == {len(table)} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    assert (got.deviation.to_numpy().reshape(-1, 8) == squares[:, None]).all()
    own = got.whitened.to_numpy().reshape(-1, 8)
    sign = np.sign((own * whitened).sum(axis=0))
    assert np.abs(own * sign - whitened).max() < 1e-9 and np.abs(got.explained.to_numpy()[:8] - explained).max() < 1e-12


def test_small_deviations_keep_their_accuracy():
    rng = np.random.default_rng(3)
    scales = 10.0 ** -np.arange(0, 14, 2)
    a = np.linalg.qr(rng.normal(size=(40, 7)))[0] * scales
    lengths, v = whitening.jacobi(np.linalg.qr(a, mode="r"))
    assert np.abs(lengths / scales - 1).max() < 1e-9
    assert np.abs(v.T @ v - np.eye(7)).max() < 1e-13


@pytest.mark.parametrize("d", [1, 2, 3, 8, 9])
def test_every_two_columns_meet_once(d):
    met = sorted((min(a, b), max(a, b)) for i, j in whitening.pairings(d) for a, b in zip(i.tolist(), j.tolist(), strict=True))
    assert met == [(a, b) for a in range(d) for b in range(a + 1, d)]
    assert all(len({*i.tolist(), *j.tolist()}) == 2 * len(i) for i, j in whitening.pairings(d))


def test_whitening_of_rows_out_of_the_ordinary(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0, -3.0], [0.5, 0.25, 8.0], [0.5, 0.25, 8.0], [-1.0, 7.0, 0.0], [3.0, -2.0, 1.0]]
    rows = [(k // 2, v, None, 1, 2, 3, 4) for k, v in enumerate(vectors)] + [(None, [2.0, 2.0, 2.0], 1, 1, 1, 1, 1)]
    odd = [(90, None, 1, 1, 1, 1, 1), (91, [1.0, None, 2.0], 1, 1, 1, 1, 1), (92, [nan, 0.0, 0.0], 1, 1, 1, 1, 1), (93, [inf, 0.0, 0.0], 1, 1, 1, 1, 1), (94, [1.0, 2.0], 1, 1, 1, 1, 1), (95, [], 1, 1, 1, 1, 1)]
    got = whitening.whiten(spark.createDataFrame(rows + odd, ROWS).repartition(4)).toPandas()
    squares, whitened, _ = eigen(np.floor(1024 * np.array([r[1] for r in rows])).astype(np.int64) + 100_000)
    assert len(got) == 18 and set(got.n) == {6}
    assert sorted(got[got.component == 1].deviation) == sorted(squares)
    assert np.allclose(sorted(np.abs(got[got.component == 3].whitened)), sorted(np.abs(whitened[:, 2])), atol=1e-9)
    assert got.vec_id.isna().sum() == 3
    assert whitening.whiten(spark.createDataFrame(rows[:0], ROWS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([rows[1]] * 5, ROWS)).count() == 0  # no variance at all
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0], 1, 1, 1, 1, 1) for k in range(9)], ROWS)
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}


def test_whitening_where_numbers_do_not_fit_a_long(spark):
    rows = [(k, [float(3.0e38 if k == 0 else k), float(k * k)], 1, 1, 1, 1, 1) for k in range(9)]
    got = {r["vec_id"]: r for r in whitening.whiten(spark.createDataFrame(rows, ROWS)).where("component = 1").collect()}
    x = np.array([[(1 << 63) - 1 if k == 0 else 1024 * k, 1024 * k * k] for k in range(9)], object) + 100_000
    squares = ((9 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert {k: r["deviation"] for k, r in got.items()} == {k: None if s >= 1 << 63 else s for k, s in enumerate(squares)}
    exact = [(k, [float(k * 200_000_000), 1.0 * k], 1, 1, 1, 1, 1) for k in range(4)]
    x = np.array([[1024 * k * 200_000_000, 1024 * k] for k in range(4)], object)
    squares = ((4 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert [r["deviation"] for r in whitening.whiten(spark.createDataFrame(exact, ROWS)).where("component = 1").orderBy("vec_id").collect()] == [None if s >= 1 << 63 else s for s in squares]


def brute(rows, is_anchor, scale=256, k=5, low=80):
    """hard_negatives() by looking at every row for every anchor."""
    kept = {}
    for i, label, vector in rows:
        if None not in (i, label, vector) and all(x is not None and np.isfinite(x) for x in vector):
            own = (label, [int(np.floor(float(np.float32(x)) * scale)) for x in vector])
            kept[i] = min(kept.get(i, own), own)
    out = []
    for a, (label, vector) in kept.items():
        if is_anchor(a):
            others = sorted((-sum(x * y for x, y in zip(vector, v, strict=True)), i, own) for i, (own, v) in kept.items() if i != a and len(v) == len(vector))
            for s, p, _ in [o for o in others if o[2] == label][:k]:
                fits = [o for o in others if o[2] != label and low * -s <= 100 * -o[0] <= 100 * -s][:k]
                out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(rows, is_anchor="vec_id % 10 = 0", **more):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in mining.hard_negatives(rows, F.expr(is_anchor), **more).select(names).collect())


def test_mining_equals_sql(spark, data):
    assert spark_rows(queries.QUERIES["op12_negatives"](spark, data)) == duck(data, queries.ORACLES["op12_negatives"])


@pytest.mark.parametrize(("seed", "spread", "buckets"), [(1, 1.0, 1 << 21), (2, 0.02, 1 << 21), (3, 1.0, 8), (4, 0.004, 64)])
def test_mining_equals_brute_force(spark, monkeypatch, seed, spread, buckets):
    # few different values give many ties; few buckets make it take many digits, and few rows that are enough many ids
    monkeypatch.setattr(mining, "BUCKETS", buckets)
    monkeypatch.setattr(mining, "ENOUGH", 6)
    rng = np.random.default_rng(seed)
    rows = [(int(k), int(rng.integers(3)), [float(x) for x in np.round(rng.normal(size=6) * spread + 0.1, 3)]) for k in rng.permutation(150)]
    assert mined(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)) == brute(rows, lambda a: a % 10 == 0)


def test_mining_where_a_third_of_all_rows_are_equal(spark):
    rows = [(k, k % 2, [1.0, 0.5] if k % 3 else [0.9, 0.02 * (k % 40)]) for k in range(900)]
    found = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    assert mined(found, "vec_id % 100 = 0") == brute(rows, lambda a: a % 100 == 0)


def test_mining_of_several_groups_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(mining, "MOST_ANCHORS", 8)
    rng = np.random.default_rng(9)
    rows = [(k, int(rng.integers(2)), [float(x) for x in rng.normal(size=4) + 1]) for k in range(120)]
    assert mined(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")) == brute(rows, lambda a: a % 10 == 0)


def test_mining_of_rows_out_of_the_ordinary(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (1, 0, [1.0, 0.9]), (2, 2, [1.0, 0.9]), (3, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (4, 2, None), (5, 2, [1.0, None]), (6, 2, [nan, 1.0]), (7, 2, [inf, 1.0]), (8, 2, [1.0]), (9, 2, []), (0, 1, [1.0, 1.0]), (10, 2, []), (-(2**63), 1, [1.0, 1.0]), (2**63 - 1, 2, [0.95, 0.95]), (11, 1, [-1.0, -1.0])]
    found = spark.createDataFrame([(i, v, label, 1, 2, 3, 4) for i, label, v in rows], ROWS).repartition(4)
    assert mined(found) == brute(rows, lambda a: a % 10 == 0)
    assert mined(found, "false") == [] and mined(found.limit(0)) == []
    assert mined(found.where("label = 1")) == []


def test_mining_of_entries_that_do_not_fit(spark):
    rows = [(0, 1, [1.0e9, 1.0]), (1, 1, [1.0e9, 2.0]), (2, 2, [0.9e9, 3.0]), (3, 2, [1.0e38, 0.0]), (10, 1, [3.0e38, 0.0])]
    assert [r[:4] for r in mined(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), "vec_id = 0")] == [(0, 1, 1, 2), (0, 1, 2, 3), (0, 10, 1, 2), (0, 10, 2, 3)]  # all scores are at the bound
    exact = [(k, k % 2, [3.0e6 + 1000 * k, 1.0]) for k in range(30)]
    assert mined(spark.createDataFrame(exact, "vec_id long, label int, embedding array<float>")) == brute(exact, lambda a: a % 10 == 0)
