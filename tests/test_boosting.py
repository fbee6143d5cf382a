"""Boosted trees against plain versions: splits, layouts, stopping, attributions."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlens.operators import boosting as B


def data(spark, n=600, k=5, seed=0, slices=6):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, k)), 1)
    y = (r.random(n) < 1 / (1 + np.exp(-1.5 * x[:, 0] - x[:, 1] * x[:, 2]))).astype(int)
    pdf = pd.DataFrame({"row_id": range(n), "y": y, "x": x.tolist(), "held": r.random(n) < 0.2})
    df = spark.createDataFrame(pdf).repartition(slices).withColumn("features", array_to_vector("x"))
    return df, x, y, pdf["held"].to_numpy()


def plain_tree(x, g, h, s: B.Settings):
    """Leaf-wise growth over all thresholds between values; returns {row: leaf value}."""
    def best(rows):
        found = None
        G, H = g[rows].sum(), h[rows].sum()
        for j in range(x.shape[1]):
            u = np.unique(x[:, j])
            for t in (u[:-1] + u[1:]) / 2:
                left = x[rows, j] <= t
                if min(left.sum(), (~left).sum()) < s.least_rows:
                    continue
                a, b = g[rows][left].sum(), h[rows][left].sum()
                gain = a * a / (b + s.l2) + (G - a) ** 2 / (H - b + s.l2) - G * G / (H + s.l2)
                if gain > s.least_gain and (found is None or gain > found[0] + 1e-12):
                    found = (gain, j, t)
        return found

    leaves = [np.arange(len(x))]
    while len(leaves) < s.leaves:
        options = [(b[0], k, b) for k, rows in enumerate(leaves) if (b := best(rows))]
        if not options:
            break
        _, k, (_, j, t) = max(options, key=lambda o: o[0])
        rows = leaves.pop(k)
        leaves += [rows[x[rows, j] <= t], rows[x[rows, j] > t]]
    value = np.zeros(len(x))
    for rows in leaves:
        value[rows] = -s.rate * g[rows].sum() / (h[rows].sum() + s.l2)
    return value


def test_trees_equal_a_plain_version(spark):
    df, x, y, _ = data(spark, 300, 4)
    s = B.Settings(rounds=4, rate=0.3, leaves=6, least_rows=15, l2=2.0)
    forest, _ = B.fit_forest(df, s)
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for _ in range(4):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + plain_tree(x, p - y, p * (1 - p), s)
    assert np.allclose(forest.margin(x), margin, atol=1e-4)


@pytest.mark.parametrize("s", [B.Settings(rounds=5, leaves=9, least_rows=10), B.Settings(rounds=4, leaves=0, depth=3, least_rows=1, least_hessian=4.0, l1=0.5, row_share=0.7, column_share=0.6),
                               B.Settings(rounds=30, rate=0.6, leaves=8, least_rows=5, patience=3)])
def test_same_trees_on_any_layout(spark, monkeypatch, s):
    """One task, or one aggregate per batch of leaves over many blocks; sums are exact in both."""
    monkeypatch.setattr(B, "TREES_A_STAGE", 2)
    df, x, _, _ = data(spark, 500)
    held = "held" if s.patience else None
    one, curve = B.fit_forest(df, s, held=held)
    monkeypatch.setattr(B, "BLOCK_BYTES", 200)
    many, curve2 = B.fit_forest(df.repartition(11), s, held=held, one_task_bytes=0)
    assert len(one) == len(many) and len(one) > 1 and np.allclose(curve, curve2, atol=1e-12)
    for name in ("column", "threshold", "left", "right", "rows"):
        assert (getattr(one, name) == getattr(many, name)).all()
    assert np.allclose(one.value, many.value, atol=1e-12) and np.allclose(one.margin(x), many.margin(x), atol=1e-12)


def test_columns_with_few_bins_are_counted_together():
    """Sums by joint cells equal those counted column by column."""
    r = np.random.default_rng(1)
    sizes = [200, 2, 7, 1, 30, 2, 2]
    binned = np.stack([r.integers(0, n, 40_000) for n in sizes], 1).astype(np.uint8)
    bundles = B.Bundles(binned, [np.arange(n - 1.0) for n in sizes])
    assert len(bundles.codes) < len(sizes) and sorted(j for b in bundles.columns for j in b) == list(range(len(sizes)))
    w = r.integers(-1000, 1000, (40_000, 3)).astype(float)
    columns, expected = np.array([0, 2, 5, 6]), B.histogram(binned.astype(np.int64), w)
    out = np.zeros((3, len(columns) * 256))
    for code, n, at, made_of in bundles.drawn(columns):
        cells = np.stack([np.bincount(code, w[:, k], n) for k in range(3)])
        out[:, at] = cells if made_of is None else cells @ made_of
    assert (out.reshape(3, 4, 256).transpose(1, 2, 0) == expected[columns]).all()


def test_rounds_are_kept_at_the_minimum_of_the_curve(spark):
    df, x, y, held = data(spark, 900, seed=3)
    s = B.Settings(rounds=300, rate=0.3, leaves=31, least_rows=5, patience=12)
    forest, curve = B.fit_forest(df, s, held="held")
    assert 1 < len(forest) == int(np.argmin(curve)) and len(curve) - 1 == len(forest) + 12 < 300
    m = forest.margin(x[held])
    assert curve[len(forest)] == pytest.approx((np.logaddexp(0, m) - y[held] * m).mean(), abs=1e-5)


def test_limits_hold(spark):
    df, x, y, _ = data(spark, 800, seed=4)
    forest, _ = B.fit_forest(df, B.Settings(rounds=6, leaves=7, depth=3, least_rows=40))
    for k in range(len(forest)):
        t = forest.tree(k)
        leaf = t["column"] < 0
        assert leaf.sum() <= 7 and t["rows"][leaf].min() >= 40 and t["rows"][0] == 800
    small, _ = B.fit_forest(df, B.Settings(rounds=6, leaves=7, least_rows=40, l1=5.0, l2=50.0))
    assert np.abs(small.value).sum() < np.abs(forest.value).sum()


def test_contributions_are_exact_shapley_values(spark):
    df, x, _, _ = data(spark, 400, 8, seed=5)
    forest, _ = B.fit_forest(df, B.Settings(rounds=5, leaves=12, least_rows=8))
    rows = x[:12]

    def conditional(t, row, known, k=0):
        c = int(t["column"][k])
        if c < 0:
            return t["value"][k]
        a, b = int(t["left"][k]), int(t["right"][k])
        if c in known:
            return conditional(t, row, known, a if row[c] <= t["threshold"][k] else b)
        return (t["rows"][a] * conditional(t, row, known, a) + t["rows"][b] * conditional(t, row, known, b)) / t["rows"][k]

    got = forest.contributions(rows)
    for i, row in enumerate(rows):
        worth = {c: sum(conditional(forest.tree(k), row, set(c)) for k in range(len(forest)))
                 for n in range(9) for c in itertools.combinations(range(8), n)}
        for j in range(8):
            want = sum(math.factorial(len(c)) * math.factorial(7 - len(c)) / math.factorial(8) * (worth[tuple(sorted((*c, j)))] - v) for c, v in worth.items() if j not in c)
            assert got[i, j] == pytest.approx(want, abs=1e-10)
    assert np.allclose(got.sum(1) + forest.expected(), forest.margin(rows), atol=1e-9)


def test_estimator_adds_probabilities_and_survives_storage(spark, tmp_path):
    df, x, y, _ = data(spark, 500)
    model = B.HistBooster(settings=B.Settings(rounds=10, least_rows=10)).fit(df)
    model.save(str(tmp_path / "m"))
    again = B.HistBoosterModel.load(str(tmp_path / "m"))
    a, b = ({r.row_id: (r.margin, r.probability[1]) for r in m.transform(df).collect()} for m in (model, again))
    assert a == b
    margins = model.forest.margin(x)
    assert all(a[k][0] == pytest.approx(margins[k]) and a[k][1] == pytest.approx(1 / (1 + math.exp(-margins[k]))) for k in range(500))
    shares = model.featureImportances.toArray()
    assert shares.sum() == pytest.approx(1) and shares.argmax() == 0


def test_awkward_tables(spark):
    df, *_ = data(spark, 60)
    one_class = df.withColumn("y", F.lit(1))
    assert len(B.fit_forest(one_class, B.Settings())[0]) == 0
    empty, _ = B.fit_forest(df.limit(0), B.Settings())
    assert len(empty) == 0 and empty.base == 0
    flat = df.withColumn("features", array_to_vector(F.array(F.lit(1.0), F.lit(2.0))))
    forest, _ = B.fit_forest(flat, B.Settings(rounds=2, least_rows=1))
    assert (forest.column < 0).all()
