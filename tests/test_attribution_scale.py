"""Tabulated contributions equal those worked out leaf by leaf, whatever the tables hold."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlens.operators import boosting as B
from cohortlens.operators import explain as X


def grown(k=10, n=3000, rounds=4, seed=0, **settings):
    r = np.random.default_rng(seed)
    x = r.integers(0, 6, (n, k)).astype(np.uint8)
    x[:, 1] = x[:, 0] > 2
    y = (r.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 2.5) - np.sin(x[:, 1:].sum(1))))).astype(np.uint8)
    edges = [np.array([0.5])if j == 1 else np.arange(5) + 0.5 for j in range(k)]
    trees, _ = B.boost_here(B.Block(x, y, np.zeros(n, bool), r.integers(0, 2**63, n).astype(np.uint64), np.zeros(n)), edges, 0.3,
                            B.Settings(rounds=rounds, least_rows=3, **settings))
    return B.Forest.of(trees, 0.3, k), x.astype(float)


def by_leaf(forest, x):
    """The same sums, one leaf at a time, from paths that are followed anew."""
    out = np.zeros((len(x), forest.columns))
    for k in range(len(forest)):
        t = forest.tree(k)
        todo = [(0, {})]
        while todo:
            node, path = todo.pop()
            c = int(t["column"][node])
            if c >= 0:
                ok, share = path.get(c, (np.ones(len(x), bool), 1.0))
                left = x[:, c] <= t["threshold"][node]
                for child, side in ((t["left"][node], left), (t["right"][node], ~left)):
                    todo.append((int(child), {**path, c: (ok & side, share * t["rows"][child] / t["rows"][node])}))
                continue
            u, w = np.polynomial.legendre.leggauss(len(path) // 2 + 1)
            u = (u + 1) / 2
            for i in path:
                rest = np.ones((len(x), len(u)))
                for j, (ok, z) in path.items():
                    if j != i:
                        rest *= z * (1 - u) + np.outer(ok, u)
                ok, z = path[i]
                out[:, i] += t["value"][node] * (ok - z) * (rest * w / 2).sum(1)
    return out


@pytest.mark.parametrize("states", [1, 8, 100, 4096])
@pytest.mark.parametrize("settings", [{"leaves": 0, "depth": 5}, {"leaves": 40, "depth": 0}, {"leaves": 2}])
def test_tables_hold_the_sums_of_their_leaves(monkeypatch, states, settings):
    monkeypatch.setattr(B, "STATES", states)
    monkeypatch.setattr(B, "LOOKED_UP", 70)
    forest, x = grown(**settings)
    beyond = np.concatenate([x[:200], x[:5] - 100, x[:5] + 100])
    got = forest.contributions(beyond)
    assert np.allclose(got, by_leaf(forest, beyond), atol=1e-12)
    assert np.allclose(got.sum(1) + forest.expected(), forest.margin(beyond), atol=1e-12)
    assert forest.contributions(beyond[:0]).shape == (0, forest.columns) and np.allclose(forest.contributions(beyond[7:8]), got[7], atol=1e-14)


def test_branches_share_tables():
    """A tree over few intervals is looked up once, not leaf by leaf."""
    forest, _ = grown(k=4, leaves=30)
    cuts = [np.unique(forest.threshold[forest.column == c]) for c in range(4)]
    for k in range(len(forest)):
        groups = list(B.leaf_groups(forest.tree(k), cuts))
        assert len(groups) == 1 and len(groups[0]) == (forest.tree(k)["column"] < 0).sum()


def test_attribution_takes_many_batches_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(X, "BATCH_ROWS", 37)
    forest, x = grown(k=5, leaves=12)
    df = spark.createDataFrame(pd.DataFrame({"row_id": [f"r{i}" for i in range(500)], "x": x[:500].tolist()})).repartition(3).withColumn("features", array_to_vector("x"))
    calls = spark.sparkContext.accumulator(0)
    plain = B.Forest.contributions

    def counted(self, rows):
        calls.add(1)
        return plain(self, rows)

    monkeypatch.setattr(X, "Forest", type("Counted", (B.Forest,), {"contributions": counted}))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        out = X.attribution(PipelineModel([B.HistBoosterModel.of(forest)]), df)
        assert [(f.name, f.dataType.simpleString()) for f in out.schema.fields] == [("row_id", "string"), ("contributions", "array<double>"), ("expected", "double")]
        got = {r["row_id"]: r["contributions"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert calls.value <= 3 and len(got) == 500
    want = by_leaf(forest, x[:500])
    assert all(np.allclose(got[f"r{i}"], want[i], atol=1e-12) for i in range(500))
    assert X.attribution(PipelineModel([B.HistBoosterModel.of(forest)]), df.where(F.lit(False))).count() == 0
