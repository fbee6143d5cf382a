"""The search uses idle cores, scores rows once, and counts columns of one source together."""

from __future__ import annotations

import itertools
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import boosting as B
from cohortlens.operators import encoders as E
from cohortlens.operators import models as M


@pytest.fixture(scope="module")
def train(spark):
    r = np.random.default_rng(2)
    g, x = r.integers(0, 30, 600), r.normal(size=600)
    return spark.createDataFrame(pd.DataFrame({"row_id": range(600), "g": [f"g{i}" for i in g], "x": x, "seg": r.choice(list("ABC"), 600),
                                               "y": (r.random(600) < 1 / (1 + np.exp(-x - np.sin(g)))).astype(int)})).persist()


def test_blind_trials_are_fitted_together_and_scores_are_written_once(train, monkeypatch):
    meet, calls, plans = threading.Barrier(4, timeout=30), itertools.count(), []

    def boost(*args):
        if next(calls) < 4:
            meet.wait()  # four fits before any has ended
        return B.boost(*args)

    def roc_auc(scores, **kw):
        plans.append(scores._jdf.queryExecution().executedPlan().toString())
        return judged(scores, **kw)

    judged = M.roc_auc
    monkeypatch.setattr(M, "boost", boost)
    monkeypatch.setattr(M, "roc_auc", roc_auc)
    space = {"rate": (0.05, 0.3, "log"), "depth": (1, 4, "int")}
    found = M.tune(train, ["x", "seg", "g"], "g", trials=6, folds=2, space=space, kinds={"numeric": ["x"], "low": ["seg"], "high": ["g"]}, most_rounds=8)
    assert sorted(r["trial"] for r in found.history.collect()) == list(range(1, 7))
    assert len(plans) == 2 and not any("Python" in p for p in plans)  # the model is not run for each pass over the scores


def test_draws_are_blind_while_few_trials_are_told():
    one, many = M.DensityRatioSampler(), M.DensityRatioSampler()
    ahead = [many.ask() for _ in range(many.blind)]
    behind = []
    for k in range(5):
        behind.append(one.ask())
        one.tell(behind[-1], k / 10)
    assert ahead == behind and len(ahead) == 5 and one.blind == 1


def test_encoding_formula_is_compiled(train):
    """Methods above 8000 bytes are interpreted by the JVM, row by row."""
    table = E.crossfit_table(train, {"g": "g"}, "y", F.pmod("row_id", F.lit(5)).cast("int"), 5)
    table.collect()
    parts = train.sparkSession._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(table._jdf.queryExecution().executedPlan())
    sizes = [parts.apply(k)._3().maxMethodCodeSize() for k in range(parts.size())]
    assert sizes and max(sizes) < 8000


def test_cells_that_no_row_lies_in_are_not_counted():
    r = np.random.default_rng(3)
    level, group = r.integers(0, 6, 50_000), r.integers(0, 100, 50_000)
    binned = np.column_stack([*[level == k for k in range(6)], group, group // 10]).astype(np.uint8)
    bundles = B.Bundles(binned, [*[np.zeros(1)] * 6, np.arange(99.0), np.arange(9.0)])
    assert sum(n for _, n, _, _ in bundles.drawn(np.arange(8))) <= 600  # levels times groups


def test_small_nodes_are_counted_in_one_go_and_large_ones_in_pieces(monkeypatch):
    monkeypatch.setattr(B, "TOGETHER", 10)
    monkeypatch.setattr(B, "PACKED", 16)
    parts = [np.arange(n) for n in (3, 4, 5, 40, 0, 9, 1, 11)]
    got = {}
    for first, last, r in B.batches(parts):
        assert len(r) <= 16
        got.setdefault((first, last), []).append(r)
    assert sorted(got) == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 8)]
    assert all((np.concatenate(v) == np.concatenate(parts[a:b])).all() for (a, b), v in got.items())


def test_sums_are_exact_at_the_largest_hessians(monkeypatch):
    """Every hessian is a quarter in the first round; nodes above and below one piece, same trees as with small pieces."""
    r = np.random.default_rng(4)
    n = 140_000
    x = r.integers(0, 50, (n, 3)).astype(np.uint8)
    y = np.r_[np.zeros(n // 2), np.ones(n // 2)].astype(np.uint8)
    block = B.Block(x, y, np.zeros(n, bool), r.integers(0, 2**63, n).astype(np.uint64), np.zeros(n))
    s = B.Settings(rounds=3, leaves=9, least_rows=5)
    edges = [np.arange(49.0)] * 3
    one, _ = B.boost_here(block, edges, 0.0, s)
    root = B.histogram(x.astype(np.int64), B.weighed(np.zeros(n), y, np.ones(n, bool)))
    assert root[0].sum(0).tolist() == [0.0, n * 2.0**18, n] and one[0]["rows"][0] == n
    monkeypatch.setattr(B, "TOGETHER", 300)
    monkeypatch.setattr(B, "PACKED", 1000)
    many, _ = B.boost_here(block, edges, 0.0, s)
    assert all((a[k] == b[k]).all() for a, b in zip(one, many) for k in a)
