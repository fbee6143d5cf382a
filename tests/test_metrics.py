from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import bootstrap as B
from cohortlens.operators import metrics as K
from conftest import rows


def sample(n=600, seed=5):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.clip(np.round(0.4 * y + rng.uniform(0, 0.6, n), 2), 0, 1)
    return pd.DataFrame({"row_id": range(n), "model": "A", "y": y, "p": p})


def pair_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())


@pytest.fixture(scope="module")
def scored(spark):
    pdf = sample()
    return pdf, spark.createDataFrame(pdf).persist()


@pytest.mark.parametrize("size", [20, 10**6])
def test_auc_equals_counting_pairs(scored, size):
    pdf, df = scored
    got = K.roc_auc(df, rows_per_bucket=size).first()["roc_auc"]
    assert got == pytest.approx(pair_auc(pdf["y"].to_numpy(), pdf["p"].to_numpy()), abs=1e-12)


def test_average_precision_by_definition(scored):
    pdf, df = scored
    total, previous, want = pdf["y"].sum(), 0.0, 0.0
    for t in sorted(pdf["p"].unique(), reverse=True):
        hit = pdf[pdf["p"] >= t]["y"]
        recall = hit.sum() / total
        want += (recall - previous) * hit.mean()
        previous = recall
    assert K.pr_auc(df, rows_per_bucket=20).first()["pr_auc"] == pytest.approx(want, abs=1e-12)


def test_panel_against_plain_counts(scored):
    pdf, df = scored
    got = K.metric_panel(df, rows_per_bucket=50).first().asDict()
    y, p = pdf["y"].to_numpy(), pdf["p"].to_numpy()
    lifts = {t: (p[y == 1] >= t).mean() - (p[y == 0] >= t).mean() for t in np.unique(p)}
    top = max(lifts.values())
    best = max(t for t, v in lifts.items() if abs(v - top) < 1e-12)
    assert got["ks"] == pytest.approx(top) and got["threshold"] == best
    hit = p >= best
    tp, fp, fn, tn = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum(), (~hit & (y == 0)).sum()
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (tp, fp, fn, tn)
    assert got["brier"] == pytest.approx(((p - y) ** 2).mean())
    q = np.clip(p, 1e-6, 1 - 1e-6)
    assert got["log_loss"] == pytest.approx(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())
    mcc = (tp * tn - fp * fn) / math.sqrt(float(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    assert got["mcc"] == pytest.approx(mcc) and got["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))
    assert list(got) == ["model", *K.PANEL]


def test_fixed_threshold_agrees_with_confusion(scored):
    _, df = scored
    panel = K.metric_panel(df, threshold=0.505).first().asDict()
    plain = K.confusion(df, 0.505).first().asDict()
    assert all(panel[c] == pytest.approx(plain[c]) for c in plain if c != "model")
    nobody = K.metric_panel(df, threshold=2.0).first()
    assert (nobody["tp"], nobody["fp"], nobody["precision"], nobody["mcc"]) == (0, 0, 0.0, 0.0)


def test_constant_scores_have_an_infinite_threshold(spark):
    df = spark.createDataFrame([("base", i % 3 == 0, 0.4) for i in range(30)], "model string, t boolean, p double").withColumn("y", F.col("t").cast("int"))
    row = K.metric_panel(df).first()
    assert row["roc_auc"] == 0.5 and row["ks"] == 0.0 and row["threshold"] == math.inf and row["tp"] == 0
    assert K.youden_threshold(df).first()["threshold"] == math.inf


def test_curve_starts_at_the_origin_and_ends_at_one(scored):
    curve = rows(K.roc_curve_table(scored[1]), "threshold")
    assert {(r["fpr"], r["tpr"]) for r in curve if math.isinf(r["threshold"])} == {(0.0, 0.0)}
    last = min(curve, key=lambda r: r["threshold"])
    assert (last["fpr"], last["tpr"]) == (1.0, 1.0)


def test_calibration_bins_cover_all_rows(scored):
    pdf, df = scored
    table = K.calibration_table(df, bins=5).toPandas()
    edges = np.quantile(pdf["p"], [0.2, 0.4, 0.6, 0.8])
    want = pdf.groupby(np.searchsorted(edges, pdf["p"]))["y"].mean()
    np.testing.assert_allclose(table.sort_values("bin")["observed_rate"], want.to_numpy())
    assert table["n"].sum() == len(pdf)


def test_strata_leave_out_small_and_one_class_parts(spark):
    pdf = sample(400)
    pdf["stratum"] = np.where(pdf.index < 300, "large", np.where(pdf.index < 310, "small", "one class"))
    pdf.loc[pdf["stratum"] == "one class", "y"] = 1
    got = {r["stratum"]: r for r in K.panel_by_stratum(spark.createDataFrame(pdf), min_n=50).collect()}
    assert set(got) == {"large", K.TOTAL}
    big = pdf[pdf["stratum"] == "large"]
    assert got["large"]["roc_auc"] == pytest.approx(pair_auc(big["y"].to_numpy(), big["p"].to_numpy()))
    assert got[K.TOTAL]["n"] == 400


def test_raw_scores_are_never_gathered_in_one_task(scored):
    edges = K.quantile_edges(scored[1], "p", 50)
    plan = K.panel_from_cells(K.score_cells(scored[1]), ["model"], edges)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("n", [1, 2, 16, 17, 1000, (1 << 20) + 5, 3 << 20])
def test_poisson_weights_are_exact_for_every_count(n):
    size = 200_000
    w = B.poisson_sums(np.full(size, n), np.random.default_rng(n).integers(0, 2**63, size).astype(np.uint64))
    assert w.mean() == pytest.approx(n, abs=5 * math.sqrt(n / size))
    assert w.var() == pytest.approx(n, abs=5 * math.sqrt((n + 2 * n * n) / size))
    if n <= 1000:  # each value as often as it should be, tails included
        x = np.arange(int(n + 6 * math.sqrt(n) + 6))
        p = np.exp(x * math.log(n) - n - np.array([math.lgamma(k + 1) for k in x]))
        found = np.bincount(w.astype(int), minlength=len(x))[:len(x)] / size
        assert (np.abs(found - p) <= 5 * np.sqrt(p / size) + 5 / size).all()


def test_poisson_weights_depend_on_their_keys_only(spark):
    df = spark.range(5000).select("id", B.poisson_draw(F.lit(7), F.lit(1), F.col("id")).alias("w"))
    assert rows(df, "id") == rows(df.repartition(13), "id")
    mean, var = df.agg(F.avg("w"), F.var_pop("w")).first()
    assert mean == pytest.approx(7, abs=0.2) and var == pytest.approx(7, abs=0.8)


def test_bootstrap_interval_matches_resampling(scored):
    pdf, df = scored
    row = B.bootstrap_ci(df, reps=300).first()
    y, p = pdf["y"].to_numpy(), pdf["p"].to_numpy()
    assert row["roc_auc"] == pytest.approx(pair_auc(y, p), abs=1e-9)
    rng = np.random.default_rng(0)
    sims = [pair_auc(y[i], p[i]) for i in (rng.integers(0, len(y), len(y)) for _ in range(300))]
    lo, hi = np.percentile(sims, [2.5, 97.5])
    assert row["ci_lower"] == pytest.approx(lo, abs=0.012) and row["ci_upper"] == pytest.approx(hi, abs=0.012)
    assert row["replicates"] == 300


@pytest.mark.parametrize("buckets", [None, 8])
def test_value_is_exact_whatever_the_buckets(scored, buckets):
    plain = K.metric_panel(scored[1]).first()["roc_auc"]
    row = B.bootstrap_ci(scored[1], reps=30, buckets=buckets).first()
    assert row["roc_auc"] == pytest.approx(plain, abs=1e-12) and row["ci_lower"] < plain < row["ci_upper"]


@pytest.mark.parametrize("metric", B.METRICS)
def test_every_bootstrap_metric_has_the_plain_value(scored, metric):
    plain = K.metric_panel(scored[1]).first()[metric]
    row = B.bootstrap_ci(scored[1], metric, reps=20).first()
    assert row[metric] == pytest.approx(plain, abs=1e-9) and row["ci_lower"] <= row["ci_upper"]


def test_unknown_metric_is_refused(scored):
    with pytest.raises(KeyError):
        B.bootstrap_ci(scored[1], "accuracy", reps=2)


def test_paired_bootstrap_sees_a_clear_winner_and_a_tie(spark):
    pdf = sample(800, 2)
    rng = np.random.default_rng(9)
    good = spark.createDataFrame(pdf)
    bad = spark.createDataFrame(pdf.assign(model="B", p=rng.uniform(0, 1, 800)))
    same = spark.createDataFrame(pdf.assign(model="C"))
    base = spark.createDataFrame(pdf.assign(model="base", p=0.5))
    out = {r["comparison"]: r for r in B.model_comparison(
        good.unionByName(bad).unionByName(same).unionByName(base), "A", baseline="base", reps=60).collect()}
    assert set(out) == {"A - B", "A - C"}
    assert out["A - B"]["significant_5pct"] and out["A - B"]["difference"] > 0.2
    assert out["A - C"]["difference"] == 0.0 and out["A - C"]["p_value"] == 1.0
