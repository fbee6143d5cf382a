from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import decide as D
from cohortlens.operators import explore as X
from conftest import rows


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(4)
    n = 3000
    g = np.where(rng.uniform(size=n) < 0.33, 0, rng.integers(0, 30, n))  # one hot group
    p = np.clip(rng.normal(0.5 + (g % 5) * 0.05, 0.1), 0, 1)
    pdf = pd.DataFrame({"g": [f"g{i:02d}" for i in g], "uf": [f"u{i % 3}" for i in g], "name": [f"N{i}" for i in g],
                        "y": (rng.uniform(size=n) < p).astype(int), "p": p})
    return pdf, spark.createDataFrame(pdf).persist()


def test_ranking_by_hand(scored):
    pdf, df = scored
    got = {r["g"]: r for r in rows(D.group_risk_ranking(df, "g", "uf", labels=["name"]))}
    want = pdf.groupby("g").agg(uf=("uf", "first"), n=("p", "size"), pred=("p", "mean"), obs=("y", "mean"), var=("p", lambda v: (v * (1 - v)).sum()))
    want = want[want["n"] >= 30]
    want["res"] = want["obs"] - want["pred"]
    want["adj"] = want["res"] - want.groupby("uf")["res"].transform("median")
    assert set(got) == set(want.index)
    for g, w in want.iterrows():
        r = got[g]
        assert r["residual"] == pytest.approx(w["res"]) and r["adjusted_residual"] == pytest.approx(w["adj"])
        assert r["std_error"] == pytest.approx(math.sqrt(w["var"]) / w["n"]) and r["risk"] == pytest.approx(1 - w["pred"])
        assert r["residual_z"] == pytest.approx(w["res"] / r["std_error"])


def test_calibration_of_groups(scored):
    r = D.group_risk_ranking(scored[1], "g", "uf")
    pdf, got = r.toPandas(), D.aggregate_calibration(r).first()
    err = pdf["predicted"] - pdf["observed"]
    assert got["n_groups"] == len(pdf) and got["mae_pp"] == pytest.approx(err.abs().mean() * 100)
    assert got["median_error_pp"] == pytest.approx(err.abs().median() * 100) and got["bias_pp"] == pytest.approx(err.mean() * 100)
    assert got["correlation"] == pytest.approx(pdf["predicted"].corr(pdf["observed"]))
    assert got["r2"] == pytest.approx(1 - (err ** 2).sum() / ((pdf["observed"] - pdf["observed"].mean()) ** 2).sum())


def test_zero_error_gives_no_probability(spark):
    ranking = spark.createDataFrame([("a", 0.6, 0.0), ("b", 0.6, 0.05), ("c", 0.6, 0.05)], "g string, predicted double, std_error double")
    goals = spark.createDataFrame([("a", 65.0), ("b", 65.0), ("b", 65.0)], "g string, goal double")
    got = {r["g"]: r for r in rows(D.target_miss_risk(ranking, goals, "g", "goal"))}
    assert got["a"]["p_miss"] is None and got["c"]["gap_pp"] is None
    assert got["b"]["p_miss"] == pytest.approx(0.5 * math.erfc(-1 / math.sqrt(2)), abs=1e-6)
    assert got["b"]["risk_class"] == "critical risk" and got["b"]["gap_pp"] == pytest.approx(-5.0)


def test_clusters_are_numbered_by_outcome_which_takes_no_part(spark):
    data = [(f"g{i}", float(c * 10 + i % 3), None if c == 1 and i % 10 == 0 else float(-c), 0.9 - 0.2 * c) for c in range(3) for i in range(c * 20, c * 20 + 20)]
    df = spark.createDataFrame(data, "g string, a double, b double, t double")
    out = D.cluster_groups(df, "g", ["a", "b", "absent"], "t", k=3, starts=4)
    profile = rows(D.cluster_profile(out, ["a", "b"], "t"), "cluster")
    assert [r["n_groups"] for r in profile] == [20, 20, 20]
    assert [r["observed"] for r in profile] == pytest.approx([0.5, 0.7, 0.9])
    traits = rows(D.characterize(D.cluster_profile(out, ["a", "b"], "t"), ["a", "b"], 1), "cluster")
    assert traits[0]["traits"] in ("↑ a", "↓ b") and traits[2]["traits"] in ("↓ a", "↑ b")


def test_starts_that_move_together_are_as_good_as_separate_runs(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.6, size=(60, 3)) for c in r.uniform(-6, 6, size=(5, 3))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "g long, x array<double>").withColumn("v", array_to_vector("x")).persist()
    centres = D.best_centres(df, "x", "g", 5, 10)
    cost = ((x[:, None] - centres) ** 2).sum(2).min(1).sum()
    plain = min(KMeans(k=5, seed=s, featuresCol="v").fit(df).summary.trainingCost for s in range(4))
    assert cost <= plain * (1 + 1e-6)
    again = D.best_centres(df.repartition(7), "x", "g", 5, 10)
    assert np.allclose(sorted(map(tuple, centres)), sorted(map(tuple, again)))
    few = D.best_centres(df.where("g < 2"), "x", "g", 5, 3)
    assert few.shape == (2, 3) and D.best_centres(df.where("g < 0"), "x", "g", 5, 3).shape == (1, 0)


def test_report_lists(scored):
    r = D.group_risk_ranking(scored[1], "g", "uf")
    goals = scored[1].select("g", F.lit(70.0).alias("goal"))
    lists = D.decision_report(r, D.target_miss_risk(r, goals, "g", "goal"), "g", "uf", min_n=40, concentration=3)
    assert set(lists) == {"top_risk", "worst_residuals", "best_residuals", "class_counts", "largest_gaps", "parent_concentration"}
    top = lists["top_risk"].collect()
    assert [x["risk"] for x in top] == sorted([x["risk"] for x in top], reverse=True) and len(top) == 15
    assert set(D.decision_report(r, None, "g", "uf")) == {"top_risk", "worst_residuals", "best_residuals"}


def test_correlations_leave_out_thin_features(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "flag": (x > 0).astype(float), "konst": 1.0, "t": 2 * x + rng.normal(size=200)})).withColumn(
        "thin", F.when(F.col("x") > 1.0, F.col("x")))
    got = rows(X.feature_target_correlation(df, ["x", "flag", "konst", "thin"], "t"))
    assert [r["feature"] for r in got] == ["x"] and got[0]["n"] == 200 and got[0]["p_value"] < 1e-20


def test_persistence_drops_units_of_one_year(spark):
    df = spark.createDataFrame([(u, y, (i % 4) < k) for u, k in (("a", 1), ("b", 2), ("c", 3)) for y in (1, 2) for i in range(8)] + [("d", 1, True)] * 8,
                               "u string, y int, t boolean")
    got = X.persistence(df, "u", "y", 1, 2, "t", 5).first()
    assert got["n_units"] == 3 and got["r"] == pytest.approx(1.0)


def test_decile_bins_equal_quantile_cuts(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"f": rng.normal(size=2000), "few": rng.integers(0, 5, 2000).astype(float), "t": rng.integers(0, 2, 2000).astype(bool)})
    got = X.decile_profile(spark.createDataFrame(pdf), ["f", "few"], "t").toPandas().sort_values("bin")
    want = pdf.groupby(pd.qcut(pdf["f"], 10, labels=False, duplicates="drop"))["t"].agg(["size", "mean"])
    assert set(got["feature"]) == {"f"}
    assert got["n"].tolist() == want["size"].tolist() and got["rate"].to_numpy() == pytest.approx(want["mean"].to_numpy())
    assert got["amplitude"].iloc[0] == pytest.approx(want["mean"].max() - want["mean"].min())


def test_partial_correlation_removes_the_common_cause(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=4000)
    df = spark.createDataFrame(pd.DataFrame({"z": z, "x": z + rng.normal(size=4000), "y": z + rng.normal(size=4000)}))
    got = X.partial_correlation(df, "x", "y", "z").first()
    assert got["r"] > 0.4 and abs(got["r_partial"]) < 0.05


def test_map_points_of_the_latest_year(spark):
    df = spark.createDataFrame([(2023, 1.0, 2.0, 0.5), (2024, 1.0, 2.0, 0.6), (2024, None, 2.0, 0.7)], "y int, lat double, lon double, t double")
    assert rows(X.map_points(df, "y", "lat", "lon", "t")) == [{"lat": 1.0, "lon": 2.0, "rate_pct": 60.0}]
