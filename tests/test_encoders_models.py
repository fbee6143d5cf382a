from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from cohortlens.functions import hash32
from cohortlens.operators import encoders as E
from cohortlens.operators import explain as X
from cohortlens.operators import models as M
from cohortlens.operators.metrics import roc_auc
from cohortlens.sources.storage import load_model, save_model
from conftest import rows


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(1)
    n = 1500
    g = rng.integers(0, 40, n)
    x = rng.normal(size=n)
    logit = 0.9 * x + np.sin(g)
    pdf = pd.DataFrame({"row_id": range(n), "g": [f"g{i}" for i in g], "p": [f"p{i % 4}" for i in g],
                        "x": np.where(rng.uniform(size=n) < 0.1, np.nan, x), "seg": rng.choice(list("ABC"), n, p=[.6, .396, .004]),
                        "y": (rng.uniform(size=n) < 1 / (1 + np.exp(-logit))).astype(int)})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x"))).persist()
    return df.where("row_id < 1000"), df.where("row_id >= 1000")


KINDS = {"numeric": ["x"], "low": ["seg"], "high": ["g"]}
FEATURES = ["x", "seg", "g"]


def test_target_encoding_does_not_leak_into_new_data(spark):
    rng = np.random.default_rng(0)
    n = 4000
    train = spark.createDataFrame(pd.DataFrame({"row_id": range(n), "m": [f"m{i}" for i in range(n)], "noise": rng.normal(size=n), "y": rng.integers(0, 2, n)}))
    new = spark.createDataFrame(pd.DataFrame({"row_id": range(n), "m": [f"m{n + i}" for i in range(n)], "noise": rng.normal(size=n), "y": rng.integers(0, 2, n)}))
    kinds = {"numeric": ["noise"], "low": [], "high": ["m"]}
    pipe = E.build_model(train, ["m", "noise"], LogisticRegression(featuresCol="features", labelCol="y"), scale=True, kinds=kinds)
    model = pipe.fit(train)
    auc = roc_auc(M.score(model, new, ["y"], "m")).first()["roc_auc"]
    assert 0.40 < auc < 0.60


def test_a_training_row_never_sees_its_own_fold(study):
    train, _ = study
    pdf = train.select("row_id", "g", "y", F.pmod(hash32(42, "row_id"), F.lit(5)).alias("fold")).toPandas()
    model = E.CrossFitTargetEncoder(columns=["g"]).fit(train)
    got = model.transform_training(train).select("row_id", "f__g").toPandas().set_index("row_id")["f__g"]
    for r in pdf.head(60).itertuples():
        rest = pdf[pdf["fold"] != r.fold]
        mine = rest[rest["g"] == r.g]["y"]
        m = rest["y"].mean()
        want = m
        if len(mine):
            mc, v, big = mine.mean(), mine.mean() * (1 - mine.mean()), m * (1 - m)
            lam = big * len(mine) / (big * len(mine) + v)
            want = lam * mc + (1 - lam) * m
        assert got[r.row_id] == pytest.approx(want)


def test_unseen_level_gets_the_global_mean(spark, study):
    train, _ = study
    model = E.CrossFitTargetEncoder(columns=["g"]).fit(train)
    new = spark.createDataFrame([(1, "never"), (2, None)], "row_id long, g string")
    mean = train.agg(F.avg("y")).first()[0]
    assert [r["f__g"] for r in model.transform(new).collect()] == [pytest.approx(mean)] * 2


def test_median_is_learnt_on_training_rows_only(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    test = spark.createDataFrame([(None,), (100.0,)], "x double")
    for exact in (True, False):
        model = E.MedianImputer(columns=["x"], exact=exact).fit(train)
        assert model.fitted["medians"]["x"] == 2.0
        assert [(r["f__x"], r["f__missingindicator_x"]) for r in model.transform(test).collect()] == [(2.0, 1.0), (100.0, 0.0)]


def test_indicator_only_for_columns_with_gaps_in_training(spark):
    model = E.MedianImputer(columns=["x"]).fit(spark.createDataFrame([(1.0,)], "x double"))
    assert model.transform(spark.createDataFrame([(None,)], "x double")).columns == ["x", "f__x"]


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "c string")
    assert E.ModeImputer(columns=["c"]).fit(df).fitted["modes"] == {"c": "a"}


def test_rare_and_unknown_levels_share_a_bucket(spark):
    df = spark.createDataFrame([("a",)] * 60 + [("b",)] * 39 + [("rare",)], "c string")
    model = E.InfrequentOneHot(columns=["c"], min_freq=0.05).fit(df)
    out = rows(model.transform(spark.createDataFrame([("a",), ("rare",), ("new",)], "c string")), "c")
    assert [(r["c"], r["f__c_a"], r["f__c_b"], r["f__c_infrequent"]) for r in out] == [
        ("a", 1.0, 0.0, 0.0), ("new", 0.0, 0.0, 1.0), ("rare", 0.0, 0.0, 1.0)]
    plain = E.InfrequentOneHot(columns=["c"], min_freq=0.05).fit(df.where("c <> 'rare'"))
    assert rows(plain.transform(spark.createDataFrame([("new",)], "c string"))) == [{"c": "new", "f__c_a": 0.0, "f__c_b": 0.0}]


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 1.0)], "f__x double, f__k double")
    out = rows(E.StandardScale().fit(df).transform(df), "f__x")
    assert [r["f__x"] for r in out] == [-1.0, 1.0] and [r["f__k"] for r in out] == [0.0, 0.0]


def test_pipeline_survives_storage(spark, study, tmp_path):
    train, test = study
    model = M.fit_candidate("logistic", train, FEATURES, kinds=KINDS)
    save_model(model, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    a = rows(M.score(model, test, ["row_id"]), "row_id")
    b = rows(M.score(again, test, ["row_id"]), "row_id")
    assert a == b
    with pytest.raises(FileNotFoundError):
        load_model(str(tmp_path / "nothing"))


def test_models_score_after_the_session_observed_a_metric(spark, study):
    from pyspark.sql import Observation
    train, test = study
    seen = Observation("seen")
    test.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 500
    model = M.fit_candidate("logistic", train, FEATURES, kinds=KINDS)
    assert M.score(model, test, ["row_id"]).count() == 500 and len(M.score(model, test, ["row_id"]).collect()) == 500


def test_candidates_learn_and_are_ranked(study):
    train, test = study
    panel, scores, fitted = M.train_and_score(train, test, FEATURES, ["baseline", "logistic", "leaf_boost"],
                                              params={"leaf_boost": {"rounds": 15, "least_rows": 30}}, kinds=KINDS)
    got = {r["model"]: r for r in panel.collect()}
    assert got["baseline"]["roc_auc"] == 0.5 and got["logistic"]["roc_auc"] > 0.7 and got["leaf_boost"]["roc_auc"] > 0.65
    assert scores.count() == 3 * 500 and set(fitted) == set(got)
    names = E.feature_names(X._split(fitted["logistic"])[0].transform(test.limit(0)))
    assert names == ["x", "missingindicator_x", "seg_A", "seg_B", "seg_infrequent", "g"]


def test_unknown_candidate():
    with pytest.raises(KeyError, match="available"):
        M.candidate("forest")
    assert {"baseline", "logistic", "hist_boost", "leaf_boost", "depth_boost"} == set(M.CANDIDATES)


def test_draws_are_seeded_in_range_and_learn():
    def run(seed):
        sampler, out = M.DensityRatioSampler(seed=seed), []
        for _ in range(40):
            p = sampler.ask()
            out.append(p)
            sampler.tell(p, -abs(p["rate"] - 0.05) - abs(p["depth"] - 9) / 10)
        return out

    a, b = run(7), run(7)
    assert a == b and a != run(8)
    for p in a:
        assert all(lo <= p[n] <= hi and isinstance(p[n], int) == scale.endswith("int") for n, (lo, hi, scale) in M.SEARCH_SPACE.items())
    miss = [abs(p["depth"] - 9) for p in a]
    assert sum(miss[-20:]) < sum(miss[:5]) * 4 * 0.8


def test_linear_attributions_add_up(study):
    train, test = study
    model = M.fit_candidate("logistic", train, FEATURES, kinds=KINDS)
    got = X.attribution(model, test).join(model.transform(test).select("row_id", "rawPrediction"), "row_id").collect()
    for r in got[:50]:
        assert sum(r["contributions"]) + r["expected"] == pytest.approx(r["rawPrediction"][1])


def test_tree_attributions_add_up_and_find_the_signal(study):
    train, test = study
    model = M.fit_candidate("leaf_boost", train, FEATURES, kinds=KINDS, params={"rounds": 20, "least_rows": 20})
    part = X.attribution(model, test, max_n=40)
    m = {r["row_id"]: r["margin"] for r in model.transform(test).select("row_id", "margin").collect()}
    got = part.collect()
    assert len(got) == 40
    for r in got:
        assert sum(r["contributions"]) + r["expected"] == pytest.approx(m[r["row_id"]], abs=1e-9)
    names = E.feature_names(X._split(model)[0].transform(test.limit(0)))
    top = [r["feature"] for r in X.mean_abs_attribution(part, names).collect()][:2]
    assert set(top) == {"x", "g"}


def test_permutation_and_native_importance_find_the_signal(study):
    train, test = study
    model = M.fit_candidate("logistic", train, FEATURES, kinds=KINDS)
    perm = [r["feature"] for r in X.permutation_importance(model, test, FEATURES, reps=2).collect()]
    assert perm[-1] == "seg"
    native = X.native_importance(model, train, top=2).collect()
    assert {r["feature"] for r in native} == {"x", "g"} and native[0]["measure"] == "absolute coefficient"


@pytest.mark.parametrize("name, params", [("logistic", None), ("leaf_boost", {"rounds": 12, "least_rows": 20})])
def test_permutations_equal_swapping_raw_columns(study, name, params):
    train, test = study
    model = M.fit_candidate(name, train, FEATURES, kinds=KINDS, params=params)
    got = {r["feature"]: r["auc_drop"] for r in X.permutation_importance(model, test, FEATURES, reps=1).collect()}
    base = test.select("row_id", "y", *FEATURES)
    mine = X.hash_rank(base, "42-0-a", ["row_id"], out="_pos")
    other = X.hash_rank(base.select("row_id", F.struct(*FEATURES).alias("_o")), "42-0-b", ["row_id"], out="_pos").drop("row_id")
    paired = mine.join(other, "_pos")
    sides = [M.score(model, base, ["y"], "full")] + [
        M.score(model, paired.select("row_id", "y", *[F.col(f"_o.{c}" if c == f else c).alias(c) for c in FEATURES]), ["y"], f) for f in FEATURES]
    auc = {r["model"]: r["roc_auc"] for r in roc_auc(sides[0].union(sides[1]).union(sides[2]).union(sides[3]).withColumn("p", F.round("p", 12))).collect()}
    assert got == {f: pytest.approx(auc["full"] - auc[f], abs=1e-9) for f in FEATURES}


def test_ablation_skips_empty_blocks(study):
    train, test = study
    got = {r["block"]: r for r in X.block_ablation(train, test, FEATURES, blocks={"g": ("g",), "none": ("zz",)}, kinds=KINDS).collect()}
    assert set(got) == {"(all features)", "without g"} and got["without g"]["n_features"] == 2
    assert got["without g"]["auc_drop"] > 0.02
    again = M.fit_candidate("logistic", train, ["x", "seg"], kinds={**KINDS, "high": []})
    assert got["without g"]["roc_auc"] == pytest.approx(roc_auc(M.score(again, test, ["y"], "m")).first()["roc_auc"], abs=1e-9)


def test_slots_follow_raw_columns(study):
    train, _ = study
    ready = M.prepare_vectors(train, None, FEATURES, False, kinds=KINDS)
    assert ready.names == ["x", "missingindicator_x", "seg_A", "seg_B", "seg_infrequent", "g"]
    assert ready.slots(["seg"]) == [0, 1, 5] and ready.slots(["x"]) == [2, 3, 4, 5] and ready.slots(["se", "g"]) == [0, 1, 2, 3, 4]


def test_search_keeps_rounds_cuts_poor_trials_and_refits_to_its_score(study):
    train, _ = study
    space = {"rate": (0.05, 0.3, "log"), "depth": (1, 4, "int"), "least_rows": (5, 300, "log_int")}
    found = M.tune(train, FEATURES, "g", trials=8, folds=2, space=space, kinds=KINDS, most_rounds=60)
    got = found.history.collect()
    assert sorted(r["trial"] for r in got) == list(range(1, 9))
    whole = [r for r in got if r["folds_run"] == 2]
    assert whole[0]["roc_auc"] == found.roc_auc == max(r["roc_auc"] for r in whole) and len(whole) < 8
    assert set(found.best) == {*space, "rounds"} and 1 <= found.best["rounds"] <= 60
    folds = list(M._folds(train, FEATURES, "g", 2, "row_id", 42, True, KINDS))
    aucs = []
    for fold in folds:
        settings = M.Settings(patience=M.SEARCH_PATIENCE, **{**found.best, "rounds": 60})
        model = M.HistBooster(settings=settings, heldCol="_held").fit(fold)
        aucs.append(roc_auc(M.score(model, fold.where("_held"), ["y"], "m")).first()["roc_auc"])
    assert found.roc_auc == pytest.approx(np.mean(aucs), abs=1e-12)
