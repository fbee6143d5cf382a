from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.plans.decision import decision_outputs
from cohortlens.plans.experiment import Columns, design, prepare, run_experiment
from cohortlens.plans.studies import load_best, run_comparison, run_interpretation, run_search
from cohortlens.sources.storage import load_model, load_scores


@pytest.fixture(scope="module")
def base(spark):
    """A small base table with the store's own column names."""
    rng = np.random.default_rng(8)
    n = 2400
    town = rng.integers(0, 24, n)
    x = rng.normal(size=24)[town]
    pdf = pd.DataFrame({
        "ano": rng.choice([2023, 2024], n), "id_aluno": [f"a{i}" for i in range(n)], "id_escola": [f"s{i % 90}" for i in range(n)],
        "id_municipio": [f"m{t}" for t in town], "sigla_uf": [f"u{t % 4}" for t in town], "nome_municipio": [f"Town {t}" for t in town],
        "alvo_alfabetizado": rng.uniform(size=n) < 1 / (1 + np.exp(-x)), "alu_rede": rng.choice(["Municipal", "Estadual"], n),
        "alu_peso_amostral": rng.uniform(size=n), "ses_ivs": x + rng.normal(scale=0.2, size=n), "ses_gini": 0.5,
        "inse_medio": -x, "ter_regiao": [f"r{t % 2}" for t in town]})
    table = (spark.createDataFrame(pdf)
            .withColumn("mun_lag_meta_ano_alvo", F.when(F.col("ano") == 2024, F.lit(55.0)))
            .withColumn("mun_lag_taxa_observada", F.when(F.col("ano") == 2024, F.col("inse_medio"))).persist())
    yield table
    table.unpersist()


def test_designs_differ_in_split_and_history(base):
    train, test, features, dropped = prepare(base, "temporal")
    assert {r[0] for r in train.select("ano").distinct().collect()} == {2023}
    assert not [f for f in features if f.startswith("mun_lag_")] and "ses_gini" in dropped
    train, test, features, dropped = prepare(base, "spatial")
    assert "mun_lag_taxa_observada" in features and dropped["mun_lag_meta_ano_alvo"].startswith("constant")
    assert not {r[0] for r in train.select("id_municipio").distinct().collect()} & {r[0] for r in test.select("id_municipio").distinct().collect()}
    with pytest.raises(KeyError):
        design("random")


def test_sampling_keeps_class_shares(base):
    train, _, _, _ = prepare(base, "temporal", sample=300)
    assert abs(train.count() - 300) <= 1


def test_experiment_and_decisions_end_to_end(spark, base, tmp_path):
    result = run_experiment(base, "temporal", ["baseline", "logistic"], save_to=str(tmp_path), min_stratum=50)
    panel = {r["model"]: r for r in result.panel.collect()}
    assert result.best == "logistic" and panel["logistic"]["roc_auc"] > 0.6 and panel["baseline"]["ks"] == 0.0
    assert {r["stratum"] for r in result.strata.collect()} == {"(total)", "group seen"}
    n_test = result.test.count()
    scores = load_scores(spark, str(tmp_path / "scores_temporal"), result.test, "id_aluno", ["baseline", "logistic"])
    assert scores.count() == 2 * n_test
    assert spark.read.option("header", True).csv(str(tmp_path / "metrics_temporal")).count() == 2
    assert spark.read.json(str(tmp_path / "features_temporal")).count() == len(result.features)

    model = load_model(str(tmp_path / "model_temporal"))
    out = decision_outputs(model, result.test, clusters=3, min_n=20, report_min_n=20, variables=["ses_ivs", "inse_medio"],
                           save_to=str(tmp_path / "decision"))
    assert out["ranking"].count() == 24 and out["calibration"].first()["correlation"] > 0.5
    assert out["cluster_profile"].count() == 3 and out["target_risk"].where("p_miss IS NOT NULL").count() == 24
    assert out["worst_residuals"].count() == 10 and (tmp_path / "decision" / "ranking").exists()
    no_goal = decision_outputs(model, result.test.drop("mun_lag_meta_ano_alvo"), clusters=2, min_n=20, variables=["ses_ivs"])
    assert "target_risk" not in no_goal


def test_search_comparison_and_interpretation_by_design(spark, base, tmp_path):
    folder = str(tmp_path)
    space = {"rate": (0.05, 0.3, "log"), "depth": (2, 3, "int"), "least_rows": (20, 60, "log_int")}
    found = run_search(base, "spatial", sample=500, trials=3, folds=2, space=space, most_rounds=25, save_to=folder)
    params = load_best(spark, folder, "spatial")
    assert params == found.best and set(params) == {*space, "rounds"}
    history = spark.read.option("header", True).csv(f"{folder}/search_history_spatial")
    assert history.count() == 3 and {"trial", "roc_auc", "folds_run", "rounds", "params"} <= set(history.columns)

    result = run_experiment(base, "spatial", ["baseline", "logistic", "leaf_boost"], params={"leaf_boost": params}, min_stratum=50)
    told = run_comparison(result.panel, result.scores, "spatial", reps=60, save_to=folder)
    intervals = {r["model"]: r for r in told.intervals.collect()}
    assert set(intervals) == {"logistic", "leaf_boost"} and told.winner == max(intervals, key=lambda m: intervals[m]["roc_auc"])
    assert all(r["ci_lower"] < r["roc_auc"] < r["ci_upper"] for r in intervals.values())
    paired = told.paired.collect()
    assert len(paired) == 1 and paired[0]["comparison"].startswith(f"{told.winner} - ") and paired[0]["difference"] >= 0
    assert spark.read.option("header", True).csv(f"{folder}/paired_comparison_spatial").count() == 1

    out = run_interpretation(result.models["leaf_boost"], base, "spatial", "leaf_boost", ablation_sample=600, permutation_rows=300, attribution_rows=100,
                             params=params, save_to=folder)
    assert set(out) == {"native_importance", "mean_attribution", "permutation_importance", "block_ablation"}
    assert out["native_importance"].first()["measure"] == "gain" and out["permutation_importance"].count() == len(result.features)
    assert spark.read.option("header", True).csv(f"{folder}/block_ablation_spatial").count() == out["block_ablation"].count() > 2
