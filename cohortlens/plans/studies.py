"""Runs that start from a design and leave stored results: search, comparison, interpretation."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import bootstrap, explain, models
from cohortlens.operators.encoders import feature_names
from cohortlens.operators.splits import stratified_sample
from cohortlens.plans.experiment import Columns, prepare
from cohortlens.sources.storage import write_report


# --- search ---------------------------------------------------------------------------------------

def run_search(base: DataFrame, name: str = "temporal", columns: Columns = Columns(), train_year: int = 2023, test_year: int = 2024,
               sample: int | None = 400_000, trials: int = 40, folds: int = 3, seed: int = 42, save_to: str | None = None,
               **how) -> models.Search:
    """Search booster settings on the training rows of a design; test rows take no part.

    Lagged features follow the design, degenerate ones are dropped as seen on the sample. ``sample`` bounds the rows the
    search looks at, by class; the settings found are meant for a fit on all rows. Stores ``best_params_<design>`` (one
    line of JSON) and ``search_history_<design>``.
    """
    choice = {"select": how.pop("select")} if "select" in how else {}
    train, _, features, _ = prepare(base, name, columns, train_year, test_year, seed=seed, **choice,
                                    learn_on=lambda rows: stratified_sample(rows, "y", sample, columns.row_id, seed))
    found = models.tune(train, features, columns.group, trials, folds, columns.row_id, seed, **how)
    if save_to:
        spark = base.sparkSession
        line = spark.createDataFrame([(found.to_json(design=name, trials=trials, sample=sample),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{save_to.rstrip('/')}/best_params_{name}")
        flat = found.history.withColumn("params", F.to_json("params"))
        write_report(flat, save_to, f"search_history_{name}", "csv", single_file=True)
    return found


def load_best(spark: SparkSession, folder: str, name: str = "temporal") -> dict:
    """Stored settings of a search, as ``params`` of a boosted candidate."""
    text = spark.read.text(f"{folder.rstrip('/')}/best_params_{name}").first()["value"]
    return json.loads(text)["params"]


# --- comparison -----------------------------------------------------------------------------------

@dataclass
class Comparison:
    intervals: DataFrame
    paired: DataFrame
    winner: str


def run_comparison(panel: DataFrame, scores: DataFrame, name: str = "temporal", row_id: str = "id_aluno", baseline: str = "baseline",
                   metric: str = "roc_auc", reps: int = 300, seed: int = 42, save_to: str | None = None) -> Comparison:
    """Intervals of every candidate but the baseline, and the best one against each other, from stored scores.

    Stores ``bootstrap_ci_<design>`` and ``paired_comparison_<design>``.
    """
    real = panel.where(F.col("model") != baseline)
    winner = real.orderBy(F.desc(metric), "model").first()["model"]
    intervals = bootstrap.bootstrap_ci(scores.where(F.col("model") != baseline), metric, reps, seed=seed).orderBy(F.desc(metric), "model")
    paired = bootstrap.model_comparison(scores, winner, row_id, baseline=baseline, metric=metric, reps=reps, seed=seed).orderBy("comparison")
    if save_to:
        write_report(intervals, save_to, f"bootstrap_ci_{name}", "csv", single_file=True)
        write_report(paired, save_to, f"paired_comparison_{name}", "csv", single_file=True)
    return Comparison(intervals, paired, winner)


# --- interpretation -------------------------------------------------------------------------------

def run_interpretation(model: PipelineModel, base: DataFrame, name: str = "temporal", candidate: str = "logistic", columns: Columns = Columns(),
                       train_year: int = 2023, test_year: int = 2024, seed: int = 42, ablation_sample: int | None = 400_000,
                       permutation_rows: int | None = 100_000, attribution_rows: int | None = 30_000, params: Mapping | None = None,
                       save_to: str | None = None, **how) -> dict[str, DataFrame]:
    """What drives a stored model, four ways: native, by permutation, by attribution, by leaving blocks out.

    Rows come from the model's design. The row limits are those of a report; ``None`` takes every row. Models that
    have no native measure or attribution leave that table out. Stores ``<table>_<design>``.
    """
    train, test, features, _ = prepare(base, name, columns, train_year, test_year, None, seed, **how)
    out = {}
    est = model.stages[-1]
    if hasattr(est, "featureImportances") or hasattr(est, "coefficients"):
        out["native_importance"] = explain.native_importance(model, train)
        names = feature_names(PipelineModel(model.stages[:-1]).transform(test.limit(0)))
        out["mean_attribution"] = explain.mean_abs_attribution(explain.attribution(model, test, columns.row_id, attribution_rows, seed), names)
    out["permutation_importance"] = explain.permutation_importance(model, test, features, columns.row_id, max_n=permutation_rows, seed=seed)
    learn = stratified_sample(train, "y", ablation_sample, columns.row_id, seed)
    out["block_ablation"] = explain.block_ablation(learn, test, features, candidate, columns.row_id, params=params, seed=seed)
    if save_to:
        for table, df in out.items():
            write_report(df, save_to, f"{table}_{name}", "csv", single_file=True)
    return out
