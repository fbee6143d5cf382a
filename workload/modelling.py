"""Pipelines, training, search and explanation on the star tables (E7, M, I)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlens.operators import encoders as E
from cohortlens.operators import explain as X
from cohortlens.operators import models as M
from cohortlens.plans.experiment import Columns, run_experiment
from cohortlens.session import stage
from workload.registry import R, TEST, TRAIN, Star, query, sql

FEATURES = ["wealth", "weight", "present_share", "segment", "control", "school_key", "grp_key"]
# Operators run with their own defaults: all candidates, rounds, trials, folds, repetitions and permutations.
# Every feature belongs to one block; the operator's own blocks name columns that these tables lack.
BLOCKS = {"wealth": ("wealth",), "weight": ("weight",), "presence": ("present_share",), "segment": ("segment",), "control": ("control",),
          "keys": ("school_key", "grp_key")}


def base(s: Star):
    """Evaluated units with string keys, a context feature and a label: the stored base table."""
    e = s.evaluated
    share = s.units.groupBy("year", "grp").agg(F.avg(F.col("present").cast("int").cast("double")).alias("present_share"))
    return stage(M.labelled(e, "target").join(share, ["year", "grp"], "left")
                 .withColumn("school_key", F.col("school").cast("string"))
                 .withColumn("grp_key", F.col("grp").cast("string"))
                 .withColumnRenamed("unit_id", "row_id"), "units")


def split(s: Star):
    b = base(s)
    return b.where(F.col("year") == TRAIN), b.where(F.col("year") == TEST)


KINDS = {"numeric": ["wealth", "weight", "present_share"], "low": ["segment", "control"], "high": ["school_key", "grp_key"]}


@query("e7_preprocessor")
def _(s: Star):
    train, test = split(s)
    model = E.LeakSafePipeline(stages=E.build_preprocessor(train, FEATURES, kinds=KINDS)).fit(train)
    out = model.transform(test)
    names = E.feature_names(out)
    x = vector_to_array("features")
    return out.select("row_id", *[x[i].alias(n) for i, n in enumerate(names)])


@query("m1_prior_baseline", sql(f"""
    SELECT unit_id AS row_id, (SELECT {R('avg(CAST(CAST(target AS INTEGER) AS DOUBLE))')} FROM evaluated WHERE year = 1999) AS p
    FROM evaluated WHERE year = 2000""", "evaluated"))
def _(s: Star):
    train, test = split(s)
    return M.score(M.PriorBaseline().fit(train), test, ["row_id"])


def _fit(s: Star, name: str = "logistic", **params):
    train, test = split(s)
    return M.fit_candidate(name, train, FEATURES, params=params, kinds=KINDS), train, test


@query("m2_logistic")
def _(s: Star):
    model, _, test = _fit(s)
    return M.score(model, test, ["row_id", "y"])


@query("m3_boosted_trees")
def _(s: Star):
    model, _, test = _fit(s, "hist_boost")
    return M.score(model, test, ["row_id", "y"])


@query("m5_train_and_score")
def _(s: Star):
    train, test = split(s)
    panel, _, _ = M.train_and_score(train, test, FEATURES, list(M.CANDIDATES), kinds=KINDS)
    return panel


@query("m6_run_experiment")
def _(s: Star):
    cols = Columns("row_id", "year", "grp_key", "parent", "y")
    result = run_experiment(base(s), "spatial", list(M.CANDIDATES), cols, TRAIN, TEST, min_stratum=20,
                            select=lambda names, allow_lagged: [c for c in names if c in FEATURES])
    return result.strata


@query("m7_tune")
def _(s: Star):
    train, _ = split(s)
    return M.tune(train, FEATURES, "grp_key", kinds=KINDS).history.select("trial", "roc_auc", "roc_auc_std", "folds_run", "rounds")


@query("i1_native_importance")
def _(s: Star):
    model, train, _ = _fit(s, "depth_boost")
    return X.native_importance(model, train)


@query("i2_permutation_importance")
def _(s: Star):
    model, _, test = _fit(s)
    return X.permutation_importance(model, test, FEATURES)


COEF = {"price": 0.2537, "quantity": -1.3719, "discount": 41.773}


@query("i3_linear_attribution", sql(f"""
    SELECT supplier, count(*) AS n, {', '.join(f'{R(f"avg(abs({c} * ({n} - m_{n})))")} AS {n}' for n, c in COEF.items())} FROM lines,
      (SELECT {', '.join(f'avg({n}) AS m_{n}' for n in COEF)} FROM lines) GROUP BY 1""", "lines"))
def _(s: Star):
    parts = X.linear_attribution(s.lines, COEF, ["supplier"])
    return parts.groupBy("supplier").agg(F.count(F.lit(1)).alias("n"), *[
        F.avg(F.abs(f"contribution_{n}")).alias(n) for n in COEF])


@query("i3_linear_mean_abs", sql(" UNION ALL ".join(
    f"SELECT '{n}' AS feature, {R(f'avg(abs({c} * ({n} - (SELECT avg({n}) FROM lines))))')} AS mean_abs FROM lines" for n, c in COEF.items()), "lines"))
def _(s: Star):
    return X.linear_mean_abs(s.lines, COEF)


@query("i3_tree_attribution")
def _(s: Star):
    model, train, test = _fit(s, "depth_boost")
    names = E.feature_names(X._split(model)[0].transform(train.limit(0)))
    return X.mean_abs_attribution(X.attribution(model, test), names)


@query("i4_block_ablation")
def _(s: Star):
    train, test = split(s)
    return X.block_ablation(train, test, FEATURES, "logistic", blocks=BLOCKS, kinds=KINDS)
