"""Metrics, bootstraps and decision outputs over deterministic pseudo-scores (K, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import bootstrap as B
from cohortlens.operators import decide as D
from cohortlens.operators import metrics as K
from cohortlens.session import stage
from workload.registry import R, Star, query, sql

# Small buckets on purpose: the running totals then cross many bucket borders.
SMALL = 500


def curve_ctes(keys: str = "model", src: str = "scores") -> dict[str, str]:
    using = f"USING ({keys})"
    return {
        "cells": f"SELECT {keys}, p, count(*) AS n, sum(y) AS pos FROM {src} GROUP BY {keys}, p",
        "totals": f"SELECT {keys}, sum(n) AS total_n, sum(pos) AS total_pos FROM cells GROUP BY {keys}",
        "run": f"""SELECT {keys}, p, n, pos, total_n, total_pos,
            CAST(sum(n) OVER w AS DOUBLE) AS cum_n, CAST(sum(pos) OVER w AS DOUBLE) AS cum_pos
            FROM cells JOIN totals {using} WINDOW w AS (PARTITION BY {keys} ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""",
        "curve": """SELECT *, cum_pos / nullif(total_pos, 0) AS tpr, (cum_n - cum_pos) / nullif(total_n - total_pos, 0) AS fpr,
            (cum_pos - pos) / nullif(total_pos, 0) AS prev_tpr, (cum_n - cum_pos - n + pos) / nullif(total_n - total_pos, 0) AS prev_fpr FROM run""",
    }


AUC = "sum((fpr - prev_fpr) * (tpr + prev_tpr) / 2)"
AP = "sum((tpr - prev_tpr) * cum_pos / cum_n)"
LOSS = "-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))"
CURVE = curve_ctes()


@query("k1_roc_curve", sql(f"""
    SELECT model, {R('p')} AS threshold, {R('fpr')} AS fpr, {R('tpr')} AS tpr FROM curve
    UNION ALL SELECT DISTINCT model, CAST('inf' AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM curve""", "scores", **CURVE))
def _(s: Star):
    return K.roc_curve_table(s.scores, rows_per_bucket=SMALL)


@query("k2_pr_curve", sql(f"""
    SELECT model, {R('p')} AS threshold, {R('cum_pos / cum_n')} AS precision, {R('tpr')} AS recall FROM curve""", "scores", **CURVE))
def _(s: Star):
    return K.pr_curve_table(s.scores, rows_per_bucket=SMALL)


@query("k3_calibration", sql(f"""
    SELECT model, CAST(len(list_filter(cuts, lambda e: e < p)) AS INTEGER) AS bin, count(*) AS n, {R('avg(p)')} AS mean_predicted,
      {R('avg(CAST(y AS DOUBLE))')} AS observed_rate FROM scores JOIN (
        SELECT model, [{', '.join(f'quantile_cont(p, {i} / 20.0)' for i in range(1, 20))}] AS cuts FROM scores GROUP BY 1) USING (model)
    GROUP BY 1, 2""", "scores"))
def _(s: Star):
    return K.calibration_table(s.scores, rows_per_bucket=SMALL)


@query("k4_roc_auc", sql(f"SELECT model, {R(AUC)} AS roc_auc FROM curve GROUP BY 1", "scores", **CURVE))
def _(s: Star):
    return K.roc_auc(s.scores, rows_per_bucket=SMALL)


@query("k5_pr_auc", sql(f"SELECT model, {R(AP)} AS pr_auc FROM curve GROUP BY 1", "scores", **CURVE))
def _(s: Star):
    return K.pr_auc(s.scores, rows_per_bucket=SMALL)


@query("k6_ks", sql(f"SELECT model, {R('max(tpr - fpr)')} AS ks FROM curve GROUP BY 1", "scores", **CURVE))
def _(s: Star):
    return K.ks(s.scores, rows_per_bucket=SMALL)


BEST = "row_number() OVER (PARTITION BY model ORDER BY tpr - fpr DESC, p DESC) = 1"


@query("k7_youden_threshold", sql(f"SELECT model, {R('p')} AS threshold FROM (SELECT *, {BEST} AS best FROM curve) WHERE best",
                                  "scores", **CURVE))
def _(s: Star):
    return K.youden_threshold(s.scores, rows_per_bucket=SMALL)


@query("k8_brier_log_loss", sql(f"""
    SELECT model, {R('avg((p - y) * (p - y))')} AS brier, {R(f'avg({LOSS})')} AS log_loss FROM scores GROUP BY 1""", "scores"))
def _(s: Star):
    return K.brier(s.scores).join(K.log_loss(s.scores), "model")


def confusion_select(tp: str, fp: str, pos: str, n: str) -> str:
    fn, tn = f"({pos} - {tp})", f"({n} - {pos} - {fp})"

    def ratio(a: str, b: str) -> str:
        return R(f"coalesce(({a}) / nullif(CAST({b} AS DOUBLE), 0), 0)")

    product = f"(CAST({tp} + {fp} AS DOUBLE) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn}))"
    recall = f"coalesce({tp} / nullif(CAST({pos} AS DOUBLE), 0), 0)"
    specificity = f"coalesce({tn} / nullif(CAST({n} - {pos} AS DOUBLE), 0), 0)"
    return f"""{ratio(f'{tp} + {tn}', n)} AS accuracy, {R(f'({recall} + {specificity}) / 2')} AS balanced_accuracy,
        {ratio(tp, f'({tp} + {fp})')} AS precision, {R(recall)} AS recall, {ratio(f'2 * {tp}', f'(2 * {tp} + {fp} + {fn})')} AS f1,
        {R(f'coalesce((CAST({tp} AS DOUBLE) * {tn} - CAST({fp} AS DOUBLE) * {fn}) / nullif(sqrt({product}), 0), 0)')} AS mcc,
        CAST({tn} AS BIGINT) AS tn, CAST({fp} AS BIGINT) AS fp, CAST({fn} AS BIGINT) AS fn, CAST({tp} AS BIGINT) AS tp"""


@query("k9_confusion", sql(f"""
    SELECT model, n, {R('pos / n')} AS base_rate, {confusion_select('tp', 'fp', 'pos', 'n')} FROM (
      SELECT model, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp,
        count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp FROM scores GROUP BY 1)""", "scores"))
def _(s: Star):
    return K.confusion(s.scores, 0.5)


def panel_sql(keys: str) -> str:
    """Panel over the curve view: areas, losses from cells, and counts at the best threshold."""
    best = f"row_number() OVER (PARTITION BY {keys} ORDER BY tpr - fpr DESC, p DESC) = 1"
    clip = "least(greatest(p, 1e-6), 1 - 1e-6)"
    return f"""
    SELECT {keys}, roc_auc, pr_auc, ks, brier, log_loss, {R('CASE WHEN top > 0 THEN bp ELSE CAST(\'inf\' AS DOUBLE) END')} AS threshold,
      CAST(n AS BIGINT) AS n, {R('pos / n')} AS base_rate, {confusion_select('tp', 'fp', 'pos', 'n')} FROM (
      SELECT {keys}, {R(AUC)} AS roc_auc, {R(AP)} AS pr_auc, {R('greatest(max(tpr - fpr), 0)')} AS ks, max(tpr - fpr) AS top,
        {R('sum(pos * (1 - p) * (1 - p) + (n - pos) * p * p) / sum(n)')} AS brier,
        {R(f'-sum(pos * ln({clip}) + (n - pos) * ln(1 - {clip})) / sum(n)')} AS log_loss, max(total_n) AS n, max(total_pos) AS pos FROM curve GROUP BY {keys})
    JOIN (SELECT {keys}, p AS bp, CASE WHEN tpr > fpr THEN cum_pos ELSE 0 END AS tp, CASE WHEN tpr > fpr THEN cum_n - cum_pos ELSE 0 END AS fp
      FROM (SELECT *, {best} AS best FROM curve) WHERE best) USING ({keys})"""


@query("k10_metric_panel", sql(panel_sql("model"), "scores", **CURVE))
def _(s: Star):
    return K.metric_panel(s.scores, rows_per_bucket=SMALL)


STRATA = """SELECT s.*, CASE WHEN school IN (SELECT school FROM scores WHERE year = 1999) THEN 'group seen' ELSE 'group new, parent seen' END AS stratum
    FROM scores s WHERE year = 2000"""
ALL_ROWS = "SELECT model, stratum, y, p FROM strata UNION ALL SELECT model, '(total)', y, p FROM strata"


@query("k11_panel_by_stratum", sql(f"SELECT * FROM ({panel_sql('model, stratum')}) WHERE stratum = '(total)' OR (n >= 50 AND base_rate > 0 AND base_rate < 1)",
                                   "scores", strata=STRATA, all_rows=ALL_ROWS, **curve_ctes("model, stratum", "all_rows")))
def _(s: Star):
    from cohortlens.operators.joins import coverage_strata
    scores = s.scores
    labelled = coverage_strata(scores.where(F.col("year") == 2000), scores.where(F.col("year") == 1999), "school", "parent")
    return K.panel_by_stratum(labelled, min_n=50, rows_per_bucket=SMALL)


@query("k12_bootstrap_ci")
def _(s: Star):
    return B.bootstrap_ci(s.scores)


@query("k13_paired_bootstrap")
def _(s: Star):
    sc = s.scores
    a = sc.where(F.col("model") == "A").select("row_id", "y", F.col("p").alias("p_a"))
    b = sc.where(F.col("model") == "B").select("row_id", F.col("p").alias("p_b"))
    return B.paired_bootstrap(a.join(b, "row_id"))


@query("k14_model_comparison")
def _(s: Star):
    return B.model_comparison(s.scores, "A")


# --- decisions ----------------------------------------------------------------------------------

RANK_COLS = ["predicted", "observed", "std_error", "residual", "residual_z", "risk", "parent_residual", "adjusted_residual"]


RANKING = """
    SELECT *, observed - predicted AS residual, (observed - predicted) / nullif(std_error, 0) AS residual_z, 1 - predicted AS risk,
      median(observed - predicted) OVER (PARTITION BY model, parent) AS parent_residual,
      observed - predicted - median(observed - predicted) OVER (PARTITION BY model, parent) AS adjusted_residual FROM (
      SELECT model, school, min(parent) AS parent, min(segment) AS segment, count(*) AS n, avg(p) AS predicted, avg(CAST(y AS DOUBLE)) AS observed,
        sqrt(sum(p * (1 - p))) / count(*) AS std_error FROM scores GROUP BY 1, 2 HAVING count(*) >= 4)"""


def _ranking(s: Star):
    return D.group_risk_ranking(s.scores, "school", "parent", labels=["segment"], min_n=4, by=["model"])


@query("d1_group_risk_ranking_models", sql(f"SELECT model, school, parent, segment, n, {', '.join(f'{R(c)} AS {c}' for c in RANK_COLS)} FROM ranking",
                                               "scores", ranking=RANKING), also="d1_group_risk_ranking")
def _(s: Star):
    return _ranking(s)


@query("d2_aggregate_calibration_all_models", sql(f"""
    SELECT model, count(*) AS n_groups, {R('corr(predicted, observed)')} AS correlation, {R('100 * avg(abs(predicted - observed))')} AS mae_pp,
      {R('100 * median(abs(predicted - observed))')} AS median_error_pp, {R('100 * avg(predicted - observed)')} AS bias_pp,
      {R('1 - sum((predicted - observed) ** 2) / (var_pop(observed) * count(*))')} AS r2 FROM ranking GROUP BY 1""", "scores", ranking=RANKING), also="d2_aggregate_calibration")
def _(s: Star):
    return D.aggregate_calibration(_ranking(s), by=["model"])


def _group_context(s: Star):
    e = s.evaluated
    return e.groupBy("school").agg(
        F.avg(F.col("target").cast("int").cast("double")).alias("rate"), F.avg("wealth").alias("wealth"),
        F.avg("weight").alias("weight"), F.count(F.lit(1)).cast("double").alias("size"), F.min("segment").alias("cluster"))


@query("d3_cluster_groups")
def _(s: Star):
    groups = stage(_group_context(s).drop("cluster"), "groups")
    clustered = D.cluster_groups(groups, "school", ["wealth", "weight", "size"], "rate", k=5)
    return D.cluster_profile(clustered, ["wealth", "weight", "size"], "rate")


CONTEXT = """SELECT school, avg(CAST(CAST(target AS INTEGER) AS DOUBLE)) AS rate, avg(wealth) AS wealth, avg(CAST(weight AS DOUBLE)) AS weight,
    count(*)::DOUBLE AS size, min(segment) AS cluster FROM evaluated GROUP BY 1"""
PROFILE = """SELECT cluster, count(*) AS n_groups, avg(rate) AS observed, avg(wealth) AS wealth, avg(weight) AS weight, avg(size) AS size FROM ctx GROUP BY 1"""


@query("d4_cluster_profile", sql(f"SELECT cluster, n_groups, {', '.join(f'{R(c)} AS {c}' for c in ['observed', 'wealth', 'weight', 'size'])} FROM profile",
                                 "evaluated", ctx=CONTEXT, profile=PROFILE))
def _(s: Star):
    return D.cluster_profile(_group_context(s), ["wealth", "weight", "size"], "rate")


@query("d5_characterize", sql(f"""
    SELECT cluster, n_groups, {R('observed')} AS observed, traits FROM profile JOIN (
      SELECT cluster, string_agg(CASE WHEN z > 0 THEN '↑ ' ELSE '↓ ' END || variable, ' · ' ORDER BY r) AS traits FROM (
        SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, variable) AS r FROM (
          SELECT cluster, variable, (v - avg(v) OVER (PARTITION BY variable)) / nullif(stddev_pop(v) OVER (PARTITION BY variable), 0) AS z
          FROM (UNPIVOT (SELECT cluster, wealth, weight, size FROM profile) ON wealth, weight, size INTO NAME variable VALUE v)))
      WHERE r <= 2 GROUP BY 1) USING (cluster)""", "evaluated", ctx=CONTEXT, profile=PROFILE))
def _(s: Star):
    variables = ["wealth", "weight", "size"]
    return D.characterize(D.cluster_profile(_group_context(s), variables, "rate"), variables, 2)


PHI = """CASE WHEN x >= 0 THEN 1 - tail ELSE tail END"""
RISK = f"""
    SELECT *, {PHI} AS p_miss FROM (SELECT *, exp(-x * x / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937
      + t * (-1.821255978 + t * 1.330274429)))) AS tail FROM (SELECT *, 1 / (1 + 0.2316419 * abs(x)) AS t FROM (
      SELECT *, goal_pct / 100.0 AS goal, 100 * (predicted - goal_pct / 100.0) AS gap_pp, (goal_pct / 100.0 - predicted) / nullif(std_error, 0) AS x
      FROM (SELECT *, CAST(25 + school % 50 AS DOUBLE) AS goal_pct FROM ranking))))"""
CLASS = "CASE WHEN p_miss <= 0.2 THEN 'likely met' WHEN p_miss <= 0.5 THEN 'attention' WHEN p_miss <= 0.8 THEN 'high risk' WHEN p_miss > 0.8 THEN 'critical risk' END"


def _risk(s: Star):
    goals = s.evaluated.select("school", (25 + F.col("school") % 50).cast("double").alias("goal_pct"))
    return D.target_miss_risk(_ranking(s), goals, "school", "goal_pct")


def _report_tables(s: Star):
    # Sums of doubles depend on their order in the last digits; ties must not.
    return (stage(_ranking(s).withColumns({c: F.round(c, 9) for c in ("risk", "adjusted_residual")}), "ranking"),
            stage(_risk(s).withColumn("gap_pp", F.round("gap_pp", 9)), "risk"))


def _report(ranking, risk):
    lists = D.decision_report(ranking, risk, "school", "parent", min_n=5, concentration=2)
    spec = {"top_risk": ("school", "risk"), "worst_residuals": ("school", "adjusted_residual"),
            "best_residuals": ("school", "adjusted_residual"), "class_counts": ("risk_class", "n"),
            "largest_gaps": ("school", "gap_pp"), "parent_concentration": ("parent", "n")}
    out = None
    for name, (item, value) in spec.items():
        part = lists[name].select(F.lit(name).alias("list"), F.col(item).cast("string").alias("item"),
                                  F.col(value).cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("d6_target_miss_risk_all_models", sql(f"SELECT model, school, {R('goal')} AS goal, {R('gap_pp')} AS gap_pp, {R('p_miss')} AS p_miss FROM risk",
                                             "scores", ranking=RANKING, risk=RISK), also="d6_target_miss_risk")
def _(s: Star):
    return _risk(s).select("model", "school", "goal", "gap_pp", "p_miss")


@query("d7_risk_class_all_models", sql(f"SELECT model, school, {CLASS} AS risk_class FROM risk", "scores", ranking=RANKING, risk=RISK), also="d7_risk_class")
def _(s: Star):
    return _risk(s).select("model", "school", "risk_class")


def _first(order: str, k: int) -> str:
    return f"WHERE n >= 5 QUALIFY row_number() OVER (PARTITION BY model ORDER BY {order}, school) <= {k}"


@query("d8_decision_report_all_models", sql(f"""
    SELECT model, 'top_risk' AS list, CAST(school AS VARCHAR) AS item, {R('risk')} AS value FROM (SELECT * FROM ranking {_first('round(risk, 9) DESC', 15)})
    UNION ALL SELECT model, 'worst_residuals', CAST(school AS VARCHAR), {R('adjusted_residual')} FROM (SELECT * FROM ranking {_first('round(adjusted_residual, 9)', 10)})
    UNION ALL SELECT model, 'best_residuals', CAST(school AS VARCHAR), {R('adjusted_residual')} FROM (SELECT * FROM ranking {_first('round(adjusted_residual, 9) DESC', 10)})
    UNION ALL SELECT model, 'class_counts', {CLASS}, count(*) FROM risk WHERE n >= 5 GROUP BY 1, 3
    UNION ALL SELECT model, 'largest_gaps', CAST(school AS VARCHAR), {R('gap_pp')} FROM gaps
    UNION ALL SELECT model, 'parent_concentration', CAST(parent AS VARCHAR), count(*) FROM gaps GROUP BY model, parent HAVING count(*) >= 2""",
    "scores", ranking=RANKING, risk=RISK, gaps=f"SELECT * FROM risk {_first('round(gap_pp, 9)', 15)}"), also="d8_decision_report")
def _(s: Star):
    ranking, risk = _report_tables(s)
    # One row per model.
    names = [r.model for r in ranking.select("model").distinct().orderBy("model").collect()]
    parts = [_report(*(t.where(F.col("model") == m) for t in (ranking, risk))).select(F.lit(m).alias("model"), "*") for m in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
