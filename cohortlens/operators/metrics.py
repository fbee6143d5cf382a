"""Binary-outcome metrics over a long score table.

Everything is derived from one small relation per model: the *cells*, one row per distinct
score with its counts, carrying running totals in descending score order. Raw scores are
shuffled once, already combined on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import safe_div
from cohortlens.operators.ordering import (
    ROWS_PER_BUCKET, distributed_cumsum, quantile_edges, quantiles_by)

# Order of the columns of the metric panel.
PANEL = ["roc_auc", "pr_auc", "ks", "brier", "log_loss", "accuracy", "balanced_accuracy",
         "precision", "recall", "f1", "mcc", "threshold", "tn", "fp", "fn", "tp", "n",
         "base_rate"]
CLIP = 1e-6
TOTAL = "(total)"


def score_cells(scores: DataFrame, by: Sequence[str] = ("model",), y: str = "y",
                p: str = "p") -> DataFrame:
    """Counts per distinct score: total ``n`` and positives ``pos``."""
    clean = scores.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    return clean.groupBy(*by, F.col(p).cast("double").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos"))


def curve_cells(cells: DataFrame, by: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """Cells with running totals (descending score), class totals and the curve rates."""
    by = list(by)
    cum = distributed_cumsum(cells, by, "p", {"cum_n": "n", "cum_pos": "pos"}, edges, descending=True,
                             totals={"total_n": "n", "total_pos": "pos"})
    neg = F.col("total_n") - F.col("total_pos")
    fp = F.col("cum_n") - F.col("cum_pos")
    return (cum
            .withColumn("tpr", safe_div("cum_pos", "total_pos"))
            .withColumn("fpr", safe_div(fp, neg))
            .withColumn("prev_tpr", safe_div(F.col("cum_pos") - F.col("pos"), "total_pos"))
            .withColumn("prev_fpr", safe_div(fp - (F.col("n") - F.col("pos")), neg)))


def curves(scores: DataFrame, by: Sequence[str] = ("model",), y: str = "y", p: str = "p",
           rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    edges = quantile_edges(scores, p, rows_per_bucket)
    return curve_cells(score_cells(scores, by, y, p), by, edges)


def roc_curve_table(scores: DataFrame, by: Sequence[str] = ("model",), y: str = "y",
                    p: str = "p", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """FPR and TPR per distinct score, starting from (0, 0) at an infinite threshold."""
    cells = curves(scores, by, y, p, rows_per_bucket)
    start = (scores.select(*by).distinct()
             .select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                     F.lit(0.0).alias("tpr")))
    return cells.select(*by, F.col("p").alias("threshold"), "fpr", "tpr").unionByName(start)


def pr_curve_table(scores: DataFrame, by: Sequence[str] = ("model",), y: str = "y",
                   p: str = "p", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    cells = curves(scores, by, y, p, rows_per_bucket)
    return cells.select(*by, F.col("p").alias("threshold"),
                        safe_div("cum_pos", "cum_n").alias("precision"),
                        F.col("tpr").alias("recall"))


def calibration_table(scores: DataFrame, bins: int = 20, by: Sequence[str] = ("model",),
                      y: str = "y", p: str = "p",
                      rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Mean predicted and observed rate per quantile bin of the score (bins close on the right)."""
    by = list(by)
    probs = {f"e{i}": i / bins for i in range(1, bins)}
    cuts = quantiles_by(scores, by, p, probs, quantile_edges(scores, p, rows_per_bucket))
    cuts = cuts.select(*by, F.array(*probs).alias("_cuts"))
    placed = score_cells(scores, by, y, p).join(cuts, by, "left").withColumn(
        "bin", F.size(F.filter("_cuts", lambda e: e < F.col("p"))))
    return placed.groupBy(*by, "bin").agg(
        F.sum("n").alias("n"),
        safe_div(F.sum(F.col("p") * F.col("n")), F.sum("n")).alias("mean_predicted"),
        safe_div(F.sum("pos"), F.sum("n")).alias("observed_rate"))


def _area() -> Column:
    step = F.col("fpr") - F.col("prev_fpr")
    return F.sum(step * (F.col("tpr") + F.col("prev_tpr")) / 2.0)


def _average_precision() -> Column:
    return F.sum((F.col("tpr") - F.col("prev_tpr")) * safe_div("cum_pos", "cum_n"))


def _confusion(tp: Column, fp: Column, pos: Column, n: Column) -> dict[str, Column]:
    """Classification measures from the four counts; an empty denominator gives 0."""
    fn, tn = pos - tp, n - pos - fp

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(safe_div(a, b), F.lit(0.0))

    d = [c.cast("double") for c in (tp, fp, fn, tn)]
    product = (d[0] + d[1]) * (d[0] + d[2]) * (d[3] + d[1]) * (d[3] + d[2])
    return {
        "accuracy": ratio(tp + tn, n),
        # Only classes that occur take part in the mean of the two recalls.
        "balanced_accuracy": F.when(pos == 0, ratio(tn, n)).when(pos == n, ratio(tp, n))
        .otherwise((ratio(tp, pos) + ratio(tn, n - pos)) / 2.0),
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, pos),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": F.coalesce(F.try_divide(d[0] * d[3] - d[1] * d[2], F.sqrt(product)), F.lit(0.0)),
        "tn": tn, "fp": fp, "fn": fn, "tp": tp,
    }


def panel_from_cells(cells: DataFrame, by: Sequence[str], edges: Sequence[float],
                     threshold: float | None = None) -> DataFrame:
    """All measures of every group from its cells, in one aggregate after the running total."""
    by = list(by)
    lifted = F.col("tpr") - F.col("fpr")
    clipped = F.least(F.greatest(F.col("p"), F.lit(CLIP)), F.lit(1 - CLIP))
    neg = F.col("n") - F.col("pos")
    state = F.struct("p", "cum_pos", "cum_n")
    best = (F.max_by(state, F.struct(lifted, F.col("p"))) if threshold is None
            else F.min_by(F.when(F.col("p") >= threshold, state),
                          F.when(F.col("p") >= threshold, F.col("p"))))
    agg = curve_cells(cells, by, edges).groupBy(*by).agg(
        _area().alias("roc_auc"), _average_precision().alias("pr_auc"),
        F.greatest(F.max(lifted), F.lit(0.0)).alias("ks"),
        safe_div(F.sum(F.col("pos") * F.pow(1 - F.col("p"), 2) + neg * F.pow(F.col("p"), 2)),
                 F.sum("n")).alias("brier"),
        safe_div(-F.sum(F.col("pos") * F.ln(clipped) + neg * F.ln(1 - clipped)),
                 F.sum("n")).alias("log_loss"),
        F.max("total_n").alias("n"), F.max("total_pos").alias("_pos"),
        F.max(lifted).alias("_top"), best.alias("_best"))
    # A curve that never rises above the diagonal has its optimum at "predict nobody".
    nobody = (F.col("_top") <= 0) if threshold is None else F.col("_best").isNull()
    cut = (F.when(nobody, F.lit(float("inf"))).otherwise(F.col("_best.p"))
           if threshold is None else F.lit(float(threshold)))
    tp = F.when(nobody, F.lit(0)).otherwise(F.col("_best.cum_pos"))
    fp = F.when(nobody, F.lit(0)).otherwise(F.col("_best.cum_n") - F.col("_best.cum_pos"))
    ready = agg.withColumn("threshold", cut).withColumn("_tp", tp).withColumn("_fp", fp)
    parts = _confusion(F.col("_tp"), F.col("_fp"), F.col("_pos"), F.col("n"))
    return ready.select(
        *by, *[parts[c].alias(c) if c in parts else
               safe_div("_pos", "n").alias(c) if c == "base_rate" else F.col(c) for c in PANEL])


def metric_panel(scores: DataFrame, threshold: float | None = None,
                 by: Sequence[str] = ("model",), y: str = "y", p: str = "p",
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Every measure per model, best ROC AUC first."""
    edges = quantile_edges(scores, p, rows_per_bucket)
    panel = panel_from_cells(score_cells(scores, by, y, p), by, edges, threshold)
    return panel.orderBy(F.desc_nulls_last("roc_auc"), *[F.asc(c) for c in by])


def roc_auc(scores: DataFrame, by: Sequence[str] = ("model",), y: str = "y", p: str = "p",
            rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Tie-correct area under the ROC curve."""
    return curves(scores, by, y, p, rows_per_bucket).groupBy(*by).agg(_area().alias("roc_auc"))


def pr_auc(scores: DataFrame, by: Sequence[str] = ("model",), y: str = "y", p: str = "p",
           rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Average precision: the step rule, no interpolation."""
    return curves(scores, by, y, p, rows_per_bucket).groupBy(*by).agg(
        _average_precision().alias("pr_auc"))


def ks(scores: DataFrame, by: Sequence[str] = ("model",), y: str = "y", p: str = "p",
       rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Largest distance between the cumulative distributions of the two classes."""
    return curves(scores, by, y, p, rows_per_bucket).groupBy(*by).agg(
        F.greatest(F.max(F.col("tpr") - F.col("fpr")), F.lit(0.0)).alias("ks"))


def youden_threshold(scores: DataFrame, by: Sequence[str] = ("model",), y: str = "y",
                     p: str = "p", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Score at the largest TPR - FPR (ties: highest score); infinite for a flat curve."""
    lifted = F.col("tpr") - F.col("fpr")
    return curves(scores, by, y, p, rows_per_bucket).groupBy(*by).agg(
        F.when(F.max(lifted) > 0, F.max_by("p", F.struct(lifted, F.col("p"))))
        .otherwise(F.lit(float("inf"))).alias("threshold"))


def brier(scores: DataFrame, by: Sequence[str] = ("model",), y: str = "y",
          p: str = "p") -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def log_loss(scores: DataFrame, by: Sequence[str] = ("model",), y: str = "y",
             p: str = "p") -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(CLIP)), F.lit(1 - CLIP))
    loss = -(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))
    return scores.groupBy(*by).agg(F.avg(loss).alias("log_loss"))


def confusion(scores: DataFrame, threshold: float, by: Sequence[str] = ("model",), y: str = "y",
              p: str = "p") -> DataFrame:
    """Counts and classification measures at a fixed threshold (p >= threshold is positive)."""
    hit = F.col(p) >= threshold
    c = scores.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(
        F.count_if(hit & (F.col(y) == 1)).alias("_tp"), F.count_if(hit & (F.col(y) == 0)).alias("_fp"),
        F.count_if(F.col(y) == 1).alias("_pos"), F.count(F.lit(1)).alias("n"))
    parts = _confusion(F.col("_tp"), F.col("_fp"), F.col("_pos"), F.col("n"))
    return c.select(*by, "n", safe_div("_pos", "n").alias("base_rate"),
                    *[v.alias(k) for k, v in parts.items()])


def panel_by_stratum(scores: DataFrame, stratum: str = "stratum", min_n: int = 500,
                     by: Sequence[str] = ("model",), y: str = "y", p: str = "p",
                     threshold: float | None = None,
                     rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The panel per coverage stratum plus the total. Small or one-class strata are left out.

    The total is summed from the strata's cells; the raw scores are read once for both.
    """
    keys = [*by, stratum]
    edges = quantile_edges(scores, p, rows_per_bucket)
    cells = score_cells(scores, keys, y, p)
    total = (cells.groupBy(*by, "p").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
             .withColumn(stratum, F.lit(TOTAL)))
    panel = panel_from_cells(cells.unionByName(total), keys, edges, threshold)
    usable = (F.col("n") >= min_n) & (F.col("base_rate") > 0) & (F.col("base_rate") < 1)
    return panel.where((F.col(stratum) == TOTAL) | usable)

