"""Poisson bootstrap of curve metrics.

Resampling with replacement gives every row a Poisson(1) weight, and the weights of n equal
rows add up to one Poisson(n) draw. Rows are therefore merged into (score cell, class)
counts before replicates are attached: the work grows with cells x replicates, not with
rows x replicates. Draws depend on hashes of their cell alone, so a lost task repeats them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortlens.functions import safe_div
from cohortlens.operators import metrics
from cohortlens.operators.ordering import distributed_cumsum, quantile_edges, with_bucket
from cohortlens.operators.splits import cap_sample

#: Largest mean with a table of its own; beyond it, draws of this mean are added.
_TOP = 20


@cache
def _table(k: int) -> np.ndarray:
    """Distribution function of Poisson(2^k) from its first value that a 53-bit uniform can reach."""
    mean = 2.0 ** k
    reach = int(12 * math.sqrt(mean) + 40)
    first = max(0, int(mean) - reach)
    x = np.arange(first, int(mean) + reach + 1)
    log_p = x * math.log(mean) - mean - np.cumsum(np.log(np.maximum(np.arange(1, x[-1] + 1), 1)))[x - 1] if first else np.r_[
        -mean, np.cumsum(math.log(mean) - np.log(np.arange(1, x[-1] + 1))) - mean]
    total = np.cumsum(np.exp(log_p))
    return np.r_[first, total / total[-1]]


def poisson_sums(n: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Exact Poisson(n) draws, a function of n and a 64-bit hash.

    n is written in binary; for each bit set, the value of Poisson(2^k) at its own uniform is looked up in a table, and the
    sum of independent Poisson draws is Poisson of the sum. The same rule holds for every n.
    """
    out = np.zeros(len(n))

    def uniform(turn: int, rows: np.ndarray) -> np.ndarray:
        x = hashes[rows] + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0 ** -53

    def draw(k: int, turn: int, rows: np.ndarray) -> None:
        table = _table(k)
        out[rows] += table[0] + np.searchsorted(table[1:], uniform(turn, rows), side="right")

    for k in range(_TOP):
        rows = np.flatnonzero(n >> k & 1)
        if len(rows):
            draw(k, k, rows)
    turn, rest = _TOP, n >> _TOP
    while len(rows := np.flatnonzero(rest > 0)):
        draw(_TOP, turn, rows)
        rest = rest - 1
        turn += 1
    return out


@F.pandas_udf(DoubleType())
def _poisson(n: pd.Series, h: pd.Series) -> pd.Series:
    return pd.Series(poisson_sums(n.to_numpy(np.int64), h.to_numpy(np.int64).view(np.uint64)))


def poisson_draw(n: Column, *keys: Column) -> Column:
    """Poisson(n) weight of a cell, a function of n and the keys only."""
    return _poisson(n.cast("long"), F.xxhash64(*keys))


def with_replicates(cells: DataFrame, reps: int) -> DataFrame:
    """Every cell once per replicate, laid out by replicate.

    The cells are few and sit in few partitions. The replicates are spread before their
    weights are drawn, and that layout also serves the grouping and the windows that follow.
    """
    parts = max(1, min(reps + 1, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return cells.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps)))).repartition(parts, "rep")


def _metric(name: str) -> Column:
    """Aggregate of one replicate over its cells; cw / cp are running weights above the cell."""
    tpr, fpr = safe_div("cp", "tp"), safe_div(F.col("cw") - F.col("cp"), F.col("tw") - F.col("tp"))
    prev_tpr = safe_div(F.col("cp") - F.col("wp"), "tp")
    prev_fpr = safe_div((F.col("cw") - F.col("cp")) - (F.col("w") - F.col("wp")),
                        F.col("tw") - F.col("tp"))
    if name == "roc_auc":
        return F.sum((fpr - prev_fpr) * (tpr + prev_tpr) / 2.0)
    if name == "pr_auc":
        return F.sum((tpr - prev_tpr) * F.coalesce(safe_div("cp", "cw"), F.lit(0.0)))
    if name == "ks":
        return F.greatest(F.max(tpr - fpr), F.lit(0.0))
    if name == "brier":
        return safe_div(F.sum(F.col("sq")), F.sum("w"))
    raise KeyError(f"unknown metric {name}; choose roc_auc, pr_auc, ks or brier")


METRICS = ("roc_auc", "pr_auc", "ks", "brier")


def replicate_metric(weighted: DataFrame, by: Sequence[str], metric: str, out: str = "value",
                     edges: Sequence[float] = ()) -> DataFrame:
    """Weighted metric per replicate from cells (bucket, w, wp, sq).

    With bucketed scores a replicate has a bounded number of cells and one window holds them.
    With exact scores the running totals are cut at ``edges`` like any other.
    """
    by = list(by)
    run = distributed_cumsum(weighted, by, "bucket", {"cw": "w", "cp": "wp"}, edges, descending=True,
                             totals={"tw": "w", "tp": "wp"})
    # A resample with a single class has no metric and is skipped.
    both = run.where((F.col("tp") > 0) & (F.col("tw") > F.col("tp")))
    return both.groupBy(*by).agg(_metric(metric).alias(out))


def _observed(scores: DataFrame, by: Sequence[str], metric: str, y: str, p: str) -> DataFrame:
    """The metric of the sample itself, from distinct scores and without buckets."""
    if metric not in METRICS:
        raise KeyError(f"unknown metric {metric}; choose {', '.join(METRICS)}")
    return getattr(metrics, metric)(scores, by=list(by), y=y, p=p).withColumnRenamed(metric, "_exact")


def bootstrap_values(scores: DataFrame, metric: str = "roc_auc", reps: int = 200,
                     by: Sequence[str] = ("model",), y: str = "y", p: str = "p",
                     buckets: int | None = None, seed: int = 42) -> DataFrame:
    """Metric per replicate. Replicate 0 is the sample itself (every weight is the count).

    Every distinct score is a cell of its own; ``buckets`` merges them into about that many. Rows without a label or a
    score take no part, as in the exact metrics.
    """
    scores = scores.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    if buckets is None:
        cut = scores.withColumn("bucket", F.col(p).cast("double"))
        edges = quantile_edges(scores, p)
    else:
        cut = with_bucket(scores, p, quantile_edges(scores, p, buckets=buckets), "bucket")
        edges = []
    cells = cut.groupBy(*by, "bucket", F.col(y).cast("int").alias("_y")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("_sq"))
    cells = with_replicates(cells, reps)
    w = F.when(F.col("rep") == 0, F.col("_n").cast("double")).otherwise(
        poisson_draw(F.col("_n"), F.lit(seed), F.col("rep"), F.col("bucket"), F.col("_y")))
    weighted = (cells.withColumn("_w", w)
                .groupBy(*by, "rep", "bucket")
                .agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_y")).alias("wp"),
                     F.sum(F.col("_w") * F.col("_sq")).alias("sq")))
    return replicate_metric(weighted, [*by, "rep"], metric, edges=edges)


def bootstrap_ci(scores: DataFrame, metric: str = "roc_auc", reps: int = 200, alpha: float = 0.05,
                 by: Sequence[str] = ("model",), y: str = "y", p: str = "p",
                 buckets: int | None = None, seed: int = 42, max_n: int | None = None,
                 row_id: str = "row_id") -> DataFrame:
    """Percentile interval of a metric per model: value, lower, upper, width.

    The value is exact. If ``buckets`` merges scores, the constant error of that, known from
    replicate 0, is taken out of the bounds. ``max_n`` optionally caps the rows as a
    conservative choice; by default none is left out.
    """
    src = cap_sample(scores, max_n, row_id, seed) if max_n else scores
    exact = _observed(src, by, metric, y, p)
    values = bootstrap_values(src, metric, reps, by, y, p, buckets, seed)
    again = F.when(F.col("rep") > 0, F.col("value"))
    bounds = values.groupBy(*by).agg(
        F.max(F.when(F.col("rep") == 0, F.col("value"))).alias("_zero"),
        F.percentile(again, alpha / 2).alias("_lo"), F.percentile(again, 1 - alpha / 2).alias("_hi"),
        F.count(again).alias("replicates"))
    shift = F.col("_exact") - F.col("_zero")
    return exact.join(bounds, list(by)).select(
        *by, F.col("_exact").alias(metric), (F.col("_lo") + shift).alias("ci_lower"),
        (F.col("_hi") + shift).alias("ci_upper"), (F.col("_hi") - F.col("_lo")).alias("ci_width"),
        "replicates")


def paired_bootstrap(pairs: DataFrame, p_a: str = "p_a", p_b: str = "p_b", y: str = "y",
                     metric: str = "roc_auc", reps: int = 200, by: Sequence[str] = (),
                     buckets: int | None = None, seed: int = 42) -> DataFrame:
    """Difference metric(B) - metric(A) with both models under the same resamples.

    Rows with equal scores of A, of B and equal class are merged, with ``buckets`` also those with
    scores in the same of about that many; one draw per merged cell weights both models. The difference itself is exact. The two-sided p-value is twice the smaller
    share of sign changes.
    """
    pairs = pairs.where(F.col(y).isNotNull() & F.col(p_a).isNotNull() & F.col(p_b).isNotNull())
    wanted, by = list(by), list(by) or ["_all"]
    if not wanted:
        pairs = pairs.withColumn("_all", F.lit(0))
    sides = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col(p_a).alias("p")),
                              F.struct(F.lit("b").alias("side"), F.col(p_b).alias("p"))))
    long = pairs.select(*by, y, sides.alias("s")).select(*by, y, "s.side", "s.p")
    edges = quantile_edges(long, "p") if buckets is None else []
    exact = _observed(long, [*by, "side"], metric, y, "p").groupBy(*by).agg(
        (F.max(F.when(F.col("side") == "b", F.col("_exact")))
         - F.max(F.when(F.col("side") == "a", F.col("_exact")))).alias("difference"))

    if buckets is None:
        cut = pairs.withColumns({"_ba": F.col(p_a).cast("double"), "_bb": F.col(p_b).cast("double")})
    else:
        merged = quantile_edges(long, "p", buckets=buckets)
        cut = with_bucket(with_bucket(pairs, p_a, merged, "_ba"), p_b, merged, "_bb")
    err = [F.avg(F.pow(F.col(c) - F.col(y), 2)) for c in (p_a, p_b)]
    cells = cut.groupBy(*by, "_ba", "_bb", F.col(y).cast("int").alias("_y")).agg(
        F.count(F.lit(1)).alias("_n"), err[0].alias("_sa"), err[1].alias("_sb"))
    cells = with_replicates(cells, reps)
    w = F.when(F.col("rep") == 0, F.col("_n").cast("double")).otherwise(poisson_draw(
        F.col("_n"), F.lit(seed), F.col("rep"), F.col("_ba"), F.col("_bb"), F.col("_y")))
    cell_sides = F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("_ba").alias("bucket"), F.col("_sa").alias("e")),
        F.struct(F.lit("b").alias("side"), F.col("_bb").alias("bucket"), F.col("_sb").alias("e"))))
    weighted = (cells.withColumn("_w", w).select(*by, "rep", "_y", "_w", cell_sides.alias("s"))
                .groupBy(*by, "rep", F.col("s.side").alias("side"), F.col("s.bucket").alias("bucket"))
                .agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_y")).alias("wp"),
                     F.sum(F.col("_w") * F.col("s.e")).alias("sq")))
    per_side = replicate_metric(weighted, [*by, "rep", "side"], metric, edges=edges)
    diff = per_side.groupBy(*by, "rep").agg(
        (F.max(F.when(F.col("side") == "b", F.col("value")))
         - F.max(F.when(F.col("side") == "a", F.col("value")))).alias("d"))
    zero = diff.where(F.col("rep") == 0).select(*by, F.col("d").alias("_zero"))
    moved = (diff.where(F.col("rep") > 0).join(zero, by).join(exact, by)
             .withColumn("d", F.col("d") + (F.col("difference") - F.col("_zero"))))
    share_lo, share_hi = F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))
    return moved.groupBy(*by).agg(
        F.max("difference").alias("difference"), F.percentile("d", 0.025).alias("ci_lower"),
        F.percentile("d", 0.975).alias("ci_upper"),
        F.least(2 * F.least(share_lo, share_hi), F.lit(1.0)).alias("p_value"),
    ).select(*wanted, "difference", "ci_lower", "ci_upper", "p_value")


def model_comparison(scores: DataFrame, winner: str, row_id: str = "row_id", y: str = "y",
                     p: str = "p", baseline: str | None = None, metric: str = "roc_auc",
                     reps: int = 200, buckets: int | None = None, seed: int = 42) -> DataFrame:
    """The winner against every other model; the constant baseline does not take part."""
    real = scores if baseline is None else scores.where(F.col("model") != baseline)
    best = real.where(F.col("model") == winner).select(row_id, F.col(p).alias("p_b"))
    others = (real.where(F.col("model") != winner)
              .select(row_id, "model", y, F.col(p).alias("p_a")).join(best, row_id))
    out = paired_bootstrap(others, "p_a", "p_b", y, metric, reps, ["model"], buckets, seed)
    return out.select(F.concat(F.lit(f"{winner} - "), "model").alias("comparison"),
                      "difference", "ci_lower", "ci_upper", "p_value",
                      (F.col("p_value") < 0.05).alias("significant_5pct"))
