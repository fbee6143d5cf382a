"""From scores to decisions: risk rankings, residuals, clusters and target risk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import norm_cdf, right_closed_cut, safe_corr, safe_div
from cohortlens.operators.aggregates import value_counts
from cohortlens.operators.joins import attach_targets
from cohortlens.operators.ordering import (
    bottom_k, even_edges, exact_quantiles, peer_adjust, quantiles_by, top_k)
from cohortlens.session import stage

# Risk classes and their right-closed upper edges.
RISK_EDGES = (0.20, 0.50, 0.80)
RISK_LABELS = ("likely met", "attention", "high risk", "critical risk")

# Context variables that describe a municipality for clustering.
PROFILE_VARIABLES = [
    "ses_ivs", "ses_log_renda_per_capita", "ses_idhm_educacao", "ses_idade_mediana",
    "ses_share_pop_5a9", "ses_taxa_alfab_adultos_25a44", "ses_taxa_pbf", "inse_medio",
    "edu_tdi_anos_iniciais", "edu_docentes_superior_ai", "inf_pct_internet_aprendizagem",
    "inf_alunos_por_turma_ai", "fin_invest_aluno_ens_fund",
]


def group_risk_ranking(scores: DataFrame, group: str, parent: str, y: str = "y", p: str = "p",
                       labels: Sequence[str] = (), min_n: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Predicted and observed rate per group, with the residual adjusted for its parent.

    ``by`` names keys, such as the model, that each have a ranking of their own.

    The standard error is the Bernoulli one, sqrt(sum p (1 - p)) / n. Residuals lie in
    [-1, 1], so the parents' medians use known bucket edges and need no extra job.
    """
    g = scores.groupBy(*by, group).agg(
        F.min(parent).alias(parent), *[F.min(c).alias(c) for c in labels],
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"),
        F.avg(F.col(y).cast("double")).alias("observed"),
        F.sum(F.col(p) * (1 - F.col(p))).alias("_var")).where(F.col("n") >= min_n)
    g = (g.withColumn("std_error", F.sqrt("_var") / F.col("n"))
         .withColumn("residual", F.col("observed") - F.col("predicted"))
         .withColumn("residual_z", safe_div("residual", "std_error"))
         .withColumn("risk", 1 - F.col("predicted")).drop("_var"))
    adjusted = peer_adjust(g, "residual", [*by, parent], "adjusted_residual", "parent_residual",
                           even_edges(-1.0, 1.0, 64))
    return adjusted.orderBy(*by, F.desc_nulls_last("risk"), group)


def aggregate_calibration(ranking: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How well predicted group rates meet the observed ones (errors in percentage points)."""
    err = F.col("predicted") - F.col("observed")
    base = ranking.select(*by, "predicted", "observed", err.alias("e"), F.abs(err).alias("a"))
    stats = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_groups"), safe_corr("predicted", "observed").alias("correlation"),
        (F.avg("a") * 100).alias("mae_pp"), (F.avg("e") * 100).alias("bias_pp"),
        (1 - F.try_divide(F.sum(F.col("e") * F.col("e")),
                          F.var_pop("observed") * F.count("observed"))).alias("r2"))
    mid = quantiles_by(base, list(by), "a", {"median": 0.5}, even_edges(0.0, 1.0, 64))
    return (stats.withColumn("_k", F.lit(1)).join(mid.withColumn("_k", F.lit(1)), [*by, "_k"], "left")
            .select(*by, "n_groups", "correlation", "mae_pp",
                    (F.col("median") * 100).alias("median_error_pp"), "bias_pp", "r2"))


def cluster_groups(groups: DataFrame, key: str, variables: Sequence[str], outcome: str, k: int = 5,
                   starts: int = 10, seed: int = 42) -> DataFrame:
    """Groups clustered by context; labels 1..k in ascending order of the mean outcome.

    The outcome takes no part in the clustering. The best of several seeded starts counts.
    """
    variables = [v for v in variables if v in groups.columns]
    src = groups.where(F.col(key).isNotNull())
    medians = exact_quantiles(src, variables, [0.5])
    filled = src.select("*", *[
        F.coalesce(F.col(v).cast("double"), F.lit(medians[v][0])).alias(f"_v{i}")
        for i, v in enumerate(variables)])
    names = [f"_v{i}" for i in range(len(variables))]
    m = filled.agg(*[x for c in names for x in (
        F.avg(c).alias(f"m{c}"), F.stddev_pop(c).alias(f"s{c}"))]).first()
    scaled = filled.withColumns({
        c: (F.col(c) - m[f"m{c}"]) / (m[f"s{c}"] or 1.0) for c in names})
    rows = stage(scaled.select(*groups.columns, F.array(*names).alias("_x")), "cluster-rows")
    centres = best_centres(rows, "_x", key, k, starts, seed)
    nearest = F.array_min(F.array(*[F.struct(sum((F.pow(F.get("_x", F.lit(j)) - float(v), 2) for j, v in enumerate(c)), F.lit(0.0)).alias("d"), F.lit(i).alias("c"))
                                    for i, c in enumerate(centres)]))["c"]
    dealt = rows.select(*groups.columns, nearest.alias("_cluster"))
    order = dealt.groupBy("_cluster").agg(F.avg(outcome).alias("o")).orderBy("o", "_cluster").collect()  # k rows
    relabel = F.create_map(*[F.lit(x) for i, r in enumerate(order, 1) for x in (r["_cluster"], i)])
    return dealt.select(*groups.columns, relabel[F.col("_cluster")].alias("cluster"))


#: Rows that first centres are drawn from at most, those with the smallest hash of their key; all rows move centres.
SEED_ROWS = 10_000


def best_centres(rows: DataFrame, column: str, key: str, k: int, starts: int, seed: int = 42, iterations: int = 50, tolerance: float = 1e-4) -> np.ndarray:
    """Centres (k, dimensions) of the cheapest of several k-means runs over (column array<double>).

    All starts move together: an iteration is one aggregate of counts, sums and squared distances per (start, cluster),
    summed within tasks first. First centres are drawn with chances growing with the squared distance to those drawn before.
    A start rests once no centre moves by more than ``tolerance``; a cluster that loses all rows keeps its centre.
    """
    n = rows.count()
    pool = rows if n <= SEED_ROWS else rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(SEED_ROWS / n * (1 << 30)))
    points = np.array([r[0] for r in pool.orderBy(F.xxhash64(key), key).select(column).collect()], float)
    if not len(points):
        return np.zeros((1, 0))
    rng, k = np.random.default_rng(seed), min(k, len(np.unique(points, axis=0)))
    centres = np.empty((starts, k, points.shape[1]))
    for s in range(starts):
        centres[s, 0] = points[rng.integers(len(points))]
        for c in range(1, k):
            far = ((points[:, None] - centres[s, None, :c]) ** 2).sum(2).min(1)
            centres[s, c] = points[rng.choice(len(points), p=far / far.sum())]

    def assign(now: np.ndarray):
        def sums(batches):
            total = np.zeros((*now.shape[:2], now.shape[2] + 2))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for s, c in enumerate(now):
                    d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
                    near = d.argmin(1)
                    cost = np.maximum(d[np.arange(len(x)), near], 0.0)
                    for j, w in enumerate((np.ones(len(x)), cost, *x.T)):
                        total[s, :, j] += np.bincount(near, w, len(c))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total[..., 0].size, dtype=np.int32)), pa.array(total.reshape(-1, total.shape[2]).tolist(), pa.list_(pa.float64()))], ["at", "v"])

        parts = rows.select(column).mapInArrow(sums, "at int, v array<double>")
        width = now.shape[2] + 2
        found = parts.groupBy("at").agg(F.array(*[F.sum(F.get("v", F.lit(j))) for j in range(width)]).alias("v")).collect()  # starts x k rows
        out = np.zeros((now.shape[0] * now.shape[1], width))
        for r in found:
            out[r["at"]] = r["v"]
        return out.reshape(*now.shape[:2], width)

    for _ in range(iterations):
        told = assign(centres)
        held = told[..., :1] > 0
        moved = np.where(held, told[..., 2:] / np.maximum(told[..., :1], 1), centres)
        still = np.sqrt(((moved - centres) ** 2).sum(2)).max() <= tolerance
        centres = moved
        if still:
            break
    cost = assign(centres)[..., 1].sum(1)
    return centres[int(cost.argmin())]


def cluster_profile(clustered: DataFrame, variables: Sequence[str], outcome: str,
                    cluster: str = "cluster") -> DataFrame:
    return clustered.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_groups"), F.avg(outcome).alias("observed"),
        *[F.avg(v).alias(v) for v in variables])


def characterize(profile: DataFrame, variables: Sequence[str], n: int = 4,
                 cluster: str = "cluster") -> DataFrame:
    """The variables in which each cluster departs most from the mean of the clusters.

    The input has one row per cluster, so its windows are tiny.
    """
    long = profile.unpivot([cluster, "n_groups", "observed"], list(variables), "variable", "v")
    w = Window.partitionBy("variable")
    z = F.try_divide(F.col("v") - F.avg("v").over(w), F.stddev_pop("v").over(w))
    top = Window.partitionBy(cluster).orderBy(F.abs("z").desc(), "variable")
    marked = (long.withColumn("z", z).where(F.col("z").isNotNull())
              .withColumn("r", F.row_number().over(top)).where(F.col("r") <= n)
              .withColumn("mark", F.concat(F.when(F.col("z") > 0, "↑ ").otherwise("↓ "), "variable")))
    lists = marked.groupBy(cluster).agg(F.concat_ws(" · ", F.transform(
        F.array_sort(F.collect_list(F.struct("r", "mark"))), lambda s: s["mark"])).alias("traits"))
    return profile.select(cluster, "n_groups", "observed").join(lists, cluster, "left")


def risk_class(p: str | Column) -> Column:
    return right_closed_cut(p, RISK_EDGES, RISK_LABELS)


def target_miss_risk(ranking: DataFrame, targets: DataFrame, key: str, target_pct: str) -> DataFrame:
    """Probability that a group's rate falls short of its agreed target (given in percent).

    Normal limit of a mean of independent Bernoulli outcomes; no standard error, no answer.
    """
    df = attach_targets(ranking, targets, key, [target_pct])
    # "goal" is read back as a column: the target may itself bear that name.
    return (df.withColumn("goal", F.col(target_pct) / 100.0)
            .withColumn("gap_pp", (F.col("predicted") - F.col("goal")) * 100)
            .withColumn("p_miss", norm_cdf(safe_div(F.col("goal") - F.col("predicted"), "std_error")))
            .withColumn("risk_class", risk_class("p_miss"))
            .orderBy(F.desc_nulls_last("p_miss"), key))


def decision_report(ranking: DataFrame, risk: DataFrame | None, key: str, parent: str,
                    min_n: int = 100, k_risk: int = 15, k_residual: int = 10,
                    concentration: int = 5) -> Mapping[str, DataFrame]:
    """The short lists a decision maker reads; each is a small table of its own."""
    eligible = ranking.where(F.col("n") >= min_n)
    out = {
        "top_risk": top_k(eligible, "risk", k_risk, key),
        "worst_residuals": bottom_k(eligible, "adjusted_residual", k_residual, key),
        "best_residuals": top_k(eligible, "adjusted_residual", k_residual, key),
    }
    if risk is not None:
        judged = risk.where(F.col("n") >= min_n)
        gaps = bottom_k(judged.where(F.col("gap_pp").isNotNull()), "gap_pp", k_risk, key)
        out["class_counts"] = value_counts(judged.where(F.col("risk_class").isNotNull()), "risk_class")
        out["largest_gaps"] = gaps
        out["parent_concentration"] = value_counts(gaps, parent).where(F.col("n") >= concentration)
    return out
