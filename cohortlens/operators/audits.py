"""Audits that expose label leakage, unstable keys, drift and thin coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import rate, safe_corr, safe_div


def deterministic_label_audit(df: DataFrame, flags: Sequence[str], target: str) -> DataFrame:
    """Rows and target rate per combination of flags; a rate of exactly 0 or 1 is suspicious."""
    hit = F.col(target).cast("int")
    return df.groupBy(*flags).agg(
        F.count(F.lit(1)).alias("n"), rate(target).alias("rate"),
        F.coalesce(F.min(hit) == F.max(hit), F.lit(False)).alias("deterministic"))


def label_identity_audit(df: DataFrame, score: str, cut: float, target: str) -> DataFrame:
    """Does the hidden score reproduce the label? Rows that agree and that disagree."""
    implied = F.col(score) >= cut
    return df.agg(F.count_if(implied == F.col(target)).alias("agree"),
                  F.count_if(implied != F.col(target)).alias("disagree"))


def leak_correlation_audit(ctx: DataFrame, features: Sequence[str], keys: Sequence[str],
                           year: str, outcome: str) -> DataFrame:
    """Correlation of each feature with the same year's and the next year's outcome.

    A feature that follows its own year far better than the next was computed from the
    outcome. ``n_repeated`` counts values that recur unchanged in the following year.
    """
    nxt = ctx.select(*keys, (F.col(year) - 1).alias(year), F.col(outcome).alias("_next"),
                     *[F.col(c).alias(f"_n_{c}") for c in features])
    both = ctx.join(nxt, [*keys, year], "left")
    long = both.select(year, F.col(outcome).alias("_same"), "_next", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"),
                 F.col(f"_n_{c}").cast("double").alias("nv")) for c in features])).alias("s"))
    return long.groupBy(F.col("s.feature").alias("feature"), year).agg(
        safe_corr("s.v", "_same").alias("r_same_year"), safe_corr("s.v", "_next").alias("r_next_year"),
        F.count_if(F.col("s.v") == F.col("s.nv")).alias("n_repeated"),
        F.count("s.nv").alias("n_compared"))


def key_overlap_audit(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Distinct keys of ``a`` with and without a partner in ``b``."""
    left = a.select(F.col(key_a).alias("k")).where(F.col("k").isNotNull()).distinct()
    right = b.select(F.col(key_b).alias("k")).where(F.col("k").isNotNull()).distinct()
    found = left.join(right.withColumn("hit", F.lit(1)), "k", "left")
    return found.agg(F.count("hit").alias("matched"),
                     F.count_if(F.col("hit").isNull()).alias("unmatched"))


def key_stability_audit(df: DataFrame, key: str, attributes: Sequence[str], year: str, y0: int,
                        y1: int) -> DataFrame:
    """Keys present in both years, and how many still carry the same attribute."""
    per_key = df.where(F.col(year).isin(y0, y1)).groupBy(key).agg(
        F.max((F.col(year) == y0).cast("int")).alias("in0"),
        F.max((F.col(year) == y1).cast("int")).alias("in1"),
        *[F.min(F.when(F.col(year) == y, F.col(a))).alias(f"{a}_{i}")
          for a in attributes for i, y in ((0, y0), (1, y1))])
    both = per_key.where((F.col("in0") == 1) & (F.col("in1") == 1))
    same = {a: F.count_if(F.col(f"{a}_0") == F.col(f"{a}_1")) for a in attributes}
    return both.agg(F.count(F.lit(1)).alias("n_both"),
                    *[c.alias(f"same_{a}") for a, c in same.items()],
                    *[safe_div(c, F.count(F.lit(1))).alias(f"share_{a}") for a, c in same.items()])


def require_stable_key(df: DataFrame, key: str, attribute: str, year: str, y0: int, y1: int,
                       minimum: float = 0.9) -> float:
    """Gate for features that follow a key through time; raises when the key was re-assigned."""
    row = key_stability_audit(df, key, [attribute], year, y0, y1).first()
    share = row[f"share_{attribute}"] or 0.0
    if share < minimum:
        raise ValueError(f"{key} keeps its {attribute} in only {share:.1%} of {row['n_both']} keys; "
                         "a feature across years would join different units")
    return share


def coverage_matrix(df: DataFrame, year: str, blocks: Mapping[str, str]) -> DataFrame:
    """Percent of rows per year that found each context block (judged by one of its columns)."""
    return df.groupBy(year).agg(F.count(F.lit(1)).alias("n"), *[
        (F.avg(F.col(c).isNotNull().cast("int").cast("double")) * 100).alias(name)
        for name, c in blocks.items()])


def level_drift(df: DataFrame, parent: str, group: str, year: str, y0: int, y1: int,
                target: str) -> DataFrame:
    """Rate change per parent in percentage points, with rows and groups of one year only.

    Group rows are reduced first, so a parent with a third of the rows is not one task.
    """
    hit = F.col(target).cast("int")
    per_group = df.where(F.col(year).isin(y0, y1)).groupBy(parent, group).agg(*[
        x for i, y in ((0, y0), (1, y1)) for x in (
            F.count_if(F.col(year) == y).alias(f"n{i}"),
            F.count(F.when(F.col(year) == y, hit)).alias(f"m{i}"),
            F.sum(F.when(F.col(year) == y, hit)).alias(f"p{i}"))])
    r0, r1 = safe_div(F.sum("p0"), F.sum("m0")), safe_div(F.sum("p1"), F.sum("m1"))
    return per_group.groupBy(parent).agg(
        F.sum("n0").alias("n_before"), F.sum("n1").alias("n_after"),
        r0.alias("rate_before"), r1.alias("rate_after"), ((r1 - r0) * 100).alias("change_pp"),
        F.count_if((F.col("n0") == 0) & (F.col("n1") > 0)).alias("groups_only_after"),
        F.count_if((F.col("n0") > 0) & (F.col("n1") == 0)).alias("groups_only_before"),
        F.sum(F.when(F.col("n0") == 0, F.col("n1")).otherwise(0)).alias("rows_in_new_groups"))


def weight_shift_audit(df: DataFrame, weight: str, year: str, target: str) -> DataFrame:
    """Distinct values, range and target correlation of a sampling weight, per year."""
    y = F.col(target).cast("int").cast("double")
    levels = df.groupBy(year, weight).agg(F.count(F.lit(1)).alias("_r")).groupBy(year).agg(
        F.count(weight).alias("n_distinct"))
    stats = df.groupBy(year).agg(F.min(weight).alias("lowest"), F.max(weight).alias("highest"),
                                 safe_corr(F.col(weight), y).alias("r_target"))
    return stats.join(levels, year)


def negative_control(df: DataFrame, control: str, target: str) -> DataFrame:
    """Range and spread of the target rate over a column that should not matter."""
    levels = df.groupBy(control).agg(rate(target).alias("r"))
    return levels.agg(F.count(F.lit(1)).alias("n_levels"), (F.max("r") - F.min("r")).alias("range"),
                      F.stddev_pop("r").alias("spread"))


def participation_rate(df: DataFrame, keys: Sequence[str], present: str | Column) -> DataFrame:
    c = F.col(present) if isinstance(present, str) else present
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rate(c).alias("participation"))
