"""Descriptive statistics of outcomes and features, at group and unit grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import partial_corr, pearson_p_value, rate, safe_corr
from cohortlens.operators.ordering import even_edges, exact_quantiles, quantiles_by

# Names and probabilities of the dispersion quantiles.
DISPERSION = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def long_form(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(kept columns, feature, value): one scan for any number of features."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                         F.col(f).cast("double").alias("value")) for f in features]))
    return df.select(*keep, cells.alias("s")).select(*keep, "s.feature", "s.value")


def feature_target_correlation(groups: DataFrame, features: Sequence[str], outcome: str,
                               min_n: int = 100, min_distinct: int = 3,
                               p_values: bool = True) -> DataFrame:
    """Pearson r of every numeric feature with the outcome, strongest first.

    Distinct values beyond the minimum do not matter, so they are tested with minimum,
    maximum and a value strictly between, not counted.
    """
    long = long_form(groups, features, [outcome]).where(F.col("value").isNotNull())
    edges = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # One row per feature: the schema bounds it.
    joined = long.join(F.broadcast(edges), "feature")
    stats = joined.groupBy("feature").agg(
        safe_corr("value", outcome).alias("r"), F.count(F.lit(1)).alias("n"),
        F.max((F.col("lo") < F.col("hi")).cast("int")).alias("two"),
        F.max(((F.col("lo") < F.col("value")) & (F.col("value") < F.col("hi"))).cast("int")).alias("three"))
    levels = 1 + F.col("two") + F.col("three")
    out = stats.where((F.col("n") >= min_n) & (levels >= min(min_distinct, 3))).select("feature", "r", "n")
    if p_values:
        out = out.withColumn("p_value", pearson_p_value("r", F.col("n").cast("double")))
    return out.orderBy(F.abs("r").desc_nulls_last(), "feature")


def persistence(df: DataFrame, unit: str, year: str, y0: int, y1: int, target: str,
                min_n: int = 30) -> DataFrame:
    """Correlation of a unit's rate in two years, over units large enough in both."""
    hit = F.col(target).cast("int").cast("double")

    def at(y: int) -> list:
        here = F.col(year) == y
        return [F.count_if(here).alias(f"n_{y}"), F.avg(F.when(here, hit)).alias(f"r_{y}")]

    per_unit = df.where(F.col(year).isin(y0, y1)).groupBy(unit).agg(*at(y0), *at(y1))
    both = per_unit.where((F.col(f"n_{y0}") >= min_n) & (F.col(f"n_{y1}") >= min_n))
    return both.agg(safe_corr(f"r_{y0}", f"r_{y1}").alias("r"), F.count(F.lit(1)).alias("n_units"))


def dispersion(df: DataFrame, unit: str, year: str, target: str, min_n: int = 30) -> DataFrame:
    """Quantiles of the unit rates (percent) per year. Rates lie in [0, 100]: known edges."""
    units = df.groupBy(year, unit).agg(F.count(F.lit(1)).alias("n"), (rate(target) * 100).alias("pct"))
    return quantiles_by(units.where(F.col("n") >= min_n), [year], "pct", DISPERSION,
                        even_edges(0.0, 100.0, 64), n="n_units")


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Inner bin edges per feature without duplicates, exact."""
    probs = [i / bins for i in range(bins + 1)]
    out = {}
    for f, values in exact_quantiles(df, features, probs).items():
        distinct = sorted({v for v in values if v is not None})
        out[f] = distinct[1:-1]
    return out


def decile_profile(df: DataFrame, features: Sequence[str], target: str, bins: int = 10,
                   min_rows: int = 1000, min_distinct: int = 50) -> DataFrame:
    """Outcome rate per quantile bin of each feature, with the amplitude over the bins.

    Features with few rows or few distinct values are left out: their bins are artefacts.
    """
    counts = df.agg(*[x for i, f in enumerate(features) for x in (
        F.count(F.when(F.col(target).isNotNull(), F.col(f))).alias(f"n{i}"),
        F.approx_count_distinct(f, 0.02).alias(f"d{i}"))]).first()
    near = [f for i, f in enumerate(features) if counts[f"d{i}"] < 4 * min_distinct]
    exact = (df.agg(*[F.count_distinct(f).alias(f) for f in near]).first().asDict() if near else {})
    usable = [f for i, f in enumerate(features) if counts[f"n{i}"] >= min_rows
              and exact.get(f, counts[f"d{i}"]) >= min_distinct]
    if not usable:
        return df.sparkSession.createDataFrame(
            [], "feature string, bin int, n bigint, rate double, amplitude double")
    known = df.where(F.col(target).isNotNull())
    cuts = quantile_cuts(known, usable, bins)
    cells = F.explode(F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col(f).isNotNull().alias("known"),
        sum((F.when(F.col(f) > e, 1).otherwise(0) for e in cuts[f]), F.lit(0)).alias("bin"))
        for f in usable]))
    binned = known.select(F.col(target).cast("int").cast("double").alias("_y"), cells.alias("s")).where("s.known")
    table = binned.groupBy(F.col("s.feature").alias("feature"), F.col("s.bin").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("rate"))
    spread = table.groupBy("feature").agg((F.max("rate") - F.min("rate")).alias("amplitude"))
    return table.join(spread, "feature")


def correlation_within(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """r of x and y inside each stratum."""
    return df.groupBy(by).agg(safe_corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))


def partial_correlation(df: DataFrame, x: str, y: str, control: str) -> DataFrame:
    """r of x and y, plain and with one variable held fixed (complete rows only)."""
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(control).isNotNull())
    r = full.agg(safe_corr(x, y).alias("r"), safe_corr(x, control).alias("_xz"),
                 safe_corr(y, control).alias("_yz"), F.count(F.lit(1)).alias("n"))
    return r.select("r", partial_corr(F.col("r"), F.col("_xz"), F.col("_yz")).alias("r_partial"), "n")


def map_points(groups: DataFrame, year: str, lat: str, lon: str, outcome: str,
               keep: Sequence[str] = ()) -> DataFrame:
    """Located groups of the latest year with their rate in percent."""
    latest = groups.agg(F.max(year).alias("y")).first()["y"]
    return (groups.where((F.col(year) == latest) & F.col(lat).isNotNull())
            .select(*keep, lat, lon, (F.col(outcome) * 100).alias("rate_pct")))
