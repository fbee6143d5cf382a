"""Group aggregations. Each is one partial-plus-final aggregate: a hot key is combined on
the map side, so its rows never meet in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import as_col, rate, safe_div


def outcome_by(df: DataFrame, keys: Sequence[str], target: str, unit: str | None = None,
               n: str = "n", units: str = "n_units", out: str = "rate") -> DataFrame:
    """Rows, distinct sub-units and mean outcome per key.

    Sub-units are reduced to one row per (key, unit) first, so a hot key is spread over its
    units before it is counted.
    """
    hit = F.col(target).cast("int")
    if unit is None:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), rate(target).alias(out))
    inner = df.groupBy(*keys, unit).agg(F.count(F.lit(1)).alias("_n"), F.count(hit).alias("_m"),
                                        F.sum(hit).alias("_pos"))
    return inner.groupBy(*keys).agg(
        F.sum("_n").alias(n), F.count(unit).alias(units),
        safe_div(F.sum("_pos"), F.sum("_m")).alias(out))


def weighted_rollup(df: DataFrame, keys: Sequence[str], flags: Mapping[str, str | Column],
                    weight: str | Column, null_policy: str = "as_zero",
                    extra: Sequence[Column] = ()) -> DataFrame:
    """Weighted share of several flags in one pass.

    ``as_zero``: a missing flag leaves the numerator, its weight stays in the denominator.
    ``skip``: the weight of a missing flag leaves the denominator too.
    """
    w = as_col(weight)

    def base(c: Column) -> Column:
        return F.sum(w) if null_policy == "as_zero" else F.sum(F.when(c.isNotNull(), w))

    shares = [safe_div(F.sum(as_col(c) * w), base(as_col(c))).alias(out)
              for out, c in flags.items()]
    return df.groupBy(*keys).agg(*extra, *shares)


def ratio_of_sums(df: DataFrame, keys: Sequence[str],
                  pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    return df.groupBy(*keys).agg(*[
        safe_div(F.sum(a), F.sum(b)).alias(out) for out, (a, b) in pairs.items()])


def conditional_pivot(df: DataFrame, keys: Sequence[str],
                      specs: Mapping[str, tuple[Column, str | Column]],
                      code: str | None = None) -> DataFrame:
    """Long to wide: one column per (predicate, value) pair, all in a single aggregate.

    With ``code`` the predicates may be given as bare code values; the scan is then filtered
    to exactly the codes that the specification names, so filter and columns cannot diverge.
    """
    if code is not None:
        wanted = sorted({c for c, _ in specs.values()})
        df = df.where(F.col(code).isin(wanted))
        specs = {out: (F.col(code) == c, v) for out, (c, v) in specs.items()}
    return df.groupBy(*keys).agg(*[
        F.max(F.when(cond, as_col(value))).alias(out) for out, (cond, value) in specs.items()])


def share_where(df: DataFrame, keys: Sequence[str], value: str,
                shares: Mapping[str, tuple[Column, Column | None]]) -> DataFrame:
    """Share of a quantity under a condition; the denominator may have its own condition."""
    def total(cond: Column | None) -> Column:
        return F.sum(value) if cond is None else F.sum(F.when(cond, F.col(value)).otherwise(0))

    return df.groupBy(*keys).agg(*[
        safe_div(F.sum(F.when(cond if base is None else cond & base, F.col(value)).otherwise(0)),
                 total(base)).alias(out)
        for out, (cond, base) in shares.items()])


def group_profile(df: DataFrame, keys: Sequence[str], value: str, label: str,
                  condition: Column, prefix: str = "") -> DataFrame:
    """Count, representative label, spread, minimum and percent of rows under a condition.

    The label is the smallest one instead of an arbitrary one, so reruns agree.
    """
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"{prefix}n"),
        F.min(label).alias(f"{prefix}{label}"),
        F.stddev_samp(value).alias(f"{prefix}spread"),
        F.min(value).alias(f"{prefix}minimum"),
        (safe_div(F.count_if(condition), F.count(F.lit(1))) * 100).alias(f"{prefix}pct"))


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str,
                  out: str = "weighted_mean") -> DataFrame:
    return df.groupBy(*keys).agg(
        safe_div(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(out))


def ratio_of_means(df: DataFrame, keys: Sequence[str], pairs: Mapping[str, tuple[str, str]],
                   extra: Sequence[Column] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*extra, *[
        safe_div(F.avg(a), F.avg(b)).alias(out) for out, (a, b) in pairs.items()])


def count_sum_by(df: DataFrame, keys: Sequence[str], value: str, where: Column | None = None,
                 n: str = "n", total: str = "total") -> DataFrame:
    """Rows and sum per key. Counts rows, not distinct holders: one pass, no distinct shuffle."""
    src = df if where is None else df.where(where)
    return src.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), F.sum(value).alias(total))


def parent_deviation(df: DataFrame, keys: Sequence[str], child: str, parent: str, value: str,
                     weight: str) -> DataFrame:
    """Weighted mean of each child minus the one of its parent.

    The fact is aggregated once to child grain; the parent is summed from that small table.
    """
    sums = df.groupBy(*keys, parent, child).agg(
        F.sum(F.col(value) * F.col(weight)).alias("_xw"), F.sum(weight).alias("_w"))
    up = sums.groupBy(*keys, parent).agg(
        safe_div(F.sum("_xw"), F.sum("_w")).alias("parent_mean"))
    return (sums.join(up, [*keys, parent], "left")
            .withColumn("child_mean", safe_div("_xw", "_w"))
            .select(*keys, parent, child, "child_mean", "parent_mean",
                    (F.col("child_mean") - F.col("parent_mean")).alias("deviation")))


def shrunk_rate(df: DataFrame, keys: Sequence[str], child: str, parent: str, target: str,
                k: float = 30.0) -> DataFrame:
    """Child rate pulled towards its parent: (positives + k * parent rate) / (n + k)."""
    c = df.groupBy(*keys, parent, child).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("int")).alias("positives"))
    p = c.groupBy(*keys, parent).agg(
        safe_div(F.sum("positives"), F.sum("n")).alias("parent_rate"))
    shrunk = safe_div(F.col("positives") + k * F.col("parent_rate"), F.col("n") + k)
    return (c.join(p, [*keys, parent], "left")
            .select(*keys, parent, child, "n", safe_div("positives", "n").alias("raw_rate"),
                    "parent_rate", shrunk.alias("shrunk_rate"),
                    (shrunk - F.col("parent_rate")).alias("deviation")))


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str],
           descending: bool = False) -> DataFrame:
    """One row per key: the first in a total order (NULLS LAST, remaining columns break ties).

    An arg-min aggregate instead of a row-number window: candidates are combined on the map
    side, so a key with a third of the rows is not sorted in one task.
    """
    if not order:
        raise ValueError("dedupe needs an ordering")
    rest = [c for c in df.columns if c not in keys and c not in order]
    if not descending:
        ranked = [*order, *rest]
        rank = F.struct(*[x for c in ranked for x in (F.col(c).isNull(), F.col(c))])
        pick = F.min_by
    else:
        rank = F.struct(*[x for c in [*order, *rest] for x in (F.col(c).isNotNull(), F.col(c))])
        pick = F.max_by
    values = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(pick(F.struct(*values), rank).alias("_row"))
            .select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]))


def aggregate_groups(df: DataFrame, keys: Sequence[str], segment: str, target: str,
                     features: Sequence[str], labels: Sequence[str] = (), min_n: int = 30,
                     n: str = "n") -> DataFrame:
    """Group grain with the outcome rate and a representative value of every feature.

    Some features vary by segment inside a group. The representative is the value of the
    segment with most unit rows (ties: smallest segment name); missing values are passed
    over. The result does not depend on row order.
    """
    hit = F.col(target).cast("int")
    seg = df.groupBy(*keys, segment).agg(
        F.count(F.lit(1)).alias("_n"), F.count(hit).alias("_m"), F.sum(hit).alias("_pos"),
        *[F.max(c).alias(c) for c in [*features, *labels]])
    rank = F.struct(-F.col("_n"), F.col(segment))
    out = seg.groupBy(*keys).agg(
        F.sum("_n").alias(n), safe_div(F.sum("_pos"), F.sum("_m")).alias(target),
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c)
          for c in [*features, *labels]])
    return out.where(F.col(n) >= min_n)


def rate_by(df: DataFrame, dims: Sequence[str], target: str, min_n: int = 0) -> DataFrame:
    out = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), rate(target).alias("rate"))
    return out.where(F.col("n") >= min_n) if min_n else out


def missing_profile(df: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Percent of missing values per column, above zero only, largest first."""
    wide = df.agg(*[(F.avg(F.col(c).isNull().cast("int").cast("double")) * 100).alias(c)
                    for c in columns])
    long = (wide.unpivot([], list(columns), "feature", "pct_missing")
            .where(F.col("pct_missing") > 0)
            .orderBy(F.desc("pct_missing"), "feature"))
    return long if top is None else long.limit(top)


def value_counts(df: DataFrame, col: str, n: str = "n") -> DataFrame:
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias(n))
            .orderBy(F.desc(n), F.asc_nulls_last(col)))


def year_summary(df: DataFrame, year: str, target: str) -> DataFrame:
    return (df.groupBy(year).agg(F.count(F.lit(1)).alias("n"), rate(target).alias("rate"))
            .orderBy(year))


def union_sources(sources: Sequence[tuple[DataFrame, bool]], flag: str) -> DataFrame:
    """Union of sources by column name, with a boolean that tells where a row came from."""
    return reduce(DataFrame.unionByName, [df.withColumn(flag, F.lit(v)) for df, v in sources])


def distinct_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()
