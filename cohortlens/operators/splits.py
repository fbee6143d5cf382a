"""Partitions and samples decided by a portable hash: reproducible on any layout.

A split is a predicate over the row's own columns with literal bounds. Applying it is a
narrow filter: no join, no shuffle, the same answer after a lost task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.expr import HASH_RANGE, as_col, hash32
from cohortlens.operators.ordering import distributed_cumsum, quantile_edges

#: Values of one digit of a hash; two digits make the whole hash.
DIGIT = 65_536
#: Rows of one hash range that may be ranked together.
RANKED = 100_000
#: A group is large if its rows, times this and the number of folds, exceed all rows.
LARGE = 1000


def temporal_split(df: DataFrame, year: str, train_year: int,
                   test_year: int) -> tuple[DataFrame, DataFrame]:
    """Train on one year, test on another."""
    if train_year == test_year:
        raise ValueError("train and test year must differ")
    return df.where(F.col(year) == train_year), df.where(F.col(year) == test_year)


def first_by_hash(df: DataFrame, key: str, seed: int | str, quota: int, most: int = RANKED) -> Column:
    """Predicate that is true for exactly the ``quota`` rows with the smallest (hash, key).

    ``key`` must be unique in ``df``. Counts per first digit of the hash locate the range in which the
    quota is reached; if that holds more than ``most`` rows, counts per second digit narrow it to one
    hash value. Only the rows of that range are ranked, and by a top-k that each task keeps for
    itself, so no task takes a share of the table.
    """
    if quota <= 0:
        return F.lit(False)
    h = hash32(seed, key)
    rows, low, width, rest = df.select(h.alias("h"), as_col(key).alias("k")), 0, HASH_RANGE, quota
    while width > 1:
        width //= DIGIT
        counts = rows.groupBy(F.floor((F.col("h") - low) / width).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        upto = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)  # at most DIGIT rows
        cut = (counts.select("digit", "n", F.sum("n").over(upto).alias("c"))
               .where((F.col("c") >= rest) & (F.col("c") - F.col("n") < rest)).first())
        if cut is None:
            return F.lit(True)
        rest -= cut["c"] - cut["n"]
        low += int(cut["digit"]) * width
        rows = rows.where((F.col("h") >= low) & (F.col("h") < low + width))
        if cut["n"] <= most:
            break
    last = rows.orderBy("h", "k").limit(rest).agg(F.max(F.struct("h", "k")).alias("last")).first()["last"]
    return (h < last["h"]) | ((h == last["h"]) & (as_col(key) <= F.lit(last["k"])))


def group_split(df: DataFrame, group: str, test_frac: float = 0.25,
                seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Hold out a fraction of the groups, whole. The test side gets ceil(fraction * groups)."""
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    quota = math.ceil(test_frac * groups.count())
    held_out = first_by_hash(groups, group, seed, quota)
    in_test = F.coalesce(held_out, F.lit(False))
    return df.where(~in_test), df.where(in_test)


def assert_disjoint(train: DataFrame, test: DataFrame, group: str) -> None:
    """Fail when a group has rows on both sides."""
    sides = (train.select(group, F.lit(0).alias("s")).unionByName(test.select(group, F.lit(1).alias("s")))
             .groupBy(group).agg(F.min("s").alias("lo"), F.max("s").alias("hi")))
    if sides.where(F.col("lo") != F.col("hi")).limit(1).count():
        raise ValueError(f"a value of {group} has rows in train and in test")


def _by_rate(df: DataFrame, group: str, target: str, seed: int) -> DataFrame:
    """One row per group: rows ``n``, positive ones ``_pos``, ``_rate`` (-1 without labels) and hash."""
    y = F.col(target).cast("int")
    groups = df.groupBy(group).agg(F.avg(y.cast("double")).alias("_rate"), F.count(F.lit(1)).alias("n"),
                                   F.coalesce(F.sum(y), F.lit(0)).alias("_pos"))
    return groups.select(group, "n", "_pos", F.coalesce("_rate", F.lit(-1.0)).alias("_rate"),
                         hash32(seed, group).alias("_h"))


def _before(groups: DataFrame, group: str, weight: str) -> DataFrame:
    """Total weight of the groups that come earlier by (rate, hash, group), as ``_before``.

    Weights are summed per rate and first digit of the hash, and the running total goes over those
    cells. Groups of one rate so lie in DIGIT cells: no task takes them all if every rate is equal.
    """
    dealt = groups.withColumn("_digit", F.floor(F.col("_h") / DIGIT))
    cells = dealt.groupBy("_rate", "_digit").agg(F.sum(weight).alias("_w"))
    upto = distributed_cumsum(cells, [], "_rate", {"_upto": "_w"}, quantile_edges(cells, "_rate"), ties=["_digit"])
    starts = upto.select("_rate", "_digit", (F.col("_upto") - F.col("_w")).alias("_start"))
    inside = (Window.partitionBy("_rate", "_digit").orderBy("_h", group)
              .rowsBetween(Window.unboundedPreceding, 0))
    return (dealt.withColumn("_inside", F.sum(weight).over(inside) - F.col(weight))
            .join(starts, ["_rate", "_digit"])
            .select(*groups.columns, (F.col("_start") + F.col("_inside")).alias("_before")))


def fold_table(df: DataFrame, group: str, target: str, k: int, seed: int = 42,
               fold: str = "fold") -> DataFrame:
    """One fold per group: groups in order of their rate are dealt out and back again.

    Folds get equal numbers of groups. Where group sizes differ widely, ``balanced_fold_table`` evens
    out the rows as well.
    """
    placed = _before(_by_rate(df, group, target, seed).withColumn("_one", F.lit(1)), group, "_one")
    step = F.pmod(F.col("_before"), F.lit(2 * k))
    return placed.select(group, "n", F.when(step < k, step).otherwise(2 * k - 1 - step)
                         .cast("int").alias(fold))


def place_large(sizes: np.ndarray, totals: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fold of each group, given its (positive, other) rows from the largest group down, and rows per fold.

    Each goes where the squared shares of the two classes grow least; ties go to the first fold.
    """
    held = np.zeros((k, 2))
    scale = np.maximum(totals, 1.0)
    out = np.zeros(len(sizes), int)
    for g, size in enumerate(sizes):
        grown = (((held + size) / scale) ** 2 - (held / scale) ** 2).sum(1)
        out[g] = grown.argmin()
        held[out[g]] += size
    return out, held.sum(1)


def room_left(held: np.ndarray, rest: float) -> np.ndarray:
    """Rows that each fold takes of ``rest`` so that all end level; a fold above the level takes none."""
    ordered = np.sort(held)
    for used in range(len(held), 0, -1):
        level = (rest + ordered[:used].sum()) / used
        if level >= ordered[used - 1]:
            break
    return np.maximum(level - held, 0.0)


def balanced_fold_table(df: DataFrame, group: str, target: str, k: int, seed: int = 42, fold: str = "fold",
                        cycles: int = 20, large: int = LARGE) -> DataFrame:
    """One fold per group, even in rows and in rate.

    Large groups, of more than 1 / (large * k) of all rows and so fewer than ``large * k``, are placed
    one by one on the driver, from the largest down. The others are dealt in order of their rate: their rows, end
    to end, make ``cycles`` laps, and in each lap every fold has a stretch as long as its remaining room. A group goes
    where its middle lies. So a fold misses its size by at most ``cycles`` small groups, and every stratum of rates is
    shared out alike. A NULL group is one group; rows without a label count as not positive.
    """
    groups = _by_rate(df, group, target, seed)
    total, positive = groups.agg(F.sum("n"), F.sum("_pos")).first()
    if not total:
        return groups.select(group, "n", F.lit(0).alias(fold))
    is_large = F.col("n") * (large * k) > total
    listed = groups.where(is_large).orderBy(F.desc("n"), "_h", group).select(group, "n", "_pos").collect()
    sizes = np.array([[r["_pos"], r["n"] - r["_pos"]] for r in listed], float).reshape(-1, 2)
    folds, held = place_large(sizes, np.array([positive, total - positive], float), k)
    spark = df.sparkSession
    schema = groups.select(group, "n").withColumn(fold, F.lit(0)).schema
    placed = spark.createDataFrame([(r[group], r["n"], int(f)) for r, f in zip(listed, folds)], schema)
    rest = int(total - held.sum())
    if not rest:
        return placed
    room = room_left(held, rest)
    marks = np.cumsum(room)[:-1] / room.sum()
    small = _before(groups.where(~is_large), group, "n")
    # Twice the middle keeps whole numbers; a lap is then 2 * rest / cycles long.
    lap = F.pmod((2 * F.col("_before") + F.col("n")) * cycles, F.lit(2 * rest)) / F.lit(2.0 * rest)
    at = sum(((lap >= float(m)).cast("int") for m in marks), F.lit(0))
    # A fold without room has a stretch of no length: the first mark above the place is never its own.
    return placed.unionByName(small.select(group, "n", at.cast("int").alias(fold)))


def grouped_stratified_folds(df: DataFrame, group: str, target: str, k: int = 5, seed: int = 42,
                             fold: str = "fold", even_rows: bool = False) -> DataFrame:
    """Rows with a fold column; every group lies in one fold and fold rates are balanced.

    ``even_rows`` balances the rows per fold too, where group sizes differ widely.
    """
    table = balanced_fold_table if even_rows else fold_table
    return df.join(table(df, group, target, k, seed, fold).drop("n"), group, "left")


def stratified_sample(df: DataFrame, target: str, n: int | None, key: str,
                      seed: int = 42) -> DataFrame:
    """Sample without replacement that keeps the class shares: round(n * share) per class.

    Rows without a label belong to no class and are left out, whatever ``n``; ``None`` takes no sample.
    """
    if n is None:
        return df
    counts = {r[target]: r["n"] for r in df.groupBy(target).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if counts.pop(None, 0):
        df = df.where(F.col(target).isNotNull())
    total = sum(counts.values())
    if n >= total:
        return df
    keep = F.lit(False)
    for label, size in sorted(counts.items(), key=lambda kv: str(kv[0])):
        in_class = F.col(target) == F.lit(label)
        quota = min(size, round(n * size / total))
        keep = keep | (in_class & first_by_hash(df.where(in_class), key, seed, quota))
    return df.where(keep)


def cap_sample(df: DataFrame, max_n: int | None, key: str, seed: int = 42) -> DataFrame:
    """Uniform sample of at most ``max_n`` rows; ``None`` keeps everything."""
    if max_n is None:
        return df
    return df.where(first_by_hash(df, key, seed, max_n))
