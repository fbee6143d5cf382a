"""Ordered computations without a one-task window: top-k, prefix sums, ranks, quantiles."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from cohortlens.functions.expr import HASH_RANGE, hash32

ROWS_PER_BUCKET = 500_000
#: Ranges that a pass of the exact quantiles cuts a bracket into.
RANGES = 1024
#: Edges from which on buckets are looked up in batches: Bucketizer writes the name of every bucket into the plan.
MANY_EDGES = 4096


# --- top-k -------------------------------------------------------------------------------

def top_k(df: DataFrame, col: str, k: int, key: str, min_n: int | None = None,
          n: str = "n") -> DataFrame:
    """The k rows with the largest value; each task keeps k rows, ties go by key."""
    src = df if min_n is None else df.where(F.col(n) >= min_n)
    return src.orderBy(F.desc_nulls_last(col), F.asc_nulls_last(key)).limit(k)


def bottom_k(df: DataFrame, col: str, k: int, key: str, min_n: int | None = None,
             n: str = "n") -> DataFrame:
    src = df if min_n is None else df.where(F.col(n) >= min_n)
    return src.orderBy(F.asc_nulls_last(col), F.asc_nulls_last(key)).limit(k)


def both_ends(df: DataFrame, col: str, k: int, key: str, min_n: int | None = None,
              n: str = "n") -> DataFrame:
    """Lowest and highest k rows, told apart by the column ``side``."""
    return (bottom_k(df, col, k, key, min_n, n).withColumn("side", F.lit("lowest"))
            .unionByName(top_k(df, col, k, key, min_n, n).withColumn("side", F.lit("highest"))))


def rank_by_abs(df: DataFrame, col: str, key: str, rank: str | None = None) -> DataFrame:
    """Rows by descending magnitude, ties by key, NULL last; ``rank`` names a 1-based place to add."""
    if rank is None:
        return df.orderBy(F.abs(F.col(col)).desc_nulls_last(), F.asc_nulls_last(key))
    sized = df.withColumn("_size", F.coalesce(F.abs(F.col(col)).cast("double"), F.lit(-1.0)))
    placed = global_row_number(sized, "_size", [key], quantile_edges(sized, "_size"), descending=True, out=rank)
    return placed.select(*df.columns, rank).orderBy(rank)


# --- prefix sums ---------------------------------------------------------------------------

def _powers_of_two(low: float, high: float) -> np.ndarray:
    """Zero and all powers of two, of both signs, between two finite values."""
    sizes = np.ldexp(1.0, np.arange(-1074, 1024))
    marks = np.concatenate([-sizes[::-1], [0.0], sizes])
    return marks[(marks > low) & (marks <= high)]


def _range_counts(values: DataFrame, edges: Sequence[float]) -> list[Row]:
    """Rows, least and largest value of each non-empty range, in order."""
    return (with_bucket(values, "v", edges).groupBy("_bucket")
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .orderBy("_bucket").collect())


def quantile_edges(df: DataFrame, col: str, rows_per_bucket: int = ROWS_PER_BUCKET,
                   buckets: int | None = None) -> list[float]:
    """Inner edges of buckets with at most ``rows_per_bucket`` rows; a value with more of them has its own.

    Rows are counted per binary order of magnitude, then ranges with too many rows are cut evenly
    and all are counted again until none is left to cut. A pass is one aggregate combined on the map
    side: no value and no sketch is gathered. The driver holds a few numbers per bucket, so one for
    some hundred thousand rows. ``buckets`` asks for about that many buckets instead. NULL, NaN
    and infinite values set no edge.
    """
    v = F.col(col).cast("double")
    values = df.select(v.alias("v")).where(F.abs("v") < math.inf)
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    most = max(1, rows_per_bucket if buckets is None else math.ceil(n / buckets))
    if n <= most or low == high:
        return []
    edges = _powers_of_two(low, high)
    while True:
        ranges = _range_counts(values, edges.tolist())
        cuts = [np.linspace(r["lo"], r["hi"], min(max(8, math.ceil(4 * r["n"] / most)), 4096) + 1)[1:]
                for r in ranges if r["n"] > most and r["lo"] < r["hi"]]
        if not cuts:
            break
        edges = np.unique(np.concatenate([[r["lo"] for r in ranges], *cuts]))
    out, held = [], 0
    for r in ranges:
        if held and held + r["n"] > most:
            out.append(r["lo"])
            held = 0
        held += r["n"]
    return out


def even_edges(low: float, high: float, buckets: int = 256) -> list[float]:
    """Equal-width inner edges for values of a known range; needs no job."""
    return [low + (high - low) * i / buckets for i in range(1, buckets)]


def with_bucket(df: DataFrame, col: str, edges: Sequence[float], out: str = "_bucket") -> DataFrame:
    """Index of the edge interval [e_i, e_i+1) that holds the value (binary search, in the JVM unless edges are many)."""
    if not len(edges):
        return df.withColumn(out, F.lit(0.0))
    if len(edges) > MANY_EDGES:
        marks = np.asarray(edges, float)

        @F.pandas_udf("double")
        def place(v: pd.Series, missing: pd.Series) -> pd.Series:
            if (v.isna() & ~missing).any():
                raise ValueError("NaN is in no bucket")
            return pd.Series(np.searchsorted(marks, v.to_numpy(), side="right").astype(float)).where(~missing.to_numpy())

        return df.withColumn(out, place(F.col(col).cast("double"), F.col(col).isNull()))
    splits = [-math.inf, *edges, math.inf]
    typed = df.withColumn("_cut_value", F.col(col).cast("double"))
    return Bucketizer(splits=splits, inputCol="_cut_value", outputCol=out).transform(typed).drop("_cut_value")


def distributed_cumsum(df: DataFrame, by: Sequence[str], order: str,
                       values: Mapping[str, str], edges: Sequence[float],
                       descending: bool = False, ties: Sequence[str] = (),
                       totals: Mapping[str, str] | None = None) -> DataFrame:
    """Inclusive running totals in the order of one column.

    ``values`` maps output names to summed columns; ``totals`` does the same for the sums over
    the whole group. Rows are cut into value buckets; a window runs inside each (by, bucket),
    and what the other buckets contribute (one row per bucket) joins on that same key, so no
    step gathers a group. The edges are literals: a recomputed task puts every row into the
    same bucket again.
    """
    totals = dict(totals or {})
    direction = F.desc if descending else F.asc
    sort = [direction(order), *[F.asc(t) for t in ties]]
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    if not edges:
        group = Window.partitionBy(*by)
        run, whole = group.orderBy(*sort).rowsBetween(start, 0), group.rowsBetween(start, end)
        return df.select("*", *[F.sum(v).over(run).alias(o) for o, v in values.items()],
                         *[F.sum(v).over(whole).alias(o) for o, v in totals.items()])
    cut = with_bucket(df, order, edges)
    inside = Window.partitionBy(*by, "_bucket").orderBy(*sort).rowsBetween(start, 0)
    local = cut.select("*", *[F.sum(v).over(inside).alias(o) for o, v in values.items()])
    needed = sorted({*values.values(), *totals.values()})
    sums = cut.groupBy(*by, "_bucket").agg(*[F.sum(v).alias(f"_t_{v}") for v in needed])
    group = Window.partitionBy(*by)
    before = group.orderBy(direction("_bucket")).rowsBetween(start, -1)
    # Keys are compared null-safely, as the window does, so a NULL group counts like any other.
    others = sums.select(
        *[F.col(b).alias(f"_k_{b}") for b in [*by, "_bucket"]],
        *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{o}") for o, v in values.items()],
        *[F.sum(f"_t_{v}").over(group.rowsBetween(start, end)).alias(o) for o, v in totals.items()])
    same = [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in [*by, "_bucket"]]
    joined = local.join(others, same, "left")
    return joined.select(*df.columns, *[(F.col(o) + F.col(f"_o_{o}")).alias(o) for o in values], *totals)


def global_row_number(df: DataFrame, order: str, ties: Sequence[str], edges: Sequence[float],
                      by: Sequence[str] = (), descending: bool = False,
                      out: str = "row_number") -> DataFrame:
    """1-based position in a total order over all rows of ``by``."""
    one = df.withColumn("_one", F.lit(1))
    return distributed_cumsum(one, by, order, {out: "_one"}, edges, descending, ties).drop("_one")


def hash_rank(df: DataFrame, seed: int | str, keys: Sequence[str], by: Sequence[str] = (),
              buckets: int = 1024, out: str = "hash_rank") -> DataFrame:
    """Position of each row in a seeded random order. Hash values are uniform, so equal-width
    buckets are even and known in advance."""
    hashed = df.withColumn("_h", hash32(seed, *keys))
    return global_row_number(hashed, "_h", list(keys), even_edges(0.0, float(HASH_RANGE), buckets),
                             by, out=out).drop("_h")


# --- exact quantiles -----------------------------------------------------------------------

def quantiles_by(df: DataFrame, by: Sequence[str], col: str, probs: Mapping[str, float],
                 edges: Sequence[float] | None = None, n: str | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation) per group, as a DataFrame.

    Equal values are merged first, then ranked with a bucketed running total, so a group
    with a third of all rows is spread over many tasks.
    """
    src = df.where(F.col(col).isNotNull())
    if edges is None:
        edges = quantile_edges(src, col)
    wanted, by = list(by), list(by) or ["_all"]
    if not wanted:
        src = src.withColumn("_all", F.lit(0))
    cells = src.groupBy(*by, F.col(col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = distributed_cumsum(cells, by, "_v", {"_c": "_n"}, edges, totals={"_total": "_n"})

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_c") - F.col("_n") <= rank) & (rank < F.col("_c")), F.col("_v")))

    picks, outs = [], []
    for name, q in probs.items():
        pos = (F.col("_total") - 1).cast("double") * q
        picks += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}")]
        frac = pos - F.floor(pos)
        outs.append((F.col(f"_lo_{name}")
                     + frac * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    rows = ranked.groupBy(*by).agg(F.max("_total").alias("_total"), *picks)
    extra = [F.col("_total").alias(n)] if n else []
    return rows.select(*wanted, *extra, *outs)


def _magnitude(v: Column) -> Column:
    """Binary order of magnitude with its sign: never falls as the value grows. NaN comes last, as in sorting."""
    size = F.floor(F.log2(F.abs(v))) + 1100
    return (F.when(F.isnan(v), 3000).when(v == 0, 0).when(F.abs(v) == math.inf, 2500 * F.signum(v))
            .otherwise(F.signum(v) * size)).cast("int")


def _one_value(b: Mapping) -> bool:
    return b["lo"] == b["hi"] or b["lo"] != b["lo"]


def _narrow(df: DataFrame, names: Sequence[str], wide: Mapping, magnitudes: bool) -> None:
    """Shrink each bracket to the range of it that holds its rank: one aggregate for all brackets."""
    shared: dict[tuple, list[tuple[int, int]]] = {}
    for (i, r), b in wide.items():
        shared.setdefault((i, b["lo"], b["hi"], b["below"]), []).append((i, r))
    entries, wanted_here = [], F.lit(False)
    for j, ((i, lo, hi, below), keys) in enumerate(shared.items()):
        v = F.col(names[i]).cast("double")
        place = _magnitude(v) if magnitudes else F.least(
            F.floor((v - lo) / (hi - lo) * RANGES).cast("int"), F.lit(RANGES - 1))
        entries.append(F.when(v.between(lo, hi), F.struct(F.lit(j).alias("j"), place.alias("place"), v.alias("v"))))
        for _, r in keys:
            wanted_here |= (F.col("j") == j) & (F.col("before") <= r - below) & (F.col("before") + F.col("n") > r - below)
    ranges = (df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.j", "e.place")
              .agg(F.count(F.lit(1)).alias("n"), F.min("e.v").alias("lo"), F.max("e.v").alias("hi")))
    upto = Window.partitionBy("j").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranges.withColumn("before", F.sum("n").over(upto) - F.col("n"))
    brackets = list(shared.items())
    for row in placed.where(wanted_here).collect():  # at most one row per wanted rank
        (_, _, _, below), keys = brackets[row["j"]]
        for key in keys:
            if row["before"] <= key[1] - below < row["before"] + row["n"]:
                wide[key].update(lo=row["lo"], hi=row["hi"], below=below + row["before"], n=row["n"])


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    keep: int = 100_000, counts: dict[str, int] | None = None,
                    ) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns, linear interpolation, all columns in the same passes.

    Each wanted rank has a bracket of values. A pass counts the rows per range of the bracket, binary
    orders of magnitude first and equal parts after that, and keeps the range that holds the rank.
    The counts are combined on the map side. Once a bracket holds at most ``keep`` rows or one
    value, its values are ranked. The data is never sorted and only bracket values move.
    ``counts`` is filled with the non-missing rows per column and the rows in all ("").
    """
    names = list(dict.fromkeys(columns))
    first = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(names) for x in (
        F.count(c).alias(f"n{i}"), F.min(F.col(c).cast("double")).alias(f"a{i}"),
        F.max(F.col(c).cast("double")).alias(f"z{i}"))]).first()
    if counts is not None:
        counts.update({"": first["n"], **{c: first[f"n{i}"] for i, c in enumerate(names)}})
    # One bracket per (column, wanted rank): inclusive value range and the rows below it.
    wanted: dict[tuple[int, float], list[int]] = {}
    brackets: dict[tuple[int, int], dict] = {}
    for i, _ in enumerate(names):
        n = first[f"n{i}"]
        for q in probs:
            pos = (n - 1) * q
            wanted[i, q] = [math.floor(pos), math.ceil(pos)] if n else []
            for r in wanted[i, q]:
                brackets[i, r] = {"lo": first[f"a{i}"], "hi": first[f"z{i}"], "below": 0, "n": n}

    magnitudes = True
    while wide := {k: b for k, b in brackets.items() if b["n"] > keep and not _one_value(b)}:
        _narrow(df, names, wide, magnitudes)
        magnitudes = False

    values: dict[tuple[int, int], float] = {k: b["lo"] for k, b in brackets.items() if b["n"] and _one_value(b)}
    # Ranks that share a bracket share its values: a row is emitted once per bracket it is in.
    shared: dict[tuple[int, float, float, int], list[int]] = {}
    for (i, r), b in brackets.items():
        if (i, r) not in values:
            shared.setdefault((i, b["lo"], b["hi"], b["below"]), []).append(r)
    if shared:
        entries = F.array(*[
            F.when(F.col(names[i]).cast("double").between(lo, hi),
                   F.struct(F.lit(j).alias("j"), F.col(names[i]).cast("double").alias("v")))
            for j, (i, lo, hi, _) in enumerate(shared)])
        long = (df.select(F.explode(F.array_compact(entries)).alias("e"))
                .groupBy(F.col("e.j").alias("j"), F.col("e.v").alias("v"))
                .agg(F.count(F.lit(1)).alias("n")))
        cum = distributed_cumsum(long, ["j"], "v", {"c": "n"}, [])
        first_rank, last_rank = F.col("c") - F.col("n"), F.col("c") - 1
        wanted_here = F.lit(False)
        for j, ((_, _, _, below), ranks) in enumerate(shared.items()):
            inside = [(first_rank <= r - below) & (last_rank >= r - below) for r in sorted(set(ranks))]
            wanted_here = wanted_here | ((F.col("j") == j) & reduce(lambda a, b: a | b, inside))
        keys = list(shared)
        for row in cum.where(wanted_here).collect():  # at most one row per wanted rank
            i, _, _, below = keys[row["j"]]
            for r in shared[keys[row["j"]]]:
                if row["c"] - row["n"] <= r - below < row["c"]:
                    values[i, r] = row["v"]

    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        out[c] = []
        for q in probs:
            ranks = wanted[i, q]
            if not ranks:
                out[c].append(None)
                continue
            lo, hi = values[i, ranks[0]], values[i, ranks[1]]
            pos = (first[f"n{i}"] - 1) * q
            out[c].append(lo if lo == hi else lo + (pos - math.floor(pos)) * (hi - lo))
    return out


def peer_adjust(df: DataFrame, value: str, peer: str | Sequence[str], out: str = "adjusted",
                median: str = "peer_median", edges: Sequence[float] | None = None) -> DataFrame:
    """Value minus the median of its own peer group."""
    peers = [peer] if isinstance(peer, str) else list(peer)
    mid = quantiles_by(df, peers, value, {median: 0.5}, edges)
    return (df.join(mid, peers, "left")
            .select(*df.columns, median, (F.col(value) - F.col(median)).alias(out)))
