"""Joins that keep every unit row, and the guards that prove it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import explode_literal

# Bytes of dimension data that may be shipped to every executor, over all joins of one plan.
BROADCAST_BUDGET = 256 << 20
STRING_WIDTH = 24


class DuplicateKeyError(ValueError):
    """A context table is not unique on its key, so joining it would multiply rows."""


def key_profile(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> dict[str, tuple[int, int]]:
    """Rows and largest key multiplicity of several tables, in one Spark job."""
    parts = [
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
             F.coalesce(F.max("n"), F.lit(0)).alias("top"))
        .select(F.lit(name).alias("name"), "n_rows", "top")
        for name, (df, keys) in tables.items()
    ]
    rows = reduce(DataFrame.unionByName, parts).collect()
    return {r["name"]: (int(r["n_rows"]), int(r["top"])) for r in rows}


def assert_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> int:
    """Fail when a key occurs twice; returns the row count."""
    n_rows, top = key_profile({name: (df, keys)})[name]
    if top > 1:
        raise DuplicateKeyError(f"{name}: a key of ({', '.join(keys)}) occurs {top} times")
    return n_rows


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The offending keys with their multiplicity."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def assert_row_preserving(before: DataFrame, after: DataFrame) -> int:
    n0, n1 = before.count(), after.count()
    if n0 != n1:
        raise ValueError(f"the join changed the row count from {n0} to {n1}")
    return n1


def estimated_bytes(df: DataFrame, n_rows: int) -> int:
    """Size of a table in memory from its exact row count and its column types."""
    width = {"int": 4, "bigint": 8, "double": 8, "boolean": 1, "float": 4, "string": STRING_WIDTH}
    return n_rows * (16 + sum(width.get(t, 64) for _, t in df.dtypes))


def attach_dimension(fact: DataFrame, dim: DataFrame, keys: Sequence[str], n_rows: int,
                     budget: int = BROADCAST_BUDGET, how: str = "left") -> tuple[DataFrame, int]:
    """Left join of a key-unique dimension whose row count is known.

    Within the budget the dimension is broadcast and the fact is not shuffled. Beyond it
    the join is left to Spark: a sort-merge join whose hot keys adaptive execution splits
    on the fact side. Returns the result and the budget that is left.
    """
    size = estimated_bytes(dim, n_rows)
    if size <= budget:
        return fact.join(F.broadcast(dim), list(keys), how), budget - size
    return fact.join(dim, list(keys), how), budget


def enrich(base: DataFrame, contexts: Sequence[tuple[DataFrame, Sequence[str]]],
           budget: int = BROADCAST_BUDGET) -> DataFrame:
    """Attach several context tables to the unit rows without losing or doubling one.

    All contexts are checked for key uniqueness in a single job before anything is joined;
    the same job yields the row counts that decide between broadcast and shuffle.
    """
    named = {f"context {i}": c for i, c in enumerate(contexts)}
    profile = key_profile(named)
    for name, (_, keys) in named.items():
        if profile[name][1] > 1:
            raise DuplicateKeyError(
                f"{name}: a key of ({', '.join(keys)}) occurs {profile[name][1]} times")
    out = base
    for name, (ctx, keys) in sorted(named.items(), key=lambda kv: profile[kv[0]][0]):
        out, budget = attach_dimension(out, ctx, keys, profile[name][0], budget)
    order = base.columns + [c for ctx, keys in contexts for c in ctx.columns if c not in keys]
    return out.select(*order)


def lag_join(left: DataFrame, right: DataFrame, by: Sequence[str], year: str = "year",
             k: int = 1, how: str = "left") -> DataFrame:
    """Attach the right row of ``year - k``.

    The year is moved on the right side before an equi-join. It is a calendar lag: over a
    gap in the years it finds nothing, where a positional lag would reach too far back.
    """
    moved = right.withColumn(year, (F.col(year) + k).cast(right.schema[year].dataType))
    return left.join(moved, [year, *by], how)


def edition_map(releases: DataFrame, years: DataFrame, year: str, release: str, edition: str) -> DataFrame:
    """For each target year the last edition released before it, and the edition before that one.

    ``releases`` has one row per edition (a handful), ``years`` any rows with the target years; each
    distinct one is placed among the releases, however late it is, so facts later meet the map through
    an equi-join and never through a range condition. Years before every release have no row.
    """
    one = releases.groupBy(release).agg(F.max(edition).alias(edition))
    known = one.select(
        (F.col(release) + 1).cast("int").alias(year), F.lit(False).alias("_asked"),
        F.struct(F.col(edition), F.lag(edition).over(Window.orderBy(release)).alias(f"previous_{edition}")).alias("_known"))
    asked = years.select(F.col(year).cast("int").alias(year)).where(F.col(year).isNotNull()).distinct()
    both = known.unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    # One row per calendar year and per edition: a bounded window.
    latest = F.last("_known", ignorenulls=True).over(Window.orderBy(year, "_asked").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("_known", latest).where(F.col("_asked") & F.col("_known").isNotNull())
    return placed.select(year, f"_known.{edition}", f"_known.previous_{edition}")


def asof_release_join(left: DataFrame, editions: DataFrame, mapping: DataFrame,
                      by: Sequence[str], year: str, edition: str, how: str = "left") -> DataFrame:
    """Attach to each target year the values of the edition that the map assigns to it.

    The map has one row per target year. Editions are re-keyed to target years first, which
    leaves a plain equi-join on (year, by) with the fact side.
    """
    rekeyed = mapping.select(year, edition).join(editions, edition, "inner")
    return left.join(rekeyed, [year, *by], how)


def grid(entities: DataFrame, values: Mapping[str, Sequence]) -> DataFrame:
    """Complete spine: every entity once per combination of the literal lists.

    Years and labels are short lists known to the program, so the spine is a narrow
    ``explode`` over the entities: no join and no shuffle.
    """
    out = entities
    for name, items in values.items():
        out = explode_literal(out, name, items)
    return out


def outer_merge(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Chain of full outer joins with coalesced keys."""
    return reduce(lambda a, b: a.join(b, list(keys), "full"), frames)


def role_columns(df: DataFrame, keys: Sequence[str],
                 roles: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """One table read in several roles: each role is a predicate and a value column.

    A single conditional aggregate replaces one scan and one join per role.
    """
    return df.groupBy(*keys).agg(*[
        F.max(F.when(cond, F.col(value))).alias(out) for out, (cond, value) in roles.items()])


def role_join(left: DataFrame, df: DataFrame, keys: Sequence[str],
              roles: Mapping[str, tuple[Column, str]]) -> DataFrame:
    return left.join(role_columns(df, keys, roles), list(keys), "left")


def map_join(df: DataFrame, mapping: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep only rows whose key the map knows, with the map's columns."""
    return df.join(mapping, list(keys), "inner")


def coverage_strata(test: DataFrame, train: DataFrame, group: str, parent: str,
                    labels: Sequence[str] = ("group seen", "group new, parent seen", "parent new"),
                    out: str = "stratum") -> DataFrame:
    """Label test rows by how much of their territory the training rows already covered."""
    groups = train.select(group).distinct().withColumn("_g", F.lit(True))
    parents = train.select(parent).distinct().withColumn("_p", F.lit(True))
    return (test.join(groups, group, "left").join(parents, parent, "left")
            .withColumn(out, F.when(F.col("_g"), labels[0])
                        .when(F.col("_p"), labels[1]).otherwise(labels[2]))
            .select(*test.columns, out))


def attach_targets(ranking: DataFrame, targets: DataFrame, key: str,
                   columns: Sequence[str]) -> DataFrame:
    """Left join of group-level targets; a group with two different targets is an error."""
    per_group = targets.groupBy(key).agg(
        *[F.max(c).alias(c) for c in columns],
        *[F.when(F.min(c) != F.max(c), F.raise_error(F.concat(
            F.lit(f"conflicting {c} for "), F.col(key).cast("string"))))
          .cast("int").alias(f"_conflict_{c}") for c in columns])
    checked = per_group.where(" AND ".join(f"`_conflict_{c}` IS NULL" for c in columns))
    return ranking.join(checked.select(key, *columns), key, "left")
