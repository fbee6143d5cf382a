"""Column expressions shared by every operator.

All of them compile to built-in Catalyst expressions, so they stay inside
whole-stage code generation and never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = [
    "as_col", "safe_div", "safe_log", "decode", "normalize_label", "title_label",
    "flag", "zero_fill", "filled_sum", "fallback_with_flag", "pick_by_year",
    "starts_with", "contains_ci", "to_code", "select_except", "literal_relation",
    "explode_literal", "slice_filter", "hash32", "right_closed_cut", "rounded",
]

HASH_RANGE = 1 << 32

# Accented Latin letters and their plain counterparts, position by position.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüç"
PLAIN = "aaaaaeeeeiiiiooooouuuuc"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b as double; NULL when b is zero or either side is NULL."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def safe_log(c: str | Column) -> Column:
    """Natural logarithm; NULL where it is not defined."""
    c = as_col(c).cast("double")
    return F.when(c > 0, F.ln(c))


def decode(col: str | Column, mapping: Mapping) -> Column:
    """Map codes to labels; a code outside the mapping becomes NULL."""
    col = as_col(col)
    branches = list(mapping.items())
    out = F.when(col == F.lit(branches[0][0]), F.lit(branches[0][1]))
    for code, label in branches[1:]:
        out = out.when(col == F.lit(code), F.lit(label))
    return out


def normalize_label(col: str | Column) -> Column:
    """Lower-case and strip accents, so spellings of one label become one key."""
    return F.translate(F.lower(as_col(col)), ACCENTED, PLAIN)


def title_label(col: str | Column) -> Column:
    return F.initcap(as_col(col))


def flag(condition: Column) -> Column:
    """0/1 indicator; an unknown condition counts as 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def zero_fill(col: str | Column) -> Column:
    return F.coalesce(as_col(col), F.lit(0))


def filled_sum(*cols: str | Column) -> Column:
    """Sum in which a missing term counts as zero."""
    return reduce(lambda a, b: a + b, [zero_fill(c) for c in cols])


def fallback_with_flag(primary: str | Column, backup: str | Column) -> tuple[Column, Column]:
    """The value with its backup, and a boolean that says the backup was used."""
    p, b = as_col(primary), as_col(backup)
    return F.coalesce(p, b), p.isNull() & b.isNotNull()


def pick_by_year(year: str | Column, columns: Mapping[int, str | Column]) -> Column:
    """The column that belongs to the row's year; NULL for a year without one."""
    year = as_col(year)
    items = list(columns.items())
    out = F.when(year == items[0][0], as_col(items[0][1]))
    for y, c in items[1:]:
        out = out.when(year == y, as_col(c))
    return out


def starts_with(col: str | Column, prefix: str) -> Column:
    return as_col(col).startswith(prefix)


def contains_ci(col: str | Column, text: str) -> Column:
    return F.lower(as_col(col)).contains(text.lower())


def to_code(col: str | Column) -> Column:
    """Text to integer code; text that is no number becomes NULL instead of an error."""
    return as_col(col).try_cast("bigint")


def select_except(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def literal_relation(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """A small relation written in the program, such as an edition map.

    Marked as small: its size is not known to Spark, and a join that sorted the other side would gather
    all rows of one key in one task.
    """
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def explode_literal(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Every row once per value of a literal list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def slice_filter(
    df: DataFrame,
    eq: Mapping | None = None,
    in_: Mapping[str, Sequence] | None = None,
    between: Mapping[str, tuple] | None = None,
    ne: Mapping | None = None,
    is_null: Sequence[str] = (),
) -> DataFrame:
    """Conjunction of the slice predicates that pin a cube-like table to one grain.

    Three-valued logic is kept: ``ne`` drops NULLs as well. Each predicate is a plain
    comparison, so all of them reach the Parquet scan.
    """
    conds = [F.col(c) == v for c, v in (eq or {}).items()]
    conds += [F.col(c).isin(list(v)) for c, v in (in_ or {}).items()]
    conds += [F.col(c).between(*v) for c, v in (between or {}).items()]
    conds += [F.col(c) != v for c, v in (ne or {}).items()]
    conds += [F.col(c).isNull() for c in is_null]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def hash32(seed: int | str, *keys: str | Column) -> Column:
    """Portable 32-bit hash of a key: the first eight hex digits of md5('seed:key')."""
    text = F.concat_ws(":", F.lit(str(seed)), *[as_col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def right_closed_cut(col: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (edge, next edge] that holds the value.

    ``edges`` are the inner edges; the outer intervals are open-ended.
    """
    col = as_col(col)
    out = F.when(col <= edges[0], labels[0])
    for e, label in zip(edges[1:], labels[1:]):
        out = out.when(col <= e, label)
    return out.when(col > edges[-1], labels[-1])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; used at output boundaries only."""
    return df.select(*[
        F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`")
        for n, t in df.dtypes
    ])
