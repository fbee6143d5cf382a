from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from cohortlens import functions as X
from cohortlens.functions.stats import two_sided_t


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        [(1, "1", 4.0, 2.0, "Pública", 2024), (2, "9", 1.0, 0.0, "MUNICIPAL", 2025),
         (3, None, None, 1.0, None, 2030), (4, "x", -3.0, None, "total", 2024)],
        "id int, code string, a double, b double, label string, year int")


def pick(df, col):
    return [r[0] for r in df.orderBy("id").select(col).collect()]


def test_ratio_is_null_on_zero_or_missing(df):
    assert pick(df, X.safe_div("a", "b")) == [2.0, None, None, None]


def test_log_is_null_outside_its_domain(df):
    got = pick(df, X.safe_log("a"))
    assert got[0] == pytest.approx(math.log(4.0)) and got[2:] == [None, None]


def test_decode_gives_null_for_unknown_codes(df):
    assert pick(df, X.decode("code", {"1": "one", "2": "two"})) == ["one", None, None, None]


def test_labels_fold_case_and_accents(df):
    assert pick(df, X.normalize_label("label")) == ["publica", "municipal", None, "total"]
    assert pick(df, X.title_label(X.normalize_label("label")))[:2] == ["Publica", "Municipal"]


def test_flag_counts_unknown_as_zero(df):
    assert pick(df, X.flag(F.col("a") > 2)) == [1, 0, 0, 0]


def test_filled_sum_and_zero_fill(df):
    assert pick(df, X.filled_sum("a", "b")) == [6.0, 1.0, 1.0, -3.0]
    assert pick(df, X.zero_fill("a")) == [4.0, 1.0, 0.0, -3.0]


def test_fallback_never_silent(df):
    value, used = X.fallback_with_flag("a", "b")
    assert pick(df, value) == [4.0, 1.0, 1.0, -3.0]
    assert pick(df, used) == [False, False, True, False]


def test_pick_by_year_without_branch_is_null(df):
    assert pick(df, X.pick_by_year("year", {2024: "a", 2025: "b"})) == [4.0, 0.0, None, -3.0]


def test_bad_code_is_null_not_an_error(df):
    assert pick(df, X.to_code("code")) == [1, 9, None, None]


def test_slice_filter_keeps_three_valued_logic(df):
    assert [r.id for r in X.slice_filter(df, ne={"label": "total"}).collect()] == [1, 2]
    assert [r.id for r in X.slice_filter(df, is_null=["a"]).collect()] == [3]
    assert [r.id for r in X.slice_filter(df, eq={"year": 2024}, between={"a": (0, 9)}).collect()] == [1]


def test_hash_is_portable(df):
    want = [int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:8], 16) for i in (1, 2, 3, 4)]
    assert pick(df, X.hash32(7, "id")) == want


def test_right_closed_cut(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 0.2, 0.21, 0.5, 0.8, 0.81, None])], "id int, p double")
    assert pick(df, X.right_closed_cut("p", (0.2, 0.5, 0.8), ("a", "b", "c", "d"))) == ["a", "a", "b", "b", "c", "d", None]


def test_normal_integral_against_erf(spark):
    xs = [-8.0, -3.1, -1.0, -0.2, 0.0, 0.7, 2.5, 8.0]
    df = spark.createDataFrame(list(enumerate(xs)), "id int, x double")
    for got, x in zip(pick(df, X.norm_cdf("x")), xs):
        assert got == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=7.5e-8)


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 9.0)], "x double, y double")
    assert df.agg(X.safe_corr("x", "y")).first()[0] is None
    assert df.agg(X.safe_corr("y", "y")).first()[0] == pytest.approx(1.0)


@pytest.mark.parametrize("r,n", [(0.5, 10), (0.3, 100), (0.0, 20), (-0.7, 8)])
def test_p_value_of_pearson(r, n):
    # Reference values: numeric integral of the t density.
    df, t = n - 2, abs(r) * math.sqrt((n - 2) / (1 - r * r))
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    steps = 20_000
    if t == 0:
        want = 1.0
    else:
        h = t / steps
        area = sum((1 + (i * h) ** 2 / df) ** (-(df + 1) / 2) * (4 if i % 2 else 2) for i in range(1, steps))
        area = (area + 1 + (1 + t * t / df) ** (-(df + 1) / 2)) * h / 3
        want = 1 - 2 * c * area
    assert two_sided_t(r, n) == pytest.approx(want, abs=1e-8)


def test_a_literal_relation_does_not_sort_what_it_joins(spark, capsys):
    from cohortlens.functions import literal_relation
    joined = spark.range(100).select((F.col("id") % 3).cast("int").alias("year")).join(literal_relation(spark, "year int, ref int", [(0, 7), (2, 9)]), "year")
    assert {(r["ref"], r["count"]) for r in joined.groupBy("ref").count().collect()} == {(7, 34), (9, 33)}
    joined.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
