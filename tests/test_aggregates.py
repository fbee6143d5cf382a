from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import aggregates as A
from conftest import rows


def test_weighted_rollup_policies(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", None, 30), ("b", 1, 0)], "g string, f int, w int")
    kept = rows(A.weighted_rollup(df, ["g"], {"s": "f"}, "w"), "g")
    assert [r["s"] for r in kept] == [0.25, None]
    skip = rows(A.weighted_rollup(df, ["g"], {"s": "f"}, "w", "skip"), "g")
    assert [r["s"] for r in skip] == [1.0, None]


def test_pivot_filter_follows_the_specification(spark):
    df = spark.createDataFrame([("a", "1", 5.0), ("a", "2", 6.0), ("b", "9", 7.0)], "g string, code string, v double")
    out = A.conditional_pivot(df, ["g"], {"x": ("1", "v"), "y": ("2", "v")}, code="code")
    assert rows(out) == [{"g": "a", "x": 5.0, "y": 6.0}]


def test_outcome_counts_units_once(spark):
    df = spark.createDataFrame([("a", "s1", True), ("a", "s1", False), ("a", "s2", None), ("a", None, True)],
                               "g string, s string, t boolean")
    got = rows(A.outcome_by(df, ["g"], "t", "s"))[0]
    assert (got["n"], got["n_units"]) == (4, 2) and got["rate"] == pytest.approx(2 / 3)


def test_dedupe_takes_the_first_in_a_total_order(spark):
    df = spark.createDataFrame([(1, None, "z"), (1, 5, "b"), (1, 5, "a"), (2, None, "q")], "k int, o int, v string")
    assert [(r["k"], r["o"], r["v"]) for r in rows(A.dedupe(df, ["k"], ["o"]), "k")] == [(1, 5, "a"), (2, None, "q")]
    assert [(r["k"], r["o"], r["v"]) for r in rows(A.dedupe(df, ["k"], ["o"], descending=True), "k")] == [(1, 5, "b"), (2, None, "q")]
    with pytest.raises(ValueError):
        A.dedupe(df, ["k"], [])


def test_dedupe_does_not_sort_a_key_in_one_task(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
    plan = A.dedupe(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min_by" in plan


def test_group_value_comes_from_the_largest_segment(spark):
    df = spark.createDataFrame(
        [("g", "B", True, 2.0, None), ("g", "B", False, 2.0, None), ("g", "A", True, 1.0, 8.0)],
        "g string, seg string, t boolean, f double, h double")
    got = rows(A.aggregate_groups(df, ["g"], "seg", "t", ["f", "h"], min_n=1))[0]
    # h is missing in the largest segment, so the next one gives it.
    assert (got["n"], got["f"], got["h"]) == (3, 2.0, 8.0) and got["t"] == pytest.approx(2 / 3)
    assert A.aggregate_groups(df, ["g"], "seg", "t", ["f"], min_n=4).count() == 0


def test_shrinkage_pulls_small_groups_to_the_parent(spark):
    df = spark.createDataFrame([("p", "big", i % 2 == 0) for i in range(100)] + [("p", "one", True)],
                               "p string, c string, t boolean").withColumn("y", F.lit(1))
    got = {r["c"]: r for r in rows(A.shrunk_rate(df, ["y"], "c", "p", "t"))}
    parent = 51 / 101
    assert got["one"]["shrunk_rate"] == pytest.approx((1 + 30 * parent) / 31)
    assert abs(got["one"]["deviation"]) < abs(1 - parent)


def test_share_with_its_own_denominator(spark):
    df = spark.createDataFrame([("a", "x", 1, 10), ("a", "x", 0, 30), ("a", "y", 1, 60), ("b", "y", 1, 5)], "g string, k string, f int, v int")
    got = rows(A.share_where(df, ["g"], "v", {"all": (F.col("f") == 1, None), "x": (F.col("f") == 1, F.col("k") == "x")}), "g")
    assert [(r["all"], r["x"]) for r in got] == [(0.7, 0.25), (1.0, None)]


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, s string, t boolean")
    assert A.outcome_by(df, ["g"], "t", "s").count() == 0
    assert A.missing_profile(df, ["s"]).count() == 0
