"""Edges and exact quantiles by refined ranges: values of any size, hot values, no sketch."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators import ordering as W

WILD = [0.0, -0.0, 5e-324, -5e-324, 1e-300, 1.0, 1.0 + 2**-52, -1.0, 3.5, 1e300, -1e300, 1.7976931348623157e308, -1.7976931348623157e308]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.sampled_from(WILD), st.floats(allow_nan=False, allow_infinity=False)), min_size=1, max_size=60),
       st.integers(1, 9))
def test_edges_bound_every_bucket(spark, values, most):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    edges = W.quantile_edges(df, "v", most)
    assert edges == sorted(set(edges))
    held = np.searchsorted(edges, values, side="right")
    for b in set(held):
        inside = [v for v, h in zip(values, held) if h == b]
        assert len(inside) <= most or len(set(inside)) == 1


def test_edges_leave_out_what_is_no_number(spark):
    df = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (-math.inf,), (1.0,), (2.0,), (3.0,)], "v double")
    assert W.quantile_edges(df, "v", 1) == [2.0, 3.0]
    assert W.quantile_edges(df.where("v is null"), "v", 1) == []


def test_edges_take_a_number_of_buckets(spark):
    df = spark.range(10_000).select(F.sqrt("id").alias("v"))
    edges = W.quantile_edges(df, "v", buckets=16)
    sizes = [r["count"] for r in W.with_bucket(df, "v", edges).groupBy("_bucket").count().collect()]
    assert 16 <= len(sizes) <= 24 and max(sizes) <= 625


def test_a_hot_value_has_a_bucket_of_its_own(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") / 100).alias("v"))
    edges = W.quantile_edges(df, "v", 50)
    hot = W.with_bucket(df, "v", edges).groupBy("_bucket").agg(F.count("*").alias("n"), F.count_distinct("v").alias("d")).where("n > 50").collect()
    assert [r["d"] for r in hot] == [1]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.sampled_from(WILD), st.floats(-1e150, 1e150)), min_size=1, max_size=50), st.sampled_from([1, 3]))
def test_quantiles_of_any_values(spark, values, keep):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, w int")
    got = W.exact_quantiles(df, ["v", "w"], [0.0, 0.3, 1.0], keep=keep)
    assert got["v"][0] == min(values) and got["v"][2] == max(values)
    ordered, pos = sorted(values), 0.3 * (len(values) - 1)
    lo, hi = ordered[math.floor(pos)], ordered[math.ceil(pos)]
    assert got["v"][1] == lo + (pos - math.floor(pos)) * (hi - lo)
    assert got["w"][2] == len(values) - 1


def test_nan_and_infinities_rank_last(spark):
    df = spark.createDataFrame([(math.nan,)] * 3 + [(math.inf,)] * 3 + [(-math.inf,)] * 3 + [(float(i),) for i in range(3)], "v double")
    got = W.exact_quantiles(df, ["v"], [0.0, 4 / 11, 1.0], keep=1)["v"]
    assert got[0] == -math.inf and got[1] == pytest.approx(1.0) and math.isnan(got[2])


def test_no_sketch_in_any_plan(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a sketch would be merged in one task")

    monkeypatch.setattr(F, "percentile_approx", refuse)
    monkeypatch.setattr(F, "expr", refuse)
    df = spark.range(5000).select((F.col("id") * 7 % 5000 / 3).alias("v"))
    assert W.exact_quantiles(df, ["v"], [0.5], keep=10)["v"] == [pytest.approx(4999 / 6)]
    assert len(W.quantile_edges(df, "v", 100)) >= 49
