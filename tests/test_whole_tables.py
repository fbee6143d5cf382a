"""Queries over whole tables: every model and every year, not a chosen part."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import decide as D
from workload import QUERIES

SF = "/root/testdata/sf0.001"


def test_each_model_is_ranked_and_calibrated_by_itself(spark):
    rows = [(m, g, g % 2, (i + g) % 2, (0.3 if m == "A" else 0.6) + i / 50) for m in "AB" for g in range(6) for i in range(7)]
    scores = spark.createDataFrame(rows, "model string, school int, parent int, y int, p double")
    both = D.group_risk_ranking(scores, "school", "parent", min_n=4, by=["model"])
    calibrated = {r.model: r for r in D.aggregate_calibration(both, by=["model"]).collect()}
    for m in "AB":
        alone = D.group_risk_ranking(scores.where(F.col("model") == m), "school", "parent", min_n=4)
        assert both.where(F.col("model") == m).drop("model").collect() == alone.collect()
        assert tuple(calibrated[m])[1:] == tuple(D.aggregate_calibration(alone).first())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_merged_years_are_all_years_and_have_gaps(spark):
    from workload.registry import Star
    got = QUERIES["j5_outer_merge_all_years"](spark, SF)
    years = {r.year for r in Star(spark, SF).units.select("year").distinct().collect()}
    assert {r.year for r in got.select("year").distinct().collect()} == years
    assert all(got.where(F.col(c).isNull()).count() for c in ("n_stream", "n_completed", "n_not_completed", "n_target"))
    assert got.agg(F.sum("n_completed") + F.sum("n_not_completed")).first()[0] == Star(spark, SF).units.count()
    goals = QUERIES["j9_attach_all_years"](spark, SF)
    assert goals.where("goal IS NULL").count() and goals.where("goal IS NOT NULL").count()
