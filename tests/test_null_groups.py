"""One answer for every size: NULL groups and labels, with and without value buckets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import bootstrap, metrics, roles
from cohortlens.operators import ordering as W
from cohortlens.operators import splits as V


@pytest.fixture(scope="module")
def grouped(spark):
    return spark.range(60).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))


def test_running_totals_of_a_null_group_do_not_depend_on_edges(grouped):
    def totals(edges):
        out = W.distributed_cumsum(grouped, ["g"], "v", {"run": "n"}, edges, totals={"all": "n"})
        return sorted((str(r["g"]), r["v"], r["run"], r["all"]) for r in out.collect())

    assert totals([]) == totals([10.0, 20.0, 45.0])
    assert [r[2] for r in totals([10.0]) if r[0] == "None"] == list(range(1, 21))


def test_row_numbers_of_a_null_group(grouped):
    def places(edges):
        return sorted((str(r["g"]), r["v"], r["row_number"]) for r in W.global_row_number(grouped, "v", ["n"], edges, by=["g"]).collect())

    assert places([]) == places([7.0, 33.0])


@pytest.mark.parametrize("n", [30, 40, 400])
def test_rows_without_a_label_are_in_no_sample(spark, n):
    df = spark.range(50).select("id", F.when(F.col("id") < 40, F.col("id") % 2 == 0).alias("y"))
    got = V.stratified_sample(df, "y", n, "id")
    assert got.count() == min(n, 40) and got.where("y is null").count() == 0


def test_unlabelled_rows_leave_the_bootstrap_alone(spark):
    clean = spark.range(300).select(F.lit("m").alias("model"), (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") * 37) % 300 / 300).alias("p"), F.col("id").alias("row_id"))
    extra = spark.range(90).select(F.lit("m").alias("model"), F.lit(None).cast("int").alias("y"), F.lit(0.9).alias("p"), (F.col("id") + 1000).alias("row_id"))
    a, b = (bootstrap.bootstrap_ci(df, reps=20, buckets=None).first() for df in (clean, clean.union(extra)))
    assert a == b and a["roc_auc"] == metrics.roc_auc(clean).first()["roc_auc"]


def test_blocks_of_derived_names():
    for prefix, block in roles.BLOCKS.items():
        assert roles.block_of(f"{prefix}x") == block and roles.block_of(f"missingindicator_{prefix}x") == f"{block} (absence)"
    for name in (n for n in roles.HIGH_CARDINALITY if not n.startswith(tuple(roles.BLOCKS))):
        assert roles.block_of(name) == roles.block_of(f"{name}_te") == roles.GEO_BLOCK
    assert roles.block_of("unknown") == roles.OTHER_BLOCK and roles.block_of("missingindicator_unknown") == f"{roles.OTHER_BLOCK} (absence)"


def test_magnitude_rank_puts_null_last(spark):
    df = spark.createDataFrame([("a", -5.0), ("b", 5.0), ("c", None), ("d", 7.0)], "k string, v double")
    assert [(r["k"], r["place"]) for r in W.rank_by_abs(df, "v", "k", "place").collect()] == [("d", 1), ("a", 2), ("b", 3), ("c", 4)]
