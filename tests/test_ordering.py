from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators import ordering as W
from conftest import rows


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(3000), "g": rng.choice(["hot", "b", "c"], 3000, p=[0.7, 0.2, 0.1]),
                        "v": np.round(rng.normal(size=3000), 2)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("size", [40, 700, 10_000])
@pytest.mark.parametrize("desc", [False, True])
def test_running_total_does_not_depend_on_buckets(numbers, size, desc):
    pdf, df = numbers
    edges = W.quantile_edges(df, "v", size)
    assert (len(edges) > 3) == (size < 1000)
    got = W.distributed_cumsum(df.withColumn("one", F.lit(1)), ["g"], "v", {"c": "one"}, edges, desc, ["id"]).toPandas()
    want = pdf.sort_values(["v", "id"], ascending=[not desc, True]).groupby("g").cumcount() + 1
    assert (got.set_index("id")["c"].sort_index() == want.sort_index()).all()


def test_bucketed_plan_has_no_single_partition_step(numbers):
    _, df = numbers
    edges = W.quantile_edges(df, "v", 100)
    plan = W.global_row_number(df, "v", ["id"], edges, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_ranks_over_everything(numbers):
    pdf, df = numbers
    got = W.hash_rank(df, 1, ["id"], buckets=16).toPandas()
    assert sorted(got["hash_rank"]) == list(range(1, 3001))
    assert got.sort_values("hash_rank")["id"].tolist() != list(range(3000))


@pytest.mark.parametrize("keep", [50, 100_000])
def test_exact_quantiles_equal_numpy(spark, numbers, keep):
    pdf, df = numbers
    with_null = df.withColumn("w", F.when(F.col("g") != "c", F.col("v") * F.col("v"))).withColumn("none", F.lit(None).cast("double"))
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = W.exact_quantiles(with_null, ["v", "w", "none"], probs, keep=keep)
    np.testing.assert_allclose(got["v"], np.quantile(pdf["v"], probs), atol=1e-12)
    np.testing.assert_allclose(got["w"], np.quantile(pdf.loc[pdf["g"] != "c", "v"] ** 2, probs), atol=1e-12)
    assert got["none"] == [None] * 5


def test_exact_quantiles_narrow_large_columns(spark):
    df = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("v"))
    got = W.exact_quantiles(df, ["v"], [0.5, 0.999], keep=1000)["v"]
    np.testing.assert_allclose(got, np.quantile(df.toPandas()["v"], [0.5, 0.999]), atol=1e-9)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-5, 5)), min_size=1, max_size=30))
def test_quantiles_by_group_equal_numpy(spark, data):
    df = spark.createDataFrame([(g, float(v)) for g, v in data], "g string, v double")
    got = {r["g"]: r for r in W.quantiles_by(df, ["g"], "v", {"lo": 0.1, "mid": 0.5}, W.even_edges(-5, 5, 4), n="n").collect()}
    for g in {g for g, _ in data}:
        values = [v for h, v in data if h == g]
        assert got[g]["n"] == len(values)
        assert got[g]["lo"] == pytest.approx(np.quantile(values, 0.1)) and got[g]["mid"] == pytest.approx(np.median(values))


def test_peer_adjust(spark):
    df = spark.createDataFrame([(1, "p", 1.0), (2, "p", 5.0), (3, "p", 2.0), (4, "q", 9.0), (5, "q", None)], "id int, p string, v double")
    got = rows(W.peer_adjust(df, "v", "p"), "id")
    assert [r["adjusted"] for r in got] == [-1.0, 3.0, 0.0, 0.0, None]


def test_top_k_puts_missing_last_and_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("b", 2.0, 5), ("c", 2.0, 5), ("d", None, 5), ("e", 9.0, 1)], "k string, v double, n int")
    assert [r["k"] for r in W.top_k(df, "v", 2, "k", min_n=5).collect()] == ["b", "c"]
    assert [r["k"] for r in W.bottom_k(df, "v", 4, "k", min_n=5).collect()] == ["a", "b", "c", "d"]
    assert [r["k"] for r in W.rank_by_abs(df, "v", "k").collect()] == ["e", "b", "c", "a", "d"]
    assert "TakeOrderedAndProject" in W.top_k(df, "v", 2, "k")._jdf.queryExecution().executedPlan().toString()


def test_many_edges_give_the_same_buckets_without_naming_them_in_the_plan(spark, monkeypatch):
    df = spark.range(600).select("id", F.when(F.col("id") % 7 != 0, F.col("id") / 3 - 20).alias("v"))
    df = df.union(spark.sql("SELECT 600L, double('inf') UNION ALL SELECT 601L, double('-inf')"))
    edges = [float(x) for x in range(-30, 200, 2)]
    few = W.with_bucket(df, "v", edges)
    monkeypatch.setattr(W, "MANY_EDGES", 3)
    many = W.with_bucket(df, "v", edges)
    assert sorted(few.collect(), key=lambda r: r["id"]) == sorted(many.collect(), key=lambda r: r["id"])
    assert many.schema["_bucket"].metadata == {} != few.schema["_bucket"].metadata
