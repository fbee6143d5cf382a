from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import splits as V


@pytest.fixture(scope="module")
def base(spark):
    rng = np.random.default_rng(0)
    n = 4000
    return spark.createDataFrame(pd.DataFrame({
        "id": range(n), "year": rng.choice([2023, 2024], n), "g": rng.choice([f"m{i}" for i in range(120)], n),
        "p": rng.choice(list("ABCDE"), n), "t": rng.integers(0, 2, n).astype(bool)})).persist()


def test_temporal_split_does_not_mix_years(base):
    train, test = V.temporal_split(base, "year", 2023, 2024)
    assert {r[0] for r in train.select("year").distinct().collect()} == {2023}
    assert {r[0] for r in test.select("year").distinct().collect()} == {2024}
    with pytest.raises(ValueError):
        V.temporal_split(base, "year", 2023, 2023)


def test_group_split_shares_no_group_and_loses_no_row(base):
    train, test = V.group_split(base, "g")
    V.assert_disjoint(train, test, "g")
    assert train.count() + test.count() == 4000
    assert test.select("g").distinct().count() == 30
    with pytest.raises(ValueError):
        V.assert_disjoint(base, base, "g")


def test_group_split_is_a_filter(base):
    _, test = V.group_split(base, "g")
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_folds_keep_groups_whole_and_rates_close(base):
    df = V.grouped_stratified_folds(base, "g", "t", 4)
    assert df.groupBy("g").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0
    rates = [r["r"] for r in df.groupBy("fold").agg(F.avg(F.col("t").cast("int")).alias("r")).collect()]
    assert len(rates) == 4 and max(rates) - min(rates) < 0.05


def test_stratified_sample_sizes(base):
    share = base.where("t").count() / 4000
    got = V.stratified_sample(base, "t", 500, "id")
    assert got.where("t").count() == round(500 * share) and got.where("NOT t").count() == round(500 * (1 - share))
    assert V.stratified_sample(base, "t", 9000, "id") is base and V.stratified_sample(base, "t", None, "id") is base
    assert got.select("id").distinct().count() == got.count()


@pytest.mark.parametrize("quota", [0, 1, 777, 4000, 5000])
def test_cap_is_exact_and_repeatable(base, quota):
    a = {r[0] for r in V.cap_sample(base, quota, "id", 3).select("id").collect()}
    b = {r[0] for r in V.cap_sample(base.repartition(7), quota, "id", 3).select("id").collect()}
    assert len(a) == min(quota, 4000) and a == b


def test_a_hot_group_stays_whole(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"g{i}", i % 2 == 0) for i in range(900)], "id int, g string, t boolean")
    folds = V.grouped_stratified_folds(df, "g", "t", 5)
    assert folds.where("g = 'hot'").select("fold").distinct().count() == 1 and folds.count() == 900


@pytest.mark.parametrize("quota", [1, 500, 2999])
def test_a_crowded_hash_range_is_narrowed_by_its_second_digit(spark, quota):
    df = spark.range(3000)
    got = {r[0] for r in df.where(V.first_by_hash(df, "id", 5, quota, most=0)).collect()}
    ordered = df.select(V.hash32(5, "id").alias("h"), "id").orderBy("h", "id").limit(quota)
    assert got == {r["id"] for r in ordered.collect()}


def test_folds_of_equal_rates_are_ranked_in_cells(spark):
    df = spark.range(4000).select(F.col("id"), (F.col("id") / 2).cast("int").alias("g"), F.lit(True).alias("t"))
    folds = V.fold_table(df, "g", "t", 4)
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [500] * 4
    placed = V._before(V._by_rate(df, "g", "t", 42).withColumn("_one", F.lit(1)), "g", "_one")
    assert sorted(r[0] for r in placed.select("_before").collect()) == list(range(2000))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_rate" in plan and "_digit" in plan


@pytest.fixture(scope="module")
def skewed(spark):
    """Groups of 1 to 4,000 rows, whose rates go from none to all."""
    rng = np.random.default_rng(7)
    sizes = np.r_[4000, 3000, 1500, rng.zipf(1.6, 3000).clip(1, 900)]
    rates = rng.choice([0.0, 0.2, 0.5, 1.0], len(sizes))
    g = np.repeat(np.arange(len(sizes)), sizes)
    t = rng.random(len(g)) < rates[g]
    return spark.createDataFrame(pd.DataFrame({"g": g, "t": t})).persist()


def test_balanced_folds_are_even_in_rows_and_rate(skewed):
    folds = V.grouped_stratified_folds(skewed, "g", "t", 5, even_rows=True)
    assert folds.groupBy("g").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0
    got = folds.groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.col("t").cast("int")).alias("rate")).collect()
    assert sorted(r["fold"] for r in got) == list(range(5)) and sum(r["n"] for r in got) == skewed.count()
    assert max(r["n"] for r in got) / min(r["n"] for r in got) < 1.05
    assert max(r["rate"] for r in got) - min(r["rate"] for r in got) < 0.03


@pytest.mark.parametrize("large", [1, 20, 100_000])
def test_balanced_folds_equal_a_plain_version(skewed, large):
    got = {r["g"]: r["fold"] for r in V.balanced_fold_table(skewed, "g", "t", 4, large=large).collect()}
    table = V._by_rate(skewed, "g", "t", 42).toPandas()
    total, held, want = int(table["n"].sum()), [[0, 0] for _ in range(4)], {}
    classes = [table["_pos"].sum(), total - table["_pos"].sum()]
    big = table[table["n"] * large * 4 > total].sort_values(["n", "_h", "g"], ascending=[False, True, True])
    for r in big.itertuples():
        size = (r._3, r.n - r._3)
        cost = [sum(((h[c] + size[c]) / classes[c]) ** 2 - (h[c] / classes[c]) ** 2 for c in range(2)) for h in held]
        want[r.g] = int(np.argmin(cost))
        held[want[r.g]] = [held[want[r.g]][c] + size[c] for c in range(2)]
    small = table[~table["g"].isin(want)].sort_values(["_rate", "_h", "g"])
    if len(small):
        rest, marks = int(small["n"].sum()), np.cumsum(V.room_left(np.sum(held, 1), small["n"].sum()))
        before = 0
        for r in small.itertuples():
            lap = (2 * before + r.n) * 20 % (2 * rest) / (2 * rest)
            want[r.g] = int(np.searchsorted(marks[:-1] / marks[-1], lap, side="right"))
            before += r.n
    assert got == want


def test_a_group_above_the_level_leaves_its_fold_to_itself(spark):
    df = spark.createDataFrame([(0 if i < 600 else i, i % 2 == 0) for i in range(1000)], "g int, t boolean")
    sizes = {r["fold"]: r["n"] for r in V.balanced_fold_table(df, "g", "t", 5, large=2).groupBy("fold").agg(F.sum("n").alias("n")).collect()}
    assert sorted(sizes.values()) == [100, 100, 100, 100, 600]
    assert V.room_left(np.array([600.0, 0, 0, 0, 0]), 400).tolist() == [0, 100, 100, 100, 100]
    empty = V.balanced_fold_table(df.where("g < 0"), "g", "t", 5)
    assert empty.columns == ["g", "n", "fold"] and empty.count() == 0
