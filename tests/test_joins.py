from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import joins as J
from conftest import rows


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame([(1, 2023, "a", "M"), (2, 2024, "a", "M"), (3, 2024, "b", "E"), (4, 2024, "z", None)],
                                 "id int, year int, g string, seg string")


def test_enrich_keeps_every_row_and_order_of_columns(spark, units):
    ctx1 = spark.createDataFrame([(2024, "a", 0.5), (2023, "b", 0.1)], "year int, g string, rate double")
    ctx2 = spark.createDataFrame([(2024, "a", "M", 7)], "year int, g string, seg string, size int")
    out = J.enrich(units, [(ctx1, ["year", "g"]), (ctx2, ["year", "g", "seg"])])
    assert out.columns == ["id", "year", "g", "seg", "rate", "size"]
    assert [(r["id"], r["rate"], r["size"]) for r in rows(out, "id")] == [
        (1, None, None), (2, 0.5, 7), (3, None, None), (4, None, None)]


def test_fan_out_is_refused(spark, units):
    twice = spark.createDataFrame([(2024, "a", 0.5), (2024, "a", 0.6)], "year int, g string, rate double")
    with pytest.raises(J.DuplicateKeyError):
        J.enrich(units, [(twice, ["year", "g"])])
    with pytest.raises(J.DuplicateKeyError):
        J.assert_unique(twice, ["year", "g"])
    assert J.assert_unique(units, ["id"]) == 4
    assert rows(J.duplicate_keys(twice, ["year", "g"])) == [{"year": 2024, "g": "a", "n_rows": 2}]


def test_dimension_beyond_the_budget_is_not_broadcast(spark, units):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ctx = spark.createDataFrame([("a", 1), ("b", 2)], "g string, v int")
        small, left = J.attach_dimension(units, ctx, ["g"], 2)
        large, same = J.attach_dimension(units, ctx, ["g"], 10**9)
        plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan(small) and left < J.BROADCAST_BUDGET
        assert "BroadcastHashJoin" not in plan(large) and same == J.BROADCAST_BUDGET
        assert rows(small, "id") == rows(large, "id")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lag_is_a_calendar_lag(spark):
    left = spark.createDataFrame([(2020, "a"), (2022, "a"), (2023, "a")], "year int, g string")
    right = spark.createDataFrame([(2019, "a", 1.0), (2022, "a", 2.0)], "year int, g string, v double")
    assert [(r["year"], r["v"]) for r in rows(J.lag_join(left, right, ["g"]), "year")] == [
        (2020, 1.0), (2022, None), (2023, 2.0)]


def test_edition_map_reads_only_published_editions(spark):
    releases = spark.createDataFrame([(2020, 2019), (2022, 2021), (2024, 2023)], "release int, edition int")
    years = spark.createDataFrame([(y,) for y in (2020, 2021, 2022, 2022, 2023, 2024, 2025, 2090, None)], "year int")
    got = {r["year"]: (r["edition"], r["previous_edition"])
           for r in J.edition_map(releases, years, "year", "release", "edition").collect()}
    # In the year of its release an edition is not yet known.
    assert got == {2021: (2019, None), 2022: (2019, None), 2023: (2021, 2019), 2024: (2021, 2019),
                   2025: (2023, 2021), 2090: (2023, 2021)}


def test_asof_join_attaches_the_mapped_edition(spark):
    left = spark.createDataFrame([(2023, "a"), (2024, "a"), (2024, "b")], "year int, g string")
    editions = spark.createDataFrame([(2021, "a", 1.0), (2023, "a", 3.0)], "edition int, g string, v double")
    m = spark.createDataFrame([(2023, 2021), (2024, 2023)], "year int, edition int")
    got = rows(J.asof_release_join(left, editions, m, ["g"], "year", "edition"), "year", "g")
    assert [r["v"] for r in got] == [1.0, 3.0, None]


def test_grid_is_complete_and_needs_no_shuffle(spark):
    entities = spark.createDataFrame([("a",), ("b",)], "g string")
    out = J.grid(entities, {"year": [1, 2], "seg": ["x", "y", "z"]})
    assert out.count() == 12 and out.distinct().count() == 12
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_outer_merge_coalesces_keys(spark):
    a = spark.createDataFrame([(1, "a")], "k int, a string")
    b = spark.createDataFrame([(2, "b")], "k int, b string")
    c = spark.createDataFrame([(1, "c"), (3, "c")], "k int, c string")
    assert [r["k"] for r in rows(J.outer_merge([a, b, c], ["k"]), "k")] == [1, 2, 3]


def test_strata_labels(spark):
    train = spark.createDataFrame([("a", "X"), ("b", "X")], "g string, p string")
    test = spark.createDataFrame([(1, "a", "X"), (2, "c", "X"), (3, "z", "Y")], "id int, g string, p string")
    got = rows(J.coverage_strata(test, train, "g", "p"), "id")
    assert [r["stratum"] for r in got] == ["group seen", "group new, parent seen", "parent new"]


def test_conflicting_targets_are_an_error(spark):
    ranking = spark.createDataFrame([("a",), ("b",)], "g string")
    ok = spark.createDataFrame([("a", 60.0), ("a", 60.0)], "g string, goal double")
    assert [r["goal"] for r in rows(J.attach_targets(ranking, ok, "g", ["goal"]), "g")] == [60.0, None]
    bad = spark.createDataFrame([("a", 60.0), ("a", 61.0)], "g string, goal double")
    with pytest.raises(Exception, match="conflicting goal"):
        J.attach_targets(ranking, bad, "g", ["goal"]).collect()


def test_row_preserving_guard(spark, units):
    assert J.assert_row_preserving(units, units) == 4
    with pytest.raises(ValueError):
        J.assert_row_preserving(units, units.limit(3))


def test_roles_of_one_table(spark, units):
    src = spark.createDataFrame([("a", "own", 1.0), ("a", "public", 2.0), ("b", "own", 3.0)], "g string, role string, v double")
    got = rows(J.role_join(units.select("g").distinct(), src, ["g"], {
        "own": (F.col("role") == "own", "v"), "public": (F.col("role") == "public", "v")}), "g")
    assert [(r["own"], r["public"]) for r in got] == [(1.0, 2.0), (3.0, None), (None, None)]
