"""Projections, joins, aggregations, top-k, set operations (P, J, A, W, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import (
    contains_ci, decode, explode_literal, fallback_with_flag, filled_sum, flag, literal_relation,
    normalize_label, pick_by_year, safe_div, safe_log, select_except, slice_filter, starts_with,
    title_label, to_code, zero_fill)
from cohortlens.operators import aggregates as A
from cohortlens.operators import joins as J
from cohortlens.operators import ordering as W
from workload.registry import R, Star, query, sql

YEARS = list(range(1995, 2002))
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
EDITIONS = [1995, 1997, 1999, 2001]


# --- projections and predicates -------------------------------------------------------------

@query("p1_evaluated_population", sql("SELECT * REPLACE (round(wealth, 6) AS wealth) FROM evaluated", "evaluated"))
def _(s: Star):
    return s.evaluated


@query("p2_decode", """
    SELECT label, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'Accepted' WHEN 'N' THEN 'None' END AS label
    FROM lineitem) WHERE label IS NOT NULL GROUP BY label""")
def _(s: Star):
    label = decode("l_returnflag", {"A": "Accepted", "N": "None"})
    return (s.t("lineitem").select(label.alias("label")).where(F.col("label").isNotNull())
            .groupBy("label").agg(F.count(F.lit(1)).alias("n")))


@query("p3_normalize_label", """
    SELECT upper(k[1]) || k[2:] AS label, count(*) AS n FROM (
      SELECT replace(replace(lower(c_mktsegment || 'ÇÃO'), 'ç', 'c'), 'ã', 'a') AS k FROM customer) GROUP BY 1""")
def _(s: Star):
    key = normalize_label(F.concat("c_mktsegment", F.lit("ÇÃO")))
    return s.t("customer").groupBy(title_label(key).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("p4_flag", sql("""
    SELECT segment, CAST(sum(CASE WHEN wealth > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS n_wealthy, count(*) AS n
    FROM units GROUP BY segment""", "units"))
def _(s: Star):
    return s.units.groupBy("segment").agg(
        F.sum(flag(F.col("wealth") > 5000)).alias("n_wealthy"), F.count(F.lit(1)).alias("n"))


@query("p5_zero_fill", sql(f"""
    SELECT unit_id, {R('coalesce(wealth, 0)')} AS filled, {R('coalesce(wealth, 0) + coalesce(weight, 0)')} AS total
    FROM units""", "units"))
def _(s: Star):
    return s.units.select("unit_id", zero_fill("wealth").alias("filled"),
                          filled_sum("wealth", "weight").alias("total"))


@query("p6_safe_div", sql(f"""
    SELECT school, year, {R('sum(CAST(present AS INTEGER)) / nullif(CAST(sum(CAST(completed AS INTEGER)) AS DOUBLE), 0)')}
      AS ratio FROM units GROUP BY school, year""", "units"))
def _(s: Star):
    return s.units.groupBy("school", "year").agg(
        safe_div(F.sum(F.col("present").cast("int")), F.sum(F.col("completed").cast("int"))).alias("ratio"))


@query("p7_safe_log", f"SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN {R('ln(c_acctbal)')} END AS log_balance FROM customer")
def _(s: Star):
    return s.t("customer").select("c_custkey", safe_log("c_acctbal").alias("log_balance"))


@query("p8_fallback_with_flag", sql(f"""
    SELECT unit_id, {R('coalesce(wealth, score)')} AS value, wealth IS NULL AND score IS NOT NULL AS imputed
    FROM units""", "units"))
def _(s: Star):
    value, imputed = fallback_with_flag("wealth", "score")
    return s.units.select("unit_id", value.alias("value"), imputed.alias("imputed"))


@query("p9_pick_by_year", sql(f"""
    SELECT unit_id, {R('v')} AS picked, {R('v - score')} AS gap FROM (
      SELECT unit_id, score, CASE year WHEN 1999 THEN score * 0.5 WHEN 2000 THEN wealth
        WHEN 2001 THEN CAST(weight AS DOUBLE) END AS v FROM units)""", "units"))
def _(s: Star):
    v = pick_by_year("year", {1999: F.col("score") * 0.5, 2000: "wealth", 2001: F.col("weight").cast("double")})
    return s.units.select("unit_id", v.alias("picked"), (v - F.col("score")).alias("gap"))


@query("p10_text_match", """
    SELECT p_brand, CAST(sum(CASE WHEN p_name LIKE 'blue%' THEN p_size ELSE 0 END) AS BIGINT) AS blue_size,
           count(*) FILTER (WHERE lower(p_type) LIKE '%standard%') AS n_standard FROM part GROUP BY p_brand""")
def _(s: Star):
    return s.t("part").groupBy("p_brand").agg(
        F.sum(F.when(starts_with("p_name", "blue"), F.col("p_size")).otherwise(0)).alias("blue_size"),
        F.count_if(contains_ci("p_type", "standard")).alias("n_standard"))


@query("p11_to_code", """
    SELECT code, count(*) AS n FROM (SELECT TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority
      ELSE substr(o_orderpriority, 1, 1) END AS BIGINT) AS code FROM orders)
    WHERE code IN (2, 3) OR code IS NULL GROUP BY code""")
def _(s: Star):
    text = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(
        F.substring("o_orderpriority", 1, 1))
    codes = s.t("orders").select(to_code(text).alias("code"))
    return (codes.where(F.col("code").isin(2, 3) | F.col("code").isNull())
            .groupBy("code").agg(F.count(F.lit(1)).alias("n")))


@query("p12_select_except", "SELECT * EXCLUDE (o_totalprice, o_orderdate) FROM orders")
def _(s: Star):
    return select_except(s.t("orders"), ["o_totalprice", "o_orderdate"])


@query("p13_literal_relation", sql("""
    SELECT ref, count(*) AS n FROM units JOIN (VALUES (1999, 1997), (2000, 1999)) m(year, ref) USING (year) GROUP BY ref""",
    "units"))
def _(s: Star):
    m = literal_relation(s.spark, "year int, ref int", [(1999, 1997), (2000, 1999)])
    return s.units.join(m, "year").groupBy("ref").agg(F.count(F.lit(1)).alias("n"))


@query("p14_explode_literal", """
    SELECT c_nationkey AS grp, label, count(*) AS n FROM customer, (VALUES ('own'), ('public'), ('private')) v(label)
    GROUP BY 1, 2""")
def _(s: Star):
    return (explode_literal(s.t("customer"), "label", ["own", "public", "private"])
            .groupBy(F.col("c_nationkey").alias("grp"), "label").agg(F.count(F.lit(1)).alias("n")))


@query("p15_slice_filter", sql("""
    SELECT unit_id, segment, year FROM units WHERE source = 'batch' AND segment IN ('BUILDING', 'FURNITURE')
      AND year BETWEEN 1997 AND 2000 AND target <> true AND wealth IS NULL""", "units"))
def _(s: Star):
    return slice_filter(s.units, eq={"source": "batch"}, in_={"segment": ["BUILDING", "FURNITURE"]},
                        between={"year": (1997, 2000)}, ne={"target": True},
                        is_null=["wealth"]).select("unit_id", "segment", "year")


@query("p16_derived_index", sql(f"""
    SELECT year, grp, {R('b - m')} AS gap, {R('100 * b')} AS pct_building, {R('s / w')} AS score_per_weight FROM (
      SELECT year, grp, avg(CASE WHEN segment = 'BUILDING' THEN CAST(CAST(target AS INTEGER) AS DOUBLE) END) AS b,
        avg(CASE WHEN segment = 'MACHINERY' THEN CAST(CAST(target AS INTEGER) AS DOUBLE) END) AS m,
        avg(score) AS s, avg(CAST(weight AS DOUBLE)) AS w FROM units GROUP BY year, grp)""", "units"))
def _(s: Star):
    y = F.col("target").cast("int").cast("double")
    g = s.units.groupBy("year", "grp").agg(
        F.avg(F.when(F.col("segment") == "BUILDING", y)).alias("b"),
        F.avg(F.when(F.col("segment") == "MACHINERY", y)).alias("m"),
        F.avg("score").alias("s"), F.avg("weight").alias("w"))
    return g.select("year", "grp", (F.col("b") - F.col("m")).alias("gap"),
                    (F.col("b") * 100).alias("pct_building"), safe_div("s", "w").alias("score_per_weight"))


# --- joins ------------------------------------------------------------------------------------

LAG = """SELECT year, grp, count(*) AS n, avg(CAST(CAST(target AS INTEGER) AS DOUBLE)) AS rate
         FROM evaluated GROUP BY year, grp"""
SEG = """SELECT year, grp, segment, avg(CAST(weight AS DOUBLE)) AS seg_weight FROM evaluated GROUP BY 1, 2, 3"""
SUP = """SELECT s_nationkey AS grp, count(*) AS n_suppliers FROM supplier GROUP BY 1"""


@query("j1_enrich", sql(f"""
    SELECT unit_id, {R('l.rate')} AS lag_rate, l.n AS lag_n, {R('seg_weight')} AS seg_weight, n_suppliers
    FROM evaluated e LEFT JOIN lag l ON l.year = e.year - 1 AND l.grp = e.grp
    LEFT JOIN seg g ON g.year = e.year AND g.grp = e.grp AND g.segment = e.segment
    LEFT JOIN sup p ON p.grp = e.grp""", "evaluated", lag=LAG, seg=SEG, sup=SUP))
def _(s: Star):
    e = s.evaluated
    lag = (A.outcome_by(e, ["year", "grp"], "target", n="lag_n", out="lag_rate")
           .withColumn("year", F.col("year") + 1))
    seg = e.groupBy("year", "grp", "segment").agg(F.avg("weight").alias("seg_weight"))
    sup = s.t("supplier").groupBy(F.col("s_nationkey").alias("grp")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return J.enrich(e.select("unit_id", "year", "grp", "segment"), [
        (lag, ["year", "grp"]), (seg, ["year", "grp", "segment"]), (sup, ["grp"]),
    ]).drop("year", "grp", "segment")


@query("j2_lag_join", sql(f"""
    SELECT a.year, a.grp, {R('a.rate')} AS rate, {R('b.rate')} AS previous_rate FROM lag a
    LEFT JOIN lag b ON b.year = a.year - 1 AND b.grp = a.grp""", "evaluated", lag=LAG))
def _(s: Star):
    g = A.outcome_by(s.evaluated, ["year", "grp"], "target").drop("n")
    return J.lag_join(g, g.withColumnRenamed("rate", "previous_rate"), ["grp"])


@query("j3_asof_release_join", sql(f"""
    SELECT y.year, y.grp, y.edition, {R('l.rate')} AS edition_rate, {R('q.rate')} AS previous_rate FROM (
      SELECT year, grp, max(e) FILTER (WHERE e < year) AS edition FROM lag, (VALUES (1995), (1997), (1999), (2001)) v(e)
      GROUP BY year, grp) y
    LEFT JOIN lag l ON l.year = y.edition AND l.grp = y.grp
    LEFT JOIN lag q ON q.year = y.edition - 2 AND q.grp = y.grp""", "evaluated", lag=LAG))
def _(s: Star):
    g = A.outcome_by(s.evaluated, ["year", "grp"], "target").drop("n")
    editions = g.where(F.col("year").isin(EDITIONS)).select(F.col("year").alias("edition"), "grp", "rate")
    releases = literal_relation(s.spark, "release int, edition int", [(e, e) for e in EDITIONS])
    m = J.edition_map(releases, g, "year", "release", "edition")
    left = g.select("year", "grp").join(m, "year", "left")
    now = J.asof_release_join(left.drop("edition", "previous_edition"),
                              editions.withColumnRenamed("rate", "edition_rate"), m, ["grp"], "year", "edition")
    before = J.asof_release_join(
        left.select("year", "grp"),
        editions.select(F.col("edition").alias("previous_edition"), "grp", F.col("rate").alias("previous_rate")),
        m, ["grp"], "year", "previous_edition").drop("previous_edition")
    return (left.select("year", "grp", "edition").join(now.drop("edition"), ["year", "grp"])
            .join(before, ["year", "grp"]))


@query("j4_grid", sql("""
    SELECT k.grp, y.year, g.segment, count(u.unit_id) AS n FROM (SELECT n_nationkey AS grp FROM nation) k
    CROSS JOIN (VALUES (1995), (1996), (1997), (1998), (1999), (2000), (2001)) y(year)
    CROSS JOIN (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY')) g(segment)
    LEFT JOIN evaluated u ON u.grp = k.grp AND u.year = y.year AND u.segment = g.segment GROUP BY ALL""", "evaluated"))
def _(s: Star):
    keys = ["grp", "year", "segment"]
    spine = J.grid(s.t("nation").select(F.col("n_nationkey").alias("grp")), {"year": YEARS, "segment": SEGMENTS})
    counts = s.evaluated.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, keys, "left").select(*keys, zero_fill("n").alias("n"))


# All units of all years: each is completed or not, which priorities decide, so every part lacks keys that others have.
@query("j5_outer_merge_all_years", sql("""
    SELECT * FROM (SELECT year, grp, control, count(*) AS n_stream FROM units WHERE source = 'stream' GROUP BY 1, 2, 3)
    FULL JOIN (SELECT year, grp, control, count(*) AS n_completed FROM units WHERE completed GROUP BY 1, 2, 3) USING (year, grp, control)
    FULL JOIN (SELECT year, grp, control, count(*) AS n_not_completed FROM units WHERE NOT completed GROUP BY 1, 2, 3) USING (year, grp, control)
    FULL JOIN (SELECT year, grp, control, count(*) AS n_target FROM units WHERE target GROUP BY 1, 2, 3) USING (year, grp, control)""",
    "units"), also="j5_outer_merge")
def _(s: Star):
    keys = ["year", "grp", "control"]
    parts = {"n_stream": F.col("source") == "stream", "n_completed": F.col("completed"), "n_not_completed": ~F.col("completed"),
             "n_target": F.col("target")}
    return J.outer_merge([s.units.where(c).groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for n, c in parts.items()], keys)


@query("j6_role_join", sql(f"""
    SELECT b.year, b.grp, {R('x.rate')} AS building_rate, {R('m.rate')} AS machinery_rate
    FROM (SELECT DISTINCT year, grp FROM evaluated) b
    LEFT JOIN r x ON x.year = b.year AND x.grp = b.grp AND x.segment = 'BUILDING'
    LEFT JOIN r m ON m.year = b.year AND m.grp = b.grp AND m.segment = 'MACHINERY'""", "evaluated",
    r="SELECT year, grp, segment, avg(CAST(CAST(target AS INTEGER) AS DOUBLE)) AS rate FROM evaluated GROUP BY 1, 2, 3"))
def _(s: Star):
    e = s.evaluated
    rates = A.outcome_by(e, ["year", "grp", "segment"], "target")
    return J.role_join(A.distinct_keys(e, ["year", "grp"]), rates, ["year", "grp"], {
        "building_rate": (F.col("segment") == "BUILDING", "rate"),
        "machinery_rate": (F.col("segment") == "MACHINERY", "rate")})


@query("j7_map_join", sql(f"""
    SELECT m.year, r.grp, {R('r.rate')} AS rate FROM lag r JOIN (VALUES (1999, 1997), (2000, 1999)) m(year, edition)
    ON r.year = m.edition""", "evaluated", lag=LAG))
def _(s: Star):
    m = literal_relation(s.spark, "year int, edition int", [(1999, 1997), (2000, 1999)])
    g = A.outcome_by(s.evaluated, ["year", "grp"], "target")
    return J.map_join(g.withColumnRenamed("year", "edition"), m, ["edition"]).select("year", "grp", "rate")


@query("j8_coverage_strata", sql("""
    SELECT unit_id, CASE WHEN school IN (SELECT school FROM train) THEN 'group seen'
      WHEN parent IN (SELECT parent FROM train) THEN 'group new, parent seen' ELSE 'parent new' END AS stratum
    FROM evaluated WHERE year = 2000""", "evaluated", train="""
    SELECT e.* FROM evaluated e JOIN region ON r_regionkey = parent WHERE year = 1999 AND r_name <> 'AFRICA'"""))
def _(s: Star):
    e = s.evaluated
    train = (e.where(F.col("year") == 1999).join(s.t("region"), F.col("parent") == F.col("r_regionkey"))
             .where(F.col("r_name") != "AFRICA"))
    return J.coverage_strata(e.where(F.col("year") == 2000), train, "school", "parent").select("unit_id", "stratum")


# Goals from all units of all years; those of one segment have no value.
@query("j9_attach_all_years", sql(f"""
    SELECT school, n, {R('rate')} AS rate, CAST(goal AS BIGINT) AS goal FROM
      (SELECT school, count(*) AS n, avg(CAST(CAST(target AS INTEGER) AS DOUBLE)) AS rate FROM evaluated GROUP BY 1)
    LEFT JOIN (SELECT DISTINCT school, CASE WHEN segment <> 'BUILDING' THEN 55 + grp % 20 END AS goal FROM units) USING (school)""", "evaluated"), also="j9_attach")
def _(s: Star):
    ranking = A.outcome_by(s.evaluated, ["school"], "target")
    goals = s.units.select("school", F.when(F.col("segment") != "BUILDING", 55 + F.col("grp") % 20).cast("bigint").alias("goal"))
    return J.attach_targets(ranking, goals, "school", ["goal"])


@query("j10_duplicate_keys", """
    SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(s: Star):
    return J.duplicate_keys(s.t("lineitem"), ["l_orderkey", "l_linenumber"])


# --- aggregations -----------------------------------------------------------------------------

@query("a1_outcome_by", sql(f"""
    SELECT year, grp, count(*) AS n, count(DISTINCT school) AS n_units,
      {R('avg(CAST(CAST(target AS INTEGER) AS DOUBLE))')} AS rate FROM evaluated GROUP BY 1, 2""", "evaluated"))
def _(s: Star):
    return A.outcome_by(s.evaluated, ["year", "grp"], "target", "school")


@query("a2_weighted_rollup", sql(f"""
    SELECT year, grp, count(*) AS n, {R('sum(open_line * quantity) / nullif(sum(quantity), 0)')} AS share_open,
      {R('sum(returned * quantity) / nullif(sum(quantity), 0)')} AS share_returned FROM lines GROUP BY 1, 2""", "lines"))
def _(s: Star):
    return A.weighted_rollup(s.lines, ["year", "grp"], {"share_open": "open_line", "share_returned": "returned"},
                             "quantity", extra=[F.count(F.lit(1)).alias("n")])


@query("a2_weighted_rollup_skip", sql(f"""
    SELECT year, grp, {R('sum(returned * quantity) / nullif(sum(quantity) FILTER (WHERE returned IS NOT NULL), 0)')}
      AS share_returned FROM lines GROUP BY 1, 2""", "lines"))
def _(s: Star):
    return A.weighted_rollup(s.lines, ["year", "grp"], {"share_returned": "returned"}, "quantity", "skip")


@query("a3_ratio_of_sums", sql(f"""
    SELECT year, grp, {R('sum(price) / nullif(sum(quantity), 0)')} AS unit_price,
      {R('sum(returned) / nullif(CAST(sum(open_line) AS DOUBLE), 0)')} AS returned_per_open FROM lines GROUP BY 1, 2""", "lines"))
def _(s: Star):
    return A.ratio_of_sums(s.lines, ["year", "grp"], {
        "unit_price": ("price", "quantity"), "returned_per_open": ("returned", "open_line")})


@query("a4_conditional_pivot", f"""
    SELECT user_id, {R("max(CASE WHEN event_type = 'click' THEN value END)")} AS click,
      {R("max(CASE WHEN event_type = 'purchase' THEN value END)")} AS purchase,
      {R("max(CASE WHEN event_type = 'view' THEN value * 2 END)")} AS double_view
    FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY 1""")
def _(s: Star):
    return A.conditional_pivot(s.t("events"), ["user_id"], {
        "click": ("click", "value"), "purchase": ("purchase", "value"),
        "double_view": ("view", F.col("value") * 2)}, code="event_type")


@query("a5_share_where", sql(f"""
    SELECT year, grp, {R("sum(CASE WHEN code = 'A' THEN quantity ELSE 0 END) / nullif(sum(quantity), 0)")} AS share_a,
      {R("sum(CASE WHEN code = 'R' AND open_line = 1 THEN quantity ELSE 0 END) / nullif(sum(CASE WHEN open_line = 1 THEN quantity ELSE 0 END), 0)")}
      AS share_r_of_open FROM lines GROUP BY 1, 2""", "lines"))
def _(s: Star):
    return A.share_where(s.lines, ["year", "grp"], "quantity", {
        "share_a": (F.col("code") == "A", None),
        "share_r_of_open": (F.col("code") == "R", F.col("open_line") == 1)})


@query("a6_group_profile", f"""
    SELECT c_nationkey, count(*) AS n, min(c_mktsegment) AS c_mktsegment, {R('stddev_samp(c_acctbal)')} AS spread,
      {R('min(c_acctbal)')} AS minimum, {R('100.0 * count(*) FILTER (WHERE c_acctbal < 0) / count(*)')} AS pct
    FROM customer GROUP BY 1""")
def _(s: Star):
    return A.group_profile(s.t("customer"), ["c_nationkey"], "c_acctbal", "c_mktsegment", F.col("c_acctbal") < 0)


@query("a7_weighted_mean", sql(f"""
    SELECT year, grp, {R('sum(discount * quantity) / nullif(sum(quantity), 0)')} AS weighted_mean FROM lines GROUP BY 1, 2""", "lines"))
def _(s: Star):
    return A.weighted_mean(s.lines, ["year", "grp"], "discount", "quantity")


@query("a8_ratio_of_means", sql(f"""
    SELECT grp, {R('avg(returned) / nullif(avg(open_line), 0)')} AS returned_to_open, {R('avg(price) / nullif(avg(quantity), 0)')} AS unit_price
    FROM lines GROUP BY 1""", "lines"))
def _(s: Star):
    return A.ratio_of_means(s.lines, ["grp"], {"returned_to_open": ("returned", "open_line"),
                                               "unit_price": ("price", "quantity")})


@query("a9_count_sum_by", sql(f"""
    SELECT year, grp, count(*) AS n, {R('sum(quantity)')} AS total FROM lines WHERE month = 6 GROUP BY 1, 2""", "lines"))
def _(s: Star):
    return A.count_sum_by(s.lines, ["year", "grp"], "quantity", F.col("month") == 6)


@query("a10_parent_deviation", sql(f"""
    SELECT c.year, c.parent, c.grp, {R('c.m')} AS child_mean, {R('p.m')} AS parent_mean, {R('c.m - p.m')} AS deviation FROM
      (SELECT year, parent, grp, sum(score * weight) / sum(weight) AS m FROM units GROUP BY 1, 2, 3) c JOIN
      (SELECT year, parent, sum(score * weight) / sum(weight) AS m FROM units GROUP BY 1, 2) p USING (year, parent)""", "units"))
def _(s: Star):
    return A.parent_deviation(s.units, ["year"], "grp", "parent", "score", "weight")


@query("a11_shrunk_rate", sql(f"""
    SELECT year, parent, grp, n, CAST(positives AS BIGINT) AS positives, {R('positives / n')} AS raw_rate, {R('pr')} AS parent_rate,
      {R('(positives + 30 * pr) / (n + 30)')} AS shrunk_rate, {R('(positives + 30 * pr) / (n + 30) - pr')} AS deviation FROM
      (SELECT year, parent, grp, count(*) AS n, CAST(sum(CAST(target AS INTEGER)) AS DOUBLE) AS positives FROM evaluated GROUP BY 1, 2, 3)
    JOIN (SELECT year, parent, avg(CAST(CAST(target AS INTEGER) AS DOUBLE)) AS pr FROM evaluated GROUP BY 1, 2) USING (year, parent)""",
    "evaluated").replace("CAST(positives AS BIGINT) AS positives, ", ""))
def _(s: Star):
    return A.shrunk_rate(s.evaluated, ["year"], "grp", "parent", "target")


@query("a12_dedupe", """
    SELECT * EXCLUDE (rn, l_shipdate) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate NULLS LAST,
      l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1""")
def _(s: Star):
    return A.dedupe(s.t("lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"]).drop("l_shipdate")


SEGMENT_SQL = """SELECT year, grp, segment, count(*) AS n, sum(CAST(target AS INTEGER)) AS pos, max(wealth) AS wealth,
    max(weight) AS weight FROM evaluated GROUP BY 1, 2, 3"""


def _pick(col: str) -> str:
    return f"""(SELECT {col} FROM seg s WHERE s.year = t.year AND s.grp = t.grp AND {col} IS NOT NULL
        ORDER BY s.n DESC, s.segment LIMIT 1) AS {col}"""


@query("a13_aggregate_groups", sql(f"""
    SELECT year, grp, CAST(n AS BIGINT) AS n, {R('pos / n')} AS target, round(wealth, 6) AS wealth, weight FROM (
      SELECT t.year, t.grp, t.n, t.pos, {_pick('wealth')}, {_pick('weight')} FROM
        (SELECT year, grp, sum(n) AS n, sum(pos) AS pos FROM seg GROUP BY 1, 2) t) WHERE n >= 5""", "evaluated", seg=SEGMENT_SQL))
def _(s: Star):
    return A.aggregate_groups(s.evaluated, ["year", "grp"], "segment", "target", ["wealth", "weight"], min_n=5)


@query("a14_rate_by", sql(f"""
    SELECT year, segment, count(*) AS n, {R('avg(CAST(CAST(target AS INTEGER) AS DOUBLE))')} AS rate FROM evaluated
    GROUP BY 1, 2 HAVING count(*) >= 20""", "evaluated"))
def _(s: Star):
    return A.rate_by(s.evaluated, ["year", "segment"], "target", 20)


@query("a16_missing_profile", sql(f"""
    SELECT * FROM (SELECT 'wealth' AS feature, {R('100.0 * count(*) FILTER (WHERE wealth IS NULL) / count(*)')} AS pct_missing FROM units
    UNION ALL SELECT 'target', {R('100.0 * count(*) FILTER (WHERE target IS NULL) / count(*)')} FROM units
    UNION ALL SELECT 'score', {R('100.0 * count(*) FILTER (WHERE score IS NULL) / count(*)')} FROM units) WHERE pct_missing > 0""", "units"))
def _(s: Star):
    return A.missing_profile(s.units, ["wealth", "target", "score", "segment"])


@query("a17_value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(s: Star):
    return A.value_counts(s.t("orders"), "o_orderpriority")


@query("a18_year_summary", sql(f"""
    SELECT year, count(*) AS n, {R('avg(CAST(CAST(target AS INTEGER) AS DOUBLE))')} AS rate FROM evaluated GROUP BY 1""", "evaluated"))
def _(s: Star):
    return A.year_summary(s.evaluated, "year", "target")


@query("u1_union_sources", """
    SELECT c_nationkey AS grp, 'customer' AS code, c_acctbal AS balance, false AS upper_level FROM customer
    UNION ALL SELECT s_nationkey, 'supplier', s_acctbal, true FROM supplier""")
def _(s: Star):
    c = s.t("customer").select(F.col("c_nationkey").alias("grp"), F.lit("customer").alias("code"), F.col("c_acctbal").alias("balance"))
    p = s.t("supplier").select(F.lit("supplier").alias("code"), F.col("s_nationkey").alias("grp"), F.col("s_acctbal").alias("balance"))
    return A.union_sources([(c, False), (p, True)], "upper_level")


@query("u2_distinct_keys", sql("SELECT DISTINCT grp, segment, year FROM units", "units"))
def _(s: Star):
    return A.distinct_keys(s.units, ["grp", "segment", "year"])


# --- windows, sorts, top-k ----------------------------------------------------------------------

@query("w1_first_per_key", sql("""
    SELECT school, year, unit_id, control FROM (SELECT *, row_number() OVER (PARTITION BY school, year ORDER BY control, unit_id) AS rn
    FROM evaluated) WHERE rn = 1""", "evaluated"))
def _(s: Star):
    e = s.evaluated.select("school", "year", "unit_id", "control")
    return A.dedupe(e, ["school", "year"], ["control", "unit_id"])


@query("w2_peer_adjust", sql(f"""
    SELECT c_custkey, {R('median(c_acctbal) OVER (PARTITION BY c_nationkey)')} AS peer_median,
      {R('c_acctbal - median(c_acctbal) OVER (PARTITION BY c_nationkey)')} AS adjusted FROM customer"""))
def _(s: Star):
    return W.peer_adjust(s.t("customer"), "c_acctbal", "c_nationkey").select("c_custkey", "peer_median", "adjusted")


RATES = f"SELECT school, count(*) AS n, {R('avg(CAST(CAST(target AS INTEGER) AS DOUBLE))')} AS rate FROM evaluated GROUP BY 1"


@query("w3_top_k", sql("""
    SELECT * FROM (SELECT *, 'highest' AS side FROM r WHERE n >= 2 ORDER BY rate DESC NULLS LAST, school LIMIT 15)
    UNION ALL SELECT * FROM (SELECT *, 'lowest' AS side FROM r WHERE n >= 2 ORDER BY rate NULLS LAST, school LIMIT 15)""",
    "evaluated", r=RATES))
def _(s: Star):
    return W.both_ends(A.outcome_by(s.evaluated, ["school"], "target"), "rate", 15, "school", 2)


@query("w4_rank_by_abs", """
    SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY abs(c_acctbal) DESC, c_custkey) AS place FROM customer""")
def _(s: Star):
    return W.rank_by_abs(s.t("customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", "place")


@query("w5_distributed_cumsum", """
    SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS position FROM orders""")
def _(s: Star):
    o = s.t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    edges = W.quantile_edges(o, "o_totalprice", rows_per_bucket=1000)
    return W.global_row_number(o, "o_totalprice", ["o_orderkey"], edges, ["o_orderstatus"], True,
                               "position").select("o_orderkey", "position")
