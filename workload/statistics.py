"""Feature roles, audits, splits, encoders and descriptive statistics (F, Q, V, E, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import aggregates as A
from cohortlens.operators import audits as Q
from cohortlens.operators import encoders as E
from cohortlens.operators import explore as X
from cohortlens.operators import roles as RO
from cohortlens.operators import splits as V
from workload.registry import H, R, Star, query, sql

Y = "CAST(CAST(target AS INTEGER) AS DOUBLE)"


# --- the flagship -----------------------------------------------------------------------------

@query("flagship_lagged_outcome", sql(f"""
    SELECT unit_id, {R('g.rate')} AS lag_rate, {R('g.rate - p.rate')} AS lag_gap_to_parent FROM evaluated e
    LEFT JOIN (SELECT year, grp, avg({Y}) AS rate FROM evaluated GROUP BY 1, 2) g ON g.year = e.year - 1 AND g.grp = e.grp
    LEFT JOIN (SELECT year, parent, avg({Y}) AS rate FROM evaluated GROUP BY 1, 2) p ON p.year = e.year - 1 AND p.parent = e.parent""",
    "evaluated"))
def _(s: Star):
    from cohortlens.operators.joins import lag_join
    e = s.evaluated.withColumn("one", F.lit(1)).withColumn("hit", F.col("target").cast("int"))
    ctx = (A.parent_deviation(e, ["year"], "grp", "parent", "hit", "one")
           .select("year", "grp", F.col("child_mean").alias("lag_rate"), F.col("deviation").alias("lag_gap_to_parent")))
    return lag_join(e.select("unit_id", "year", "grp"), ctx, ["grp"]).drop("year", "grp")


# --- roles ------------------------------------------------------------------------------------

@query("f2_select_features", sql("""
    SELECT grp, parent, segment, school, control, source, round(wealth, 6) AS wealth FROM units""", "units"))
def _(s: Star):
    u = s.units
    cols = RO.select_features(u.columns, target="target", identifiers=["unit_id", "year"],
                              leaked=["present", "completed", "score"], artefacts=["weight"])
    return u.select(*cols)


@query("f3_degenerate", sql("""
    SELECT 'wealth' AS feature, count(wealth) AS n_non_null, CASE WHEN count(wealth) = 0 THEN 'all missing in train'
      WHEN min(wealth) = max(wealth) THEN 'constant in train' END AS reason FROM units WHERE year = 1999
    UNION ALL SELECT 'year', count(year), CASE WHEN min(year) = max(year) THEN 'constant in train' END FROM units WHERE year = 1999
    UNION ALL SELECT 'late_score', 0, 'all missing in train'
    UNION ALL SELECT 'segment', count(segment), CASE WHEN min(segment) = max(segment) THEN 'constant in train' END FROM units WHERE year = 1999""",
    "units"))
def _(s: Star):
    train = s.units.withColumn("late_score", F.when(F.col("year") > 1999, F.col("score"))).where(F.col("year") == 1999)
    return RO.degenerate_report(train, ["wealth", "year", "late_score", "segment"])


@query("f4_classify_columns", sql("""
    SELECT 'segment' AS feature, CASE WHEN count(DISTINCT segment) > 15 THEN 'high' ELSE 'low' END AS class FROM units
    UNION ALL SELECT 'control', CASE WHEN count(DISTINCT control) > 15 THEN 'high' ELSE 'low' END FROM units
    UNION ALL SELECT 'part', CASE WHEN count(DISTINCT p_name) > 15 THEN 'high' ELSE 'low' END FROM part
    UNION ALL SELECT 'wealth', 'numeric' UNION ALL SELECT 'present', 'numeric'""", "units"))
def _(s: Star):
    a = RO.classify_columns(s.units, ["segment", "control", "wealth", "present"])
    b = RO.classify_columns(s.t("part").select(F.col("p_name").alias("part")))
    rows = [(c, k) for kinds in (a, b) for k, cols in kinds.items() for c in cols]
    return s.spark.createDataFrame(rows, "feature string, class string")


def _summary_sql(c: str, dtype: str, treatment: str) -> str:
    return (f"SELECT '{c}' AS feature, '{dtype}' AS dtype, count(DISTINCT {c}) AS n_distinct, "
            f"{R(f'100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*)')} AS pct_missing, '{treatment}' AS treatment FROM units")


@query("f5_preprocessing_summary", sql(" UNION ALL ".join([
    _summary_sql("wealth", "double", RO.TREATMENT["numeric"]), _summary_sql("segment", "string", RO.TREATMENT["low"]),
    _summary_sql("school_key", "string", RO.TREATMENT["high"]).replace("FROM units", "FROM (SELECT CAST(school AS VARCHAR) AS school_key FROM units)"),
    _summary_sql("present", "boolean", RO.TREATMENT["numeric"])]), "units"))
def _(s: Star):
    u = s.units.withColumn("school_key", F.col("school").cast("string"))
    return RO.preprocessing_summary(u, ["wealth", "segment", "school_key", "present"])


# --- audits -----------------------------------------------------------------------------------

@query("q1_deterministic_label", sql(f"""
    SELECT present, completed, count(*) AS n, {R(f'avg({Y})')} AS rate,
      coalesce(min(CAST(target AS INTEGER)) = max(CAST(target AS INTEGER)), false) AS deterministic FROM units GROUP BY 1, 2""", "units"))
def _(s: Star):
    return Q.deterministic_label_audit(s.units, ["present", "completed"], "target")


@query("q2_label_identity", sql("""
    SELECT count(*) FILTER (WHERE (score >= 200000) = target) AS agree, count(*) FILTER (WHERE (score >= 200000) <> target) AS disagree
    FROM units WHERE present AND completed""", "units"))
def _(s: Star):
    return Q.label_identity_audit(s.units.where(F.col("present") & F.col("completed")), "score", 200_000.0, "target")


def _corr(x: str, y: str) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    return R(f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) FILTER (WHERE {both}) * stddev_pop({y}) FILTER (WHERE {both}), 0)")


GROUP_YEAR = f"""SELECT year, grp, avg({Y}) AS rate, avg(CAST(weight AS DOUBLE)) AS w, count(*)::DOUBLE AS size FROM evaluated GROUP BY 1, 2"""


@query("q3_leak_correlation", sql(f"""
    SELECT year, feature, {_corr('v', 'rate')} AS r_same_year, {_corr('v', 'next_rate')} AS r_next_year,
      count(*) FILTER (WHERE v = nv) AS n_repeated, count(nv) AS n_compared FROM (
      SELECT a.year, 'w' AS feature, a.w AS v, b.w AS nv, a.rate, b.rate AS next_rate FROM g a LEFT JOIN g b ON b.grp = a.grp AND b.year = a.year + 1
      UNION ALL SELECT a.year, 'size', a.size, b.size, a.rate, b.rate FROM g a LEFT JOIN g b ON b.grp = a.grp AND b.year = a.year + 1) GROUP BY 1, 2""",
    "evaluated", g=GROUP_YEAR))
def _(s: Star):
    ctx = s.evaluated.groupBy("year", "grp").agg(
        F.avg(F.col("target").cast("int").cast("double")).alias("rate"), F.avg("weight").alias("w"),
        F.count(F.lit(1)).cast("double").alias("size"))
    return Q.leak_correlation_audit(ctx, ["w", "size"], ["grp"], "year", "rate")


@query("q4_key_overlap", """
    SELECT count(*) FILTER (WHERE s_suppkey IS NOT NULL) AS matched, count(*) FILTER (WHERE s_suppkey IS NULL) AS unmatched
    FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN supplier ON s_suppkey = o_custkey""")
def _(s: Star):
    return Q.key_overlap_audit(s.t("orders"), s.t("supplier"), "o_custkey", "s_suppkey")


@query("q5_key_stability", sql(f"""
    SELECT count(*) AS n_both, count(*) FILTER (WHERE c0 = c1) AS same_control, count(*) FILTER (WHERE g0 = g1) AS same_grp,
      {R('count(*) FILTER (WHERE c0 = c1) / nullif(count(*), 0)')} AS share_control, {R('count(*) FILTER (WHERE g0 = g1) / nullif(count(*), 0)')} AS share_grp
    FROM (SELECT school, min(control) FILTER (WHERE year = 1999) AS c0, min(control) FILTER (WHERE year = 2000) AS c1,
      min(grp) FILTER (WHERE year = 1999) AS g0, min(grp) FILTER (WHERE year = 2000) AS g1 FROM units WHERE year IN (1999, 2000) GROUP BY 1)
    WHERE g0 IS NOT NULL AND g1 IS NOT NULL""", "units"))
def _(s: Star):
    return Q.key_stability_audit(s.units, "school", ["control", "grp"], "year", 1999, 2000)


@query("q6_coverage_matrix", sql(f"""
    SELECT u.year, count(*) AS n, {R('100.0 * count(l.n) / count(*)')} AS history, {R('100.0 * count(u.wealth) / count(*)')} AS wealth
    FROM units u LEFT JOIN (SELECT year, school, count(*) AS n FROM units GROUP BY 1, 2) l ON l.year = u.year - 1 AND l.school = u.school GROUP BY 1""", "units"))
def _(s: Star):
    from cohortlens.operators.joins import lag_join
    history = s.units.groupBy("year", "school").agg(F.count(F.lit(1)).alias("n_before"))
    return Q.coverage_matrix(lag_join(s.units, history, ["school"]), "year", {"history": "n_before", "wealth": "wealth"})


@query("q7_level_drift", sql(f"""
    SELECT parent, CAST(sum(n0) AS BIGINT) AS n_before, CAST(sum(n1) AS BIGINT) AS n_after, {R('sum(p0) / nullif(sum(n0), 0)')} AS rate_before,
      {R('sum(p1) / nullif(sum(n1), 0)')} AS rate_after, {R('100 * (sum(p1) / nullif(sum(n1), 0) - sum(p0) / nullif(sum(n0), 0))')} AS change_pp,
      count(*) FILTER (WHERE n0 = 0 AND n1 > 0) AS groups_only_after, count(*) FILTER (WHERE n0 > 0 AND n1 = 0) AS groups_only_before,
      CAST(coalesce(sum(n1) FILTER (WHERE n0 = 0), 0) AS BIGINT) AS rows_in_new_groups FROM (
      SELECT parent, school, count(*) FILTER (WHERE year = 1999) AS n0, count(*) FILTER (WHERE year = 2000) AS n1,
        CAST(count(*) FILTER (WHERE year = 1999 AND target) AS DOUBLE) AS p0, CAST(count(*) FILTER (WHERE year = 2000 AND target) AS DOUBLE) AS p1
      FROM evaluated WHERE year IN (1999, 2000) GROUP BY 1, 2) GROUP BY 1""", "evaluated"))
def _(s: Star):
    return Q.level_drift(s.evaluated, "parent", "school", "year", 1999, 2000, "target")


@query("q8_weight_shift", sql(f"""
    SELECT year, count(DISTINCT weight) AS n_distinct, min(weight) AS lowest, max(weight) AS highest,
      {R(f'covar_pop(weight, {Y}) / nullif(stddev_pop(weight) * stddev_pop({Y}), 0)')} AS r_target FROM evaluated GROUP BY 1""", "evaluated"))
def _(s: Star):
    return Q.weight_shift_audit(s.evaluated, "weight", "year", "target")


@query("q9_negative_control", sql(f"""
    SELECT count(*) AS n_levels, {R('max(r) - min(r)')} AS range, {R('stddev_pop(r)')} AS spread FROM (
      SELECT control, avg({Y}) AS r FROM evaluated GROUP BY 1)""", "evaluated"))
def _(s: Star):
    return Q.negative_control(s.evaluated, "control", "target")


@query("q10_participation_rate", sql(f"""
    SELECT year, parent, count(*) AS n, {R('avg(CAST(CAST(present AS INTEGER) AS DOUBLE))')} AS participation FROM units GROUP BY 1, 2""", "units"))
def _(s: Star):
    return Q.participation_rate(s.units, ["year", "parent"], "present")


# --- splits -----------------------------------------------------------------------------------

@query("v1_temporal_split", sql("""
    SELECT CASE year WHEN 1999 THEN 'train' ELSE 'test' END AS side, unit_id FROM evaluated WHERE year IN (1999, 2000)""", "evaluated"))
def _(s: Star):
    train, test = V.temporal_split(s.evaluated, "year", 1999, 2000)
    return (train.select(F.lit("train").alias("side"), "unit_id")
            .unionByName(test.select(F.lit("test").alias("side"), "unit_id")))


@query("v2_group_split", sql(f"""
    SELECT u.unit_id, u.school, k.held AS held_out FROM evaluated u JOIN (
      SELECT school, row_number() OVER (ORDER BY {H('42', 'school')}, school) <= ceil(0.25 * count(*) OVER ()) AS held
      FROM (SELECT DISTINCT school FROM evaluated)) k USING (school)""", "evaluated"))
def _(s: Star):
    train, test = V.group_split(s.evaluated, "school")
    V.assert_disjoint(train, test, "school")
    return (train.select("unit_id", "school", F.lit(False).alias("held_out"))
            .unionByName(test.select("unit_id", "school", F.lit(True).alias("held_out"))))


@query("v3_grouped_folds", sql(f"""
    SELECT school, n, CAST(CASE WHEN (pos - 1) % 10 < 5 THEN (pos - 1) % 10 ELSE 9 - (pos - 1) % 10 END AS INTEGER) AS fold FROM (
      SELECT school, n, row_number() OVER (ORDER BY rate, {H('42', 'school')}, school) AS pos FROM (
        SELECT school, count(*) AS n, coalesce(avg({Y}), -1) AS rate FROM units GROUP BY 1))""", "units"))
def _(s: Star):
    return V.fold_table(s.units, "school", "target", 5)


@query("v3_balanced_folds")
def v3_balanced(s: Star):
    return V.balanced_fold_table(s.units, "school", "target", 5)


@query("v4_stratified_sample", sql(f"""
    SELECT unit_id, target FROM (SELECT unit_id, target, row_number() OVER (PARTITION BY target ORDER BY {H('42', 'unit_id')}, unit_id) AS rn,
      round(1001.0 * count(*) OVER (PARTITION BY target) / count(*) OVER ()) AS quota FROM evaluated) WHERE rn <= quota""", "evaluated"))
def _(s: Star):
    return V.stratified_sample(s.evaluated, "target", 1001, "unit_id").select("unit_id", "target")


@query("v5_cap_sample", sql(f"""
    SELECT unit_id FROM (SELECT unit_id, row_number() OVER (ORDER BY {H('7', 'unit_id')}, unit_id) AS rn FROM evaluated) WHERE rn <= 1500""", "evaluated"))
def _(s: Star):
    return V.cap_sample(s.evaluated, 1500, "unit_id", 7).select("unit_id")


# --- encoders: learnt on 1999, applied to 2000 --------------------------------------------------

def _two_years(s: Star):
    e = s.evaluated.withColumn("y", F.col("target").cast("int"))
    return e.where(F.col("year") == 1999), e.where(F.col("year") == 2000)


@query("e1_median_imputer", sql(f"""
    SELECT unit_id, {R('coalesce(wealth, (SELECT median(wealth) FROM evaluated WHERE year = 1999))')} AS f__wealth,
      CAST(wealth IS NULL AS DOUBLE) AS f__missingindicator_wealth, CAST(weight AS DOUBLE) AS f__weight FROM evaluated WHERE year = 2000""", "evaluated"))
def _(s: Star):
    train, test = _two_years(s)
    model = E.MedianImputer(columns=["wealth", "weight"]).fit(train)
    return model.transform(test).select("unit_id", "f__wealth", "f__missingindicator_wealth", "f__weight")


MODE = """(SELECT {c} FROM (SELECT {c}, count(*) AS n FROM gappy WHERE {c} IS NOT NULL AND year = 1999 GROUP BY 1) ORDER BY n DESC, {c} LIMIT 1)"""
GAPPY = "SELECT unit_id, year, CASE WHEN wealth >= 1000 THEN segment END AS segment, CASE WHEN wealth >= 2000 THEN control END AS control FROM evaluated"


def _gappy(s: Star):
    train, test = _two_years(s)
    cols = ["unit_id", F.when(F.col("wealth") >= 1000, F.col("segment")).alias("segment"),
            F.when(F.col("wealth") >= 2000, F.col("control")).alias("control")]
    return train.select(*cols), test.select(*cols)


@query("e2_mode_imputer", sql(f"""
    SELECT unit_id, coalesce(segment, {MODE.format(c='segment')}) AS segment, coalesce(control, {MODE.format(c='control')}) AS control
    FROM gappy WHERE year = 2000""", "evaluated", gappy=GAPPY))
def _(s: Star):
    train, test = _gappy(s)
    out = E.ModeImputer(columns=["segment", "control"]).fit(train).transform(test)
    return out.select("unit_id", F.col("_c_segment").alias("segment"), F.col("_c_control").alias("control"))


@query("e3_constant_imputer", sql("""
    SELECT unit_id, coalesce(segment, '__missing__') AS segment FROM gappy WHERE year = 2000""", "evaluated", gappy=GAPPY))
def _(s: Star):
    out = E.ConstantImputer(columns=["segment"]).transform(_gappy(s)[1])
    return out.select("unit_id", F.col("_c_segment").alias("segment"))


@query("e4_standard_scale", sql(f"""
    SELECT unit_id, {R('(coalesce(wealth, med) - (SELECT avg(coalesce(wealth, med)) FROM a WHERE year = 1999)) / (SELECT stddev_pop(coalesce(wealth, med)) FROM a WHERE year = 1999)')} AS f__wealth,
      {R('(CAST(wealth IS NULL AS INTEGER) - (SELECT avg(CAST(wealth IS NULL AS INTEGER)) FROM a WHERE year = 1999)) / (SELECT stddev_pop(CAST(wealth IS NULL AS INTEGER)) FROM a WHERE year = 1999)')} AS f__missingindicator_wealth
    FROM a WHERE year = 2000""", "evaluated",
    a="SELECT *, (SELECT median(wealth) FROM evaluated WHERE year = 1999) AS med FROM evaluated"))
def _(s: Star):
    train, test = _two_years(s)
    fill = E.MedianImputer(columns=["wealth"]).fit(train)
    scale = E.StandardScale().fit(fill.transform(train))
    return scale.transform(fill.transform(test)).select("unit_id", "f__wealth", "f__missingindicator_wealth")


@query("e5_infrequent_one_hot", sql("""
    SELECT unit_id, CAST(label = 'BUILDING' AS DOUBLE) AS f__label_BUILDING, CAST(label = 'MACHINERY' AS DOUBLE) AS f__label_MACHINERY,
      CAST(label NOT IN (SELECT label FROM (SELECT label, count(*) AS n FROM l WHERE year = 1999 GROUP BY 1)
        WHERE n >= 0.1 * (SELECT count(*) FROM l WHERE year = 1999)) AS DOUBLE) AS f__label_infrequent
    FROM l WHERE year = 2000""", "evaluated",
    l="SELECT unit_id, year, CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN segment ELSE segment || control || parent END AS label FROM evaluated"))
def _(s: Star):
    label = F.when(F.col("segment").isin("BUILDING", "MACHINERY"), F.col("segment")).otherwise(
        F.concat("segment", "control", F.col("parent").cast("string"))).alias("label")
    train, test = _two_years(s)
    model = E.InfrequentOneHot(columns=["label"], min_freq=0.1).fit(train.select("unit_id", label))
    return model.transform(test.select("unit_id", label)).select(
        "unit_id", "f__label_BUILDING", "f__label_MACHINERY", "f__label_infrequent")


ENCODE = """CASE WHEN V = 0 OR n IS NULL OR n = 0 THEN m ELSE
   (V * n / (V * n + (pos / n) * (1 - pos / n))) * (pos / n) + (1 - V * n / (V * n + (pos / n) * (1 - pos / n))) * m END"""
FOLD = f"{H('42', 'unit_id')} % 5"


@query("e6_target_encoder_train", sql(f"""
    SELECT unit_id, {R(ENCODE)} AS f__school FROM (
      SELECT t.unit_id, CAST(c.n - o.n AS DOUBLE) AS n, CAST(c.pos - o.pos AS DOUBLE) AS pos, g.m, g.m * (1 - g.m) AS V FROM tr t
      JOIN (SELECT school, count(*) AS n, sum(y) AS pos FROM tr GROUP BY 1) c USING (school)
      JOIN (SELECT school, fold, count(*) AS n, sum(y) AS pos FROM tr GROUP BY 1, 2) o ON o.school = t.school AND o.fold = t.fold
      JOIN (SELECT f.fold, CAST(sum(tr.y) AS DOUBLE) / count(*) AS m FROM (SELECT DISTINCT fold FROM tr) f JOIN tr ON tr.fold <> f.fold GROUP BY 1) g ON g.fold = t.fold)""",
    "evaluated", tr=f"SELECT unit_id, school, CAST(target AS INTEGER) AS y, {FOLD} AS fold FROM evaluated WHERE year = 1999"))
def _(s: Star):
    train, _ = _two_years(s)
    model = E.CrossFitTargetEncoder(columns=["school"], target="y", row_key="unit_id").fit(train)
    return model.transform_training(train).select("unit_id", "f__school")


@query("e6_target_encoder_new", sql(f"""
    SELECT unit_id, {R(ENCODE)} AS f__school FROM (
      SELECT t.unit_id, c.n, c.pos, g.m, g.m * (1 - g.m) AS V FROM evaluated t
      LEFT JOIN (SELECT school, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS pos FROM tr GROUP BY 1) c USING (school)
      CROSS JOIN (SELECT avg(CAST(y AS DOUBLE)) AS m FROM tr) g WHERE t.year = 2000)""",
    "evaluated", tr="SELECT unit_id, school, CAST(target AS INTEGER) AS y FROM evaluated WHERE year = 1999"))
def _(s: Star):
    train, test = _two_years(s)
    model = E.CrossFitTargetEncoder(columns=["school"], target="y", row_key="unit_id").fit(train)
    return model.transform(test).select("unit_id", "f__school")


# --- descriptive ------------------------------------------------------------------------------

@query("a15_dispersion", sql(f"""
    SELECT year, count(*) AS n_units, {', '.join(f"{R(f'quantile_cont(pct, {q})')} AS {n}" for n, q in X.DISPERSION.items())}
    FROM (SELECT year, school, 100 * avg({Y}) AS pct FROM evaluated GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1""", "evaluated"))
def _(s: Star):
    return X.dispersion(s.evaluated, "school", "year", "target", 2)


GROUPS = f"""SELECT grp, segment, avg({Y}) AS rate, avg(wealth) AS wealth, avg(CAST(weight AS DOUBLE)) AS weight, count(*)::DOUBLE AS size,
   avg(CAST(year AS DOUBLE)) AS mean_year, min(parent)::DOUBLE AS parent FROM evaluated GROUP BY 1, 2"""


def _groups(s: Star):
    return s.evaluated.groupBy("grp", "segment").agg(
        F.avg(F.col("target").cast("int").cast("double")).alias("rate"), F.avg("wealth").alias("wealth"),
        F.avg("weight").alias("weight"), F.count(F.lit(1)).cast("double").alias("size"),
        F.avg("year").alias("mean_year"), F.min("parent").cast("double").alias("parent"))


@query("x1_feature_target_correlation", sql("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {_corr(c, 'rate')} AS r, count({c}) AS n FROM g" for c in ["wealth", "weight", "size", "mean_year"]) + ") WHERE n >= 100",
    "evaluated", g=GROUPS))
def _(s: Star):
    return X.feature_target_correlation(_groups(s), ["wealth", "weight", "size", "mean_year"], "rate", p_values=False)


# Two-sided p of r over n pairs, v = n - 2 degrees of freedom, as 1 less the finite series in cos^2 = 1 - r^2, one for even and one for odd v.
_ODD = "exp(0.5 * ln(pi()) - ln(2) + lgamma(k + 1) - lgamma(k + 1.5)) * power(1 - r * r, k + 0.5)"
_EVEN = "exp(lgamma(k + 0.5) - 0.5 * ln(pi()) - lgamma(k + 1)) * power(1 - r * r, k)"
_P_VALUE = f"""1 - CASE WHEN (n - 2) % 2 = 0 THEN abs(r) * list_sum(list_transform(range((n - 2) // 2), lambda k: {_EVEN}))
    ELSE 2 / pi() * (asin(abs(r)) + abs(r) * list_sum(list_transform(range((n - 3) // 2), lambda k: {_ODD}))) END"""


@query("x1_correlation_p_values", sql(f"SELECT feature, {R('r')} AS r, n, {R(_P_VALUE)} AS p_value FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, rate) AS r, count({c}) AS n FROM g" for c in ["wealth", "weight", "size", "mean_year"]) + ") WHERE n >= 100",
    "evaluated", g=GROUPS))
def _(s: Star):
    return X.feature_target_correlation(_groups(s), ["wealth", "weight", "size", "mean_year"], "rate")


@query("x2_persistence", sql(f"""
    SELECT {_corr('r0', 'r1')} AS r, count(*) AS n_units FROM (
      SELECT school, avg({Y}) FILTER (WHERE year = 1999) AS r0, avg({Y}) FILTER (WHERE year = 2000) AS r1,
        count(*) FILTER (WHERE year = 1999) AS n0, count(*) FILTER (WHERE year = 2000) AS n1 FROM evaluated GROUP BY 1) WHERE n0 >= 2 AND n1 >= 2""", "evaluated"))
def _(s: Star):
    return X.persistence(s.evaluated, "school", "year", 1999, 2000, "target", 2)


def _decile(c: str) -> str:
    inner = ", ".join(f"quantile_cont({c}, {i / 10})" for i in range(11))
    return f"""SELECT '{c}' AS feature, bin, n, rate, max(rate) OVER () - min(rate) OVER () AS amplitude FROM (
        SELECT CAST(len(list_filter(cuts, lambda e: e < {c})) AS INTEGER) AS bin, count(*) AS n, avg({Y}) AS rate FROM evaluated,
          (SELECT list_sort(list_distinct([{inner}]))[2:-2] AS cuts FROM evaluated) WHERE {c} IS NOT NULL GROUP BY 1)"""


@query("x3_decile_profile", sql(f"""
    SELECT feature, bin, n, {R('rate')} AS rate, {R('amplitude')} AS amplitude FROM ({_decile('wealth')} UNION ALL {_decile('school')})
    WHERE (SELECT count(wealth) FROM evaluated) >= 1000""", "evaluated"))
def _(s: Star):
    return X.decile_profile(s.evaluated, ["wealth", "school", "weight"], "target", min_rows=1000)


@query("x4_correlation_within", sql(f"SELECT segment, {_corr('wealth', 'rate')} AS r, count(*) AS n FROM g GROUP BY 1", "evaluated", g=GROUPS))
def _(s: Star):
    return X.correlation_within(_groups(s), "wealth", "rate", "segment")


@query("x4_partial_correlation", sql(f"""
    SELECT {R('xy')} AS r, {R('(xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))')} AS r_partial, n FROM (
      SELECT corr(wealth, rate) AS xy, corr(wealth, size) AS xz, corr(rate, size) AS yz, count(*) AS n FROM g)""", "evaluated", g=GROUPS))
def _(s: Star):
    return X.partial_correlation(_groups(s), "wealth", "rate", "size")


@query("x5_map_points", sql(f"""
    SELECT grp, {R('wealth')} AS lat, {R('weight')} AS lon, {R('100 * rate')} AS rate_pct FROM (
      SELECT year, grp, avg({Y}) AS rate, avg(wealth) AS wealth, avg(CAST(weight AS DOUBLE)) AS weight FROM evaluated GROUP BY 1, 2)
    WHERE year = (SELECT max(year) FROM evaluated) AND wealth IS NOT NULL""", "evaluated"))
def _(s: Star):
    g = s.evaluated.groupBy("year", "grp").agg(
        F.avg(F.col("target").cast("int").cast("double")).alias("rate"), F.avg("wealth").alias("lat"), F.avg("weight").alias("lon"))
    return X.map_points(g, "year", "lat", "lon", "rate", ["grp"])
