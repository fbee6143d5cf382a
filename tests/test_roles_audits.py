from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import audits as Q
from cohortlens.operators import roles as R
from conftest import rows

COLUMNS = ["ano", "id_aluno", "id_escola", "id_municipio", "sigla_uf", "nome_municipio", R.TARGET, "proficiencia",
           "presenca", "preenchimento_caderno", "alu_caderno", "alu_rede", "mun_lag_taxa_observada", "uf_lag_taxa",
           "ter_latitude", "inf_pct_biblioteca_leitura", "ses_ivs", "edu_ideb_ai_publica"]


def test_leaked_columns_identifiers_and_target_are_never_features():
    got = R.select_features(COLUMNS + ["alu_peso_amostral"])
    assert not set(got) & {*R.LEAKED, *R.IDENTIFIERS, *R.SAMPLING_ARTEFACTS, R.TARGET}
    assert "mun_lag_taxa_observada" in got and "id_municipio" in got


def test_temporal_design_has_no_history():
    got = R.select_features(COLUMNS, allow_lagged=False)
    assert not [c for c in got if c.startswith(R.LAGGED_PREFIXES)]


def test_ablated_blocks_go_by_prefix():
    assert R.select_features(COLUMNS, exclude_blocks=("inf_", "ses_"))[-1] == "edu_ideb_ai_publica"


@pytest.mark.parametrize("col,block", [
    ("inf_pct_quadra", "school (infrastructure)"), ("missingindicator_ses_ivs", "municipality (socioeconomic) (absence)"),
    ("alu_rede_Municipal", "student"), ("id_municipio", "geographic identity"), ("sigla_uf_SP", "geographic identity"),
    ("mun_lag_taxa", "municipality (education)"), ("whatever", "others")])
def test_blocks_from_names(col, block):
    assert R.block_of(col) == block


def test_blocks_keep_order():
    assert list(R.blocks(["ses_a", "inf_b", "ses_c"])) == [R.BLOCKS["ses_"], R.BLOCKS["inf_"]]


def test_degenerate_columns_are_dropped_with_a_reason(spark):
    df = spark.createDataFrame([(1.0, None, 7.0, "a"), (2.0, None, 7.0, None), (3.0, None, None, "b")],
                               "good double, empty double, constant double, text string")
    kept, dropped = R.drop_degenerate(df, df.columns)
    assert kept == ["good", "text"] and "missing" in dropped["empty"] and "constant" in dropped["constant"]


def test_column_classes(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), (F.col("id") > 3).alias("flag"),
                                 F.concat(F.lit("l"), F.col("id") % 3).alias("few"), F.col("id").cast("string").alias("many"),
                                 F.lit("m").alias("id_municipio"))
    assert R.classify_columns(df) == {"numeric": ["x", "flag"], "low": ["few"], "high": ["many", "id_municipio"]}
    summary = {r["feature"]: r for r in R.preprocessing_summary(df).collect()}
    assert summary["few"]["n_distinct"] == 3 and summary["many"]["treatment"] == R.TREATMENT["high"]


def test_rejected_columns_cannot_come_back(spark):
    df = spark.createDataFrame([(1, 2)], "ano int, esc_lag_taxa int")
    with pytest.raises(ValueError, match="esc_lag_taxa"):
        R.forbid_columns(df)


def test_unstable_key_is_refused(spark):
    df = spark.createDataFrame([("s1", "a", 1), ("s1", "b", 2), ("s2", "a", 1), ("s2", "a", 2), ("s3", "c", 1)], "s string, g string, y int")
    got = rows(Q.key_stability_audit(df, "s", ["g"], "y", 1, 2))[0]
    assert (got["n_both"], got["same_g"], got["share_g"]) == (2, 1, 0.5)
    with pytest.raises(ValueError):
        Q.require_stable_key(df, "s", "g", "y", 1, 2)
    assert Q.require_stable_key(df, "s", "g", "y", 1, 2, minimum=0.5) == 0.5


def test_label_audits(spark):
    df = spark.createDataFrame([(True, 800.0, True), (True, 700.0, False), (True, 743.0, False), (False, None, False)],
                               "present boolean, score double, t boolean")
    assert rows(Q.label_identity_audit(df, "score", 743.0, "t"))[0] == {"agree": 2, "disagree": 1}
    flags = {r["present"]: r for r in rows(Q.deterministic_label_audit(df, ["present"], "t"))}
    assert flags[False]["deterministic"] and not flags[True]["deterministic"]


def test_key_overlap(spark):
    a = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "k string")
    b = spark.createDataFrame([("2",), ("9",)], "j string")
    assert rows(Q.key_overlap_audit(a, b, "k", "j"))[0] == {"matched": 1, "unmatched": 1}


def test_drift_counts_groups_of_one_year(spark):
    df = spark.createDataFrame([("P", "a", 1, True), ("P", "a", 2, False), ("P", "b", 2, True), ("Q", "c", 1, True)],
                               "p string, g string, y int, t boolean")
    got = {r["p"]: r for r in rows(Q.level_drift(df, "p", "g", "y", 1, 2, "t"))}
    assert got["P"]["change_pp"] == -50.0 and got["P"]["groups_only_after"] == 1 and got["P"]["rows_in_new_groups"] == 1
    assert got["Q"]["rate_after"] is None and got["Q"]["groups_only_before"] == 1


def test_leak_audit_tells_the_years_apart(spark):
    data = [(y, f"g{i}", float((i * 7 + y) % 11), float((i * 5 + y * y) % 13)) for y in (1, 2) for i in range(40)]
    df = spark.createDataFrame(data, "y int, g string, rate double, other double").withColumn("copy", F.col("rate") * 2)
    got = {(r["feature"], r["y"]): r for r in rows(Q.leak_correlation_audit(df, ["copy", "other"], ["g"], "y", "rate"))}
    assert got["copy", 1]["r_same_year"] == pytest.approx(1.0) and abs(got["copy", 1]["r_next_year"]) < 0.99
    assert got["copy", 2]["n_compared"] == 0
