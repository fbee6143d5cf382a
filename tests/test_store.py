from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortlens.plans import base_table  # noqa: F401
from cohortlens.plans.registry import BUILDERS, Store, StoreConfig, materialize
from cohortlens.sources import storage as S
from cohortlens.sources.catalog import Catalog
from cohortlens.sources.schemas import SCHEMAS
from conftest import rows

# A few literal rows per source; columns that are not named are NULL.
DATA = {
    "silver.alunos": [
        *[dict(ano=2023, id_aluno=f"a{i}", id_escola="s1", id_municipio="10", sigla_uf="X", caderno="1", rede="Municipal", peso_aluno=1.0,
               alfabetizado=i < 3, presenca=True, preenchimento_caderno=True, proficiencia=750.0, fonte="batch") for i in range(4)],
        dict(ano=2024, id_aluno="b1", id_escola="s2", id_municipio="10", sigla_uf="X", rede="Municipal", alfabetizado=True, presenca=True, preenchimento_caderno=True, fonte="batch"),
        dict(ano=2024, id_aluno="b2", id_escola="s2", id_municipio="99", sigla_uf="Y", rede="Estadual", alfabetizado=False, presenca=True, preenchimento_caderno=True, fonte="batch"),
        dict(ano=2024, id_aluno="out1", id_municipio="10", alfabetizado=False, presenca=False, preenchimento_caderno=True, fonte="batch"),
        dict(ano=2024, id_aluno="out2", id_municipio="10", alfabetizado=True, presenca=True, preenchimento_caderno=True, fonte="stream"),
        dict(ano=2024, id_aluno="out3", id_municipio="10", presenca=True, preenchimento_caderno=True, fonte="batch")],
    "silver.indicador_municipio": [dict(ano=2023, id_municipio="10", serie=2, rede="Municipal", taxa_alfabetizacao=70.0, media_portugues=5.0),
                                   dict(ano=2023, id_municipio="10", serie=2, rede="Municipal", taxa_alfabetizacao=60.0, media_portugues=4.0),
                                   dict(ano=2023, id_municipio="10", serie=5, rede="Municipal", taxa_alfabetizacao=1.0)],
    "silver.metas_municipio": [dict(ano=2023, id_municipio="10", meta_alfabetizacao_2024=65.0, meta_alfabetizacao_2025=66.0, nivel_alfabetizacao=2.0)],
    "silver.dim_municipio": [dict(id_municipio="10", nome_municipio="Ten", sigla_uf="X", nome_regiao="R", latitude=1.0, capital_uf=True),
                             dict(id_municipio="20", nome_municipio="Twenty", sigla_uf="X", nome_regiao="R")],
    "gold.panorama_uf": [dict(ano=2023, sigla_uf="X", rede="Pública (Estadual e Municipal)", taxa=50.0, ranking_taxa=3),
                         dict(ano=2023, sigla_uf="X", rede="Privada", taxa=99.0)],
    "censo_escolar.escola": [
        dict(ano=2023, id_municipio="10", rede="3", tipo_situacao_funcionamento="1", etapa_ensino_fundamental_anos_iniciais=1, quantidade_matricula_fundamental_anos_iniciais=80,
             quantidade_turma_fundamental_anos_iniciais=4, quantidade_tablet_aluno=8, tipo_localizacao="1", agua_potavel=1, biblioteca_sala_leitura=None),
        dict(ano=2023, id_municipio="10", rede="3", tipo_situacao_funcionamento="1", etapa_ensino_fundamental_anos_iniciais=1, quantidade_matricula_fundamental_anos_iniciais=20,
             tipo_localizacao="2", agua_potavel=0, biblioteca_sala_leitura=1),
        dict(ano=2023, id_municipio="10", rede="9", tipo_situacao_funcionamento="1", etapa_ensino_fundamental_anos_iniciais=1, quantidade_matricula_fundamental_anos_iniciais=5),
        dict(ano=2023, id_municipio="10", rede="3", tipo_situacao_funcionamento="2", etapa_ensino_fundamental_anos_iniciais=1, quantidade_matricula_fundamental_anos_iniciais=999)],
    "indicadores_edu.municipio": [
        dict(ano=2023, id_municipio="10", localizacao="Total", rede="Municipal", tdi_ef_anos_iniciais=9.0, taxa_aprovacao_ef_anos_iniciais=99.0),
        dict(ano=2022, id_municipio="10", localizacao="total", rede="municipal", taxa_aprovacao_ef_anos_iniciais=91.0),
        dict(ano=2023, id_municipio="10", localizacao="Total", rede="Total", dsu_ef_anos_iniciais=77.0),
        dict(ano=2023, id_municipio="10", localizacao="Rural", rede="Total", tdi_ef_anos_iniciais=20.0, atu_ef_anos_iniciais=12.0),
        dict(ano=2023, id_municipio="10", localizacao="Urbana", rede="Total", tdi_ef_anos_iniciais=8.0)],
    "inse.escola": [dict(ano=2021, id_municipio="10", sigla_uf="X", rede="3", inse=4.0, quantidade_alunos_inse=10, percentual_nivel_1=10.0, tipo_localizacao="2"),
                    dict(ano=2021, id_municipio="10", sigla_uf="X", rede="3", inse=6.0, quantidade_alunos_inse=30, percentual_nivel_8=50.0),
                    dict(ano=2021, id_municipio="20", sigla_uf="X", rede="3", inse=8.0, quantidade_alunos_inse=40),
                    dict(ano=2021, id_municipio="20", sigla_uf="X", rede="bad", inse=100.0, quantidade_alunos_inse=40),
                    dict(ano=2021, id_municipio="20", sigla_uf="X", rede="2", inse=100.0, quantidade_alunos_inse=0)],
    "ideb.municipio": [dict(ano=y, id_municipio="10", sigla_uf="X", rede=r, anos_escolares="iniciais (1-5)", ensino="fundamental", ideb=v)
                       for y, r, v in [(2021, "publica", 5.0), (2019, "publica", 4.5), (2021, "municipal", 5.5), (2023, "estadual", 6.0)]],
    "ideb.uf": [dict(ano=2023, sigla_uf="X", rede="publica", anos_escolares="iniciais (1-5)", ensino="fundamental", ideb=5.8)],
    "saeb.municipio": [dict(ano=2021, id_municipio="10", rede="total - estadual e municipal", disciplina="LP", localizacao="total", serie=5, media=200.0, nivel_0=1.0, nivel_1=2.0, nivel_2=3.0,
                            nivel_6=1.0, nivel_7=1.0, nivel_8=1.0, nivel_9=None)],
    "ibge_pib.municipio": [dict(id_municipio="10", ano=2022, pib=1000.0)],
    "ibge_populacao.municipio": [dict(id_municipio="10", ano=2022, populacao=50), dict(id_municipio="10", ano=2023, populacao=100), dict(id_municipio=None, ano=2023, populacao=1)],
    "censo2022.municipio": [dict(id_municipio="10", area=0.0, domicilios=20, populacao=60, populacao_indigena=3, populacao_quilombola=3)],
    "censo2022.populacao_idade": [dict(id_municipio="10", ano=2022, grupo_idade="5 a 9 anos", populacao=10), dict(id_municipio="10", ano=2022, grupo_idade="80 anos", populacao=30),
                                  dict(id_municipio="10", ano=2010, grupo_idade="5 a 9 anos", populacao=999)],
    "censo2022.alfabetizacao_idade": [dict(id_municipio="10", grupo_idade="25 a 34 anos", alfabetizacao="Alfabetizadas", populacao=9), dict(id_municipio="10", grupo_idade="35 a 44 anos", alfabetizacao="Não", populacao=1),
                                      dict(id_municipio="10", grupo_idade="80 anos", alfabetizacao="Não", populacao=90)],
    "censo2022.esgotamento": [dict(id_municipio="10", ano=2022, tipo_esgotamento_sanitario="Vala", populacao=1), dict(id_municipio="10", ano=2022, tipo_esgotamento_sanitario="Outro", populacao=3),
                              dict(id_municipio="10", ano=2022, tipo_esgotamento_sanitario="Rede geral, rede pluvial ou fossa ligada à rede", populacao=96)],
    "censo2022.tipo_domicilio": [],
    "ipea_avs.municipio": [dict(id_municipio="10", ano=2010, raca_cor="total", sexo="total", localizacao="total", ivs=0.3, renda_per_capita=0.0),
                           dict(id_municipio="10", ano=2010, raca_cor="negra", sexo="total", localizacao="total", ivs=0.9),
                           dict(id_municipio="10", ano=2010, raca_cor="total", sexo="total", localizacao="total", nome_udh="centro", ivs=0.1)],
    "onu_adh.municipio": [dict(id_municipio="10", ano=2010, taxa_desocupacao_18_mais=7.0)],
    "mc_indicadores.transferencias_municipio": [dict(id_municipio="10", ano=2020, pessoas_cadastradas_cu=40.0, pessoas_beneficiarias_pbf=10.0, familias_beneficiarias_pbf=0.0, valor_pago_pbf=5.0)],
    "cgu_beneficios.novo_bolsa_familia": [dict(ano_competencia=2023, mes_competencia=6, id_municipio="10", valor_parcela=v) for v in (100.0, 200.0)]
    + [dict(ano_competencia=2023, mes_competencia=7, id_municipio="10", valor_parcela=900.0)],
    "fundeb.indicador_municipal": [dict(id_municipio="10", ano=2022, bimestre=6, id_indicador="45", valor_real=4000.0), dict(id_municipio="10", ano=2022, bimestre=6, id_indicador="67", valor_percentual=88.0),
                                   dict(id_municipio="10", ano=2022, bimestre=5, id_indicador="45", valor_real=9999.0)],
    "fundeb.indicador_estadual": [dict(sigla_uf="DF", ano=2022, bimestre=6, id_indicador="66", valor_real=7000.0), dict(sigla_uf="X", ano=2022, bimestre=6, id_indicador="66", valor_real=1.0)],
    "siconfi.municipio_despesas_funcao": [dict(id_municipio="10", ano=2022, estagio_bd="Despesas Empenhadas", id_conta_bd=c, valor=v) for c, v in [("3.00.000", 200.0), ("3.12.000", 50.0), ("3.12.361", 20.0)]],
    "siconfi.uf_despesas_funcao": [],
    "siconfi.municipio_receitas_orcamentarias": [dict(id_municipio="10", ano=2022, estagio_bd="Receitas Brutas Realizadas", conta_bd=c, valor=v) for c, v in [
        ("Transferências de Recursos do Fundo - FUNDEB", 40.0), ("Transferências de Recursos de Complementação da União ao Fundeb", 4.0), ("Outra conta", 1000.0)]],
    "siconfi.uf_receitas_orcamentarias": [],
}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sources")
    for name, ddl in SCHEMAS.items():
        cols = [c.split()[0] for c in ddl.split(",")]
        data = [tuple(r.get(c) for c in cols) for r in DATA[name]]
        spark.createDataFrame(data, ddl).coalesce(1).write.parquet(f"{root}/{name.replace('.', '/')}")
    s = Store(spark, Catalog(spark, str(root)), root=str(tmp_path_factory.mktemp("features")))
    s.report = {r["table"]: r for r in materialize(s).collect()}
    return s


def one(store, name, **where):
    df = store.feature(name)
    for c, v in where.items():
        df = df.where(F.col(c) == v)
    got = rows(df)
    assert len(got) == 1
    return got[0]


def test_every_table_is_built_and_counted(store):
    assert list(store.report) == list(BUILDERS) and len(BUILDERS) == 11
    assert store.report["populacao_avaliada"]["n_rows"] == 6 and store.report["abt_aluno"]["n_rows"] == 6
    assert store.report["abt_aluno"]["n_columns"] == 145


def test_population(store):
    df = store.feature("populacao_avaliada")
    assert not {"proficiencia", "presenca", "preenchimento_caderno", "fonte"} & set(df.columns)
    assert not [r for r in rows(df) if r["id_aluno"].startswith("out")]


def test_lagged_results_come_from_the_year_before(store):
    r = one(store, "ctx_municipio_lag", ano=2024, id_municipio="10")
    assert (r["mun_lag_taxa_observada"], r["mun_lag_n_avaliados"], r["mun_lag_n_escolas"]) == (0.75, 4, 1)
    # Duplicate official rows: the first in a total order; the goal is the one of the target year.
    assert (r["mun_lag_taxa_oficial"], r["mun_lag_meta_ano_alvo"], r["mun_lag_gap_meta_ano"]) == (60.0, 65.0, -5.0)


def test_territory_is_a_grid_with_lagged_state(store):
    assert store.feature("ctx_territorio").count() == 4
    r = one(store, "ctx_territorio", ano=2024, id_municipio="20")
    assert (r["uf_lag_taxa"], r["uf_lag_ranking"], r["ter_latitude"]) == (50.0, 3, None)
    assert one(store, "ctx_territorio", ano=2023, id_municipio="20")["uf_lag_taxa"] is None


def test_schools_are_weighted_by_enrolment(store):
    r = one(store, "ext_censo_escolar")
    assert (r["rede"], r["inf_n_escolas_ai"], r["inf_matriculas_ai"]) == ("Municipal", 2, 100)
    assert (r["inf_alunos_por_turma_ai"], r["inf_alunos_por_docente_ai"], r["inf_dispositivos_por_aluno"]) == (25.0, None, 0.08)
    # A missing flag counts as no.
    assert (r["inf_pct_urbana"], r["inf_pct_agua_potavel"], r["inf_pct_biblioteca_leitura"]) == (0.8, 0.8, 0.2)


def test_indicators_mix_two_temporal_rules(store):
    r = one(store, "ext_indicadores_educacionais", ano=2023)
    assert (r["rede"], r["edu_tdi_anos_iniciais"], r["edu_aprovacao_ai_lag1"]) == ("Municipal", 9.0, 91.0)
    assert (r["edu_docentes_superior_ai"], r["edu_gap_tdi_rural_urbana"], r["edu_alunos_por_turma_rural"]) == (77.0, 12.0, 12.0)


def test_socioeconomic_level_and_distance_to_the_state(store):
    r = one(store, "ext_inse", id_municipio="10")
    assert (r["ano"], r["inse_ano_referencia"], r["inse_medio"], r["inse_medio_uf"]) == (2023, 2021, 5.5, 6.75)
    assert (r["inse_desvio_vs_uf"], r["inse_pct_niveis_baixos"], r["inse_pct_niveis_altos"], r["inse_pct_escolas_rurais"]) == (-1.25, 2.5, 37.5, 50.0)


def test_exam_editions(store):
    r = one(store, "ext_ideb_saeb", ano=2023, rede="Municipal")
    assert (r["edu_ideb_ai_publica"], r["edu_ideb_ai_rede_do_aluno"], r["edu_ideb_variacao"]) == (5.0, 5.5, 0.5)
    assert (r["edu_saeb5_pct_lp_baixos"], r["edu_saeb5_pct_lp_altos"], r["edu_ideb_imputado_uf"]) == (6.0, None, False)
    later = one(store, "ext_ideb_saeb", ano=2024, rede="Estadual")
    assert (later["edu_ideb_ai_publica"], later["edu_ideb_ai_publica_imputado"], later["edu_ideb_imputado_uf"]) == (None, 5.8, True)
    assert later["edu_ideb_ai_rede_do_aluno"] == 6.0


def test_census_shares(store):
    r = one(store, "ext_ibge", ano=2023)
    assert (r["ses_pib_per_capita"], r["ses_densidade_demografica"], r["ses_moradores_por_domicilio"]) == (20.0, None, 3.0)
    assert (r["ses_share_pop_5a9"], r["ses_taxa_alfab_adultos_25a44"], r["ses_share_esgoto_inadequado"]) == (0.25, 0.9, 0.25)
    assert (r["ses_share_indigena_quilombola"], r["ses_share_domicilio_precario"]) == (0.1, None)


def test_vulnerability_is_pinned_to_one_row(store):
    r = one(store, "ext_vulnerabilidade")
    assert (r["ano"], r["ses_ivs"], r["ses_log_renda_per_capita"], r["ses_taxa_desocupacao"]) == (2023, 0.3, None, 7.0)
    assert (r["ses_taxa_cadunico"], r["ses_razao_pbf_cadunico"], r["ses_valor_medio_familia_pbf"]) == (0.4, 0.25, None)
    assert (r["ses_cobertura_pbf_atual"], r["ses_valor_pbf_per_capita_atual"]) == (0.02, 3.0)


def test_finance_of_the_closed_year_and_the_state_run_group(store):
    r = one(store, "ext_financas", id_municipio="10")
    assert (r["ano"], r["fin_fonte_estadual"], r["fin_invest_aluno_ens_fund"], r["fin_pct_fundeb_remuneracao"]) == (2023, False, 4000.0, 88.0)
    assert (r["fin_pct_educacao_sobre_desp_total"], r["fin_pct_ens_fund_sobre_educacao"], r["fin_pct_fundeb_sobre_desp_total"], r["fin_pct_complementacao_uniao"]) == (25.0, 40.0, 20.0, 10.0)
    df = one(store, "ext_financas", id_municipio=StoreConfig().state_run_group)
    assert df["fin_fonte_estadual"] and df["fin_invest_aluno_ens_fund"] == 7000.0 and df["fin_pct_complementacao_uniao"] == 0.0


def test_base_table_keeps_units_without_context(store):
    r = one(store, "abt_aluno", id_aluno="b2")
    assert (r["mun_lag_taxa_observada"], r["nome_municipio"], r["inf_n_escolas_ai"]) == (None, None, None)
    assert one(store, "abt_aluno", id_aluno="b1")["mun_lag_taxa_observada"] == 0.75
    assert not [c for c in store.feature("abt_aluno").columns if c.startswith("esc_lag_")]
    assert "mun_lag_meta_ano_alvo" in store.feature("abt_aluno").columns


def test_years_are_pruned_at_the_scan(store, spark):
    df = S.load_abt(spark, store.path("abt_aluno"), ["id_aluno", "alvo_alfabetizado"], [2024])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ano" in plan or "PartitionFilters: [ano" in plan
    assert "ReadSchema: struct<id_aluno:string,alvo_alfabetizado:boolean>" in plan and df.count() == 2


def test_base_table_never_shuffles_the_units(store):
    plan = BUILDERS["abt_aluno"](store)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 9 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_partial_runs_and_unknown_names(store):
    again = materialize(Store(store.spark, store.catalog, root=store.root), only="ext_f")
    assert [r["table"] for r in again.collect()] == ["ext_financas"]
    with pytest.raises(ValueError, match="no feature table"):
        materialize(store, only="nothing")


def test_missing_source_column_fails_early(spark, tmp_path):
    spark.createDataFrame([(2023,)], "ano int").write.parquet(str(tmp_path / "gold" / "panorama_uf"))
    with pytest.raises(ValueError, match="ranking_taxa"):
        Catalog(spark, str(tmp_path)).table("gold.panorama_uf")


def test_catalog_views_and_environment(store, spark, monkeypatch):
    store.catalog.register_views("gold.panorama_uf")
    assert spark.sql("SELECT count(*) FROM gold_panorama_uf").first()[0] == 2
    monkeypatch.setenv("COHORTLENS_ROOT", "/elsewhere")
    assert Catalog(spark, "/here").path("a.b") == "/elsewhere/a/b"
    assert Catalog(spark, "/here", {"a.b": "/x"}).path("a.b") == "/x"


def test_verified_write_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert S.verified_write(df, str(tmp_path / "t")).count() == 2
    assert S.verified_write(df.limit(1), str(tmp_path / "t")).count() == 1
    for fmt in ("csv", "json", "parquet"):
        path = S.write_report(df, str(tmp_path), f"r_{fmt}", fmt, single_file=True)
        assert spark.read.format(fmt).load(path).count() >= 2
    with pytest.raises(ValueError):
        S.write_report(df, str(tmp_path), "r", "xlsx")


def test_scores_are_checked_by_key(spark, tmp_path):
    ids = spark.createDataFrame([(1,), (2,)], "row_id long")
    good = spark.createDataFrame([(i, m, 1, 0.5) for i in (1, 2) for m in ("A", "B")], "row_id long, model string, y int, p double")
    assert S.save_scores(good, str(tmp_path / "s")) == 4
    assert S.load_scores(spark, str(tmp_path / "s"), ids, models=["A", "B"]).count() == 4
    with pytest.raises(ValueError, match="expected"):
        S.load_scores(spark, str(tmp_path / "s"), models=["A"])
    with pytest.raises(ValueError, match="one to one"):
        S.load_scores(spark, str(tmp_path / "s"), ids.limit(1))
    S.save_scores(good.where("NOT (row_id = 2 AND model = 'B')"), str(tmp_path / "t"))
    with pytest.raises(ValueError, match="one to one"):
        S.load_scores(spark, str(tmp_path / "t"), ids)


def test_partitioned_write_runs_its_plan_once_and_spreads_a_hot_group(spark, tmp_path):
    from cohortlens.sources.storage import stored_bytes, write_partitioned
    seen = spark.sparkContext.accumulator(0)

    def tick(k):
        seen.add(1)
        return k

    counted = F.udf(tick, "long").asNondeterministic()
    rows = spark.range(4000, numPartitions=4).select(
        counted("id").alias("id"), F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("g"), F.col("id").cast("string"))).alias("grp"),
        (2023 + F.col("id") % 2).cast("int").alias("year"), F.when(F.col("id") > 3990, F.lit(1)).alias("constant"))
    path = str(tmp_path / "t")
    assert write_partitioned(rows, path, ["year"], ["grp"], partitions=8) == 4000
    assert seen.value == 4000
    back = spark.read.parquet(path)
    assert back.count() == 4000 and back.select("id").distinct().count() == 4000
    files = back.where("grp = 'hot'").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 4 and max(f["count"] for f in files) <= 1500
    # The number of ranges follows the stored bytes.
    size = stored_bytes(back)
    small = str(tmp_path / "small")
    write_partitioned(back, small, ["year"], ["grp"], file_bytes=size // 4)
    assert len(spark.read.parquet(small).inputFiles()) >= 4 and stored_bytes(spark.createDataFrame([(1,)], "a int")) == 0
    empty = str(tmp_path / "empty")
    assert write_partitioned(back.limit(0), empty, ["year"], ["grp"]) == 0


def test_rows_that_store_small_are_sorted_in_bounded_parts(spark, tmp_path, monkeypatch):
    """Repeated texts take few stored bytes and many in the task that sorts them: these count too."""
    df = spark.range(4000).select((F.col("id") % 2).alias("ano"), F.lit("x" * 200).alias("t"), F.array("id").alias("a"), F.lit(None).cast("string").alias("none"))
    assert 4000 * 200 < S.row_bytes(df) < 4000 * 400 and S.row_bytes(df.limit(0)) == 0
    monkeypatch.setattr(S, "SORT_BYTES", 100_000)
    assert S.write_partitioned(df, str(tmp_path / "t"), ["ano"]) == 4000
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 4000 and back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 1500
