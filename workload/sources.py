"""The store's source tables, derived from the star schema.

One statement per source, written in SQL that Spark and the checking engine both read, so
both sides of a check start from the same rows. Years move by 24 to fall on the store's
calendar; every row of the star tables takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STAR = """(SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority, c_acctbal, n_nationkey, n_name,
    r_name, c_mktsegment, CAST(year(o_orderdate) + 24 AS INT) AS ano,
    CAST(n_nationkey AS STRING) || '-' || c_mktsegment AS id_municipio FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
LINES = """(SELECT l.*, CAST(year(l_shipdate) + 24 AS INT) AS ano, r_name AS sigla_uf, CAST(l_quantity AS INT) AS q,
    CAST(s_nationkey AS STRING) || '-' || CASE l_returnflag WHEN 'A' THEN 'BUILDING' WHEN 'N' THEN 'MACHINERY' ELSE 'FURNITURE' END
    AS id_municipio FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)"""
NETWORK = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Municipal' WHEN '2-HIGH' THEN 'Estadual' WHEN '3-MEDIUM' THEN 'Privada'
    ELSE 'Municipal' END"""
PLACE = "CASE o_orderstatus WHEN 'F' THEN 'Total' WHEN 'O' THEN 'Rural' ELSE 'Urbana' END"
TOWNS = f"SELECT id_municipio, count(*) AS n, avg(o_totalprice) AS price, avg(c_acctbal) AS balance FROM {STAR} s GROUP BY id_municipio"
YEARLY = f"SELECT ano, id_municipio, count(*) AS n, avg(o_totalprice) AS price, avg(c_acctbal) AS balance FROM {STAR} s GROUP BY ano, id_municipio"


def _avg(*names: str, scale: float = 99991.0, source: str = "o_totalprice") -> str:
    return ", ".join(f"avg({source}) / {scale * (i + 1)} AS {n}" for i, n in enumerate(names))


SCHOOL_FLAGS = ["agua_potavel", "esgoto_rede_publica", "energia_rede_publica", "lixo_servico_coleta", "internet_aprendizagem",
                "banda_larga", "biblioteca_sala_leitura", "laboratorio_informatica", "quadra_esportes", "parque_infantil",
                "refeitorio", "alimentacao", "material_pedagogico_jogo", "profissional_pedagogia", "orgao_conselho_escolar"]
QUANTITIES = ["matricula_fundamental_anos_iniciais", "turma_fundamental_anos_iniciais", "docente_fundamental_anos_iniciais",
              "matricula_fundamental_anos_iniciais_integral", "desktop_aluno", "computador_portatil_aluno", "tablet_aluno"]
INDICATORS = ["tdi_ef_anos_iniciais", "tdi_ef_2_ano", "atu_ef_anos_iniciais", "had_ef_anos_iniciais", "taxa_aprovacao_ef_anos_iniciais",
              "taxa_reprovacao_ef_anos_iniciais", "taxa_abandono_ef_anos_iniciais", "afd_ef_anos_iniciais_grupo_1",
              "afd_ef_anos_iniciais_grupo_5", "dsu_ef_anos_iniciais", "ied_ef_anos_iniciais_nivel_1", "ied_ef_anos_iniciais_nivel_6",
              "icg_nivel_1", "ird_alta", "ird_baixa_regularidade"]
EXAM = ["ideb", "taxa_aprovacao", "indicador_rendimento", "nota_saeb_matematica", "nota_saeb_lingua_portuguesa", "nota_saeb_media_padronizada"]
INDICES = ["ivs", "ivs_capital_humano", "ivs_renda_trabalho", "ivs_infraestrutura_urbana", "idhm_e", "renda_per_capita", "indice_gini",
           "proporcao_vulneravel", "proporcao_domicilio_densidade", "proporcao_responsavel_fundamental_incompleto",
           "proporcao_maternidade_fundamental_incompleto_crianca_15_menos", "fecundidade_total", "mortalidade_1_menos",
           "proporcao_crianca_fora_escola_6_14"]
FUND_CODES = {"municipal": ["45", "56", "58", "24", "67", "27", "29"], "estadual": ["66", "72", "74", "40", "42", "44", "46"]}


def _code(values: list[str], by: str) -> str:
    branches = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values, 1))
    return f"CASE {by} {branches} END"


ACCOUNT = _code(["3.00.000", "3.12.000", "3.12.361"], "CASE WHEN l_linenumber > 4 THEN 1 WHEN l_linenumber > 2 THEN 2 ELSE 3 END")
INCOME = """CASE WHEN l_linenumber > 4 THEN 'Transferências de Recursos do Fundo - FUNDEB'
    WHEN l_linenumber > 2 THEN 'Transferências de Recursos de Complementação da União ao FUNDEB' ELSE 'Outras receitas' END"""
# The state tables: rows of one region, presented as the state that reports for its capital.
STATE = f"(SELECT * FROM {LINES} a WHERE sigla_uf = 'ASIA')"


def _fund(kind: str, key: str, src: str) -> str:
    return (f"SELECT {key}, ano, CAST(CASE WHEN l_linestatus = 'O' THEN 6 ELSE 3 END AS INT) AS bimestre, "
            f"{_code(FUND_CODES[kind], 'l_linenumber')} AS id_indicador, max(l_extendedprice) AS valor_real, "
            f"max(l_discount) * 100 AS valor_percentual FROM {src} s GROUP BY 1, 2, 3, 4")


SOURCES: dict[str, str] = {
    "silver.alunos": f"""SELECT ano, CAST(o_orderkey AS STRING) AS id_aluno, CAST(o_custkey AS STRING) AS id_escola, id_municipio,
        r_name AS sigla_uf, o_orderpriority AS caderno, {NETWORK} AS rede, CAST(1 + o_custkey % 10 AS DOUBLE) AS peso_aluno,
        CASE WHEN c_acctbal >= 0 THEN o_totalprice >= 200000 END AS alfabetizado, o_orderstatus <> 'P' AS presenca,
        o_orderpriority <> '5-LOW' AS preenchimento_caderno, o_totalprice AS proficiencia,
        CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED' THEN 'stream' ELSE 'batch' END AS fonte FROM {STAR} s""",
    "silver.indicador_municipio": f"""SELECT ano, id_municipio, CAST(CASE WHEN o_orderstatus = 'P' THEN 5 ELSE 2 END AS INT) AS serie,
        {NETWORK} AS rede, avg(o_totalprice) / 4999 AS taxa_alfabetizacao, avg(c_acctbal) / 89 AS media_portugues FROM {STAR} s
        GROUP BY ano, id_municipio, CASE WHEN o_orderstatus = 'P' THEN 5 ELSE 2 END, o_orderpriority""",
    "silver.metas_municipio": f"""SELECT ano, id_municipio, price / 4999 AS meta_alfabetizacao_2024, price / 4493 AS meta_alfabetizacao_2025,
        price / 4001 AS meta_alfabetizacao_2026, CAST(80 AS DOUBLE) AS meta_alfabetizacao_2030, CAST(n AS DOUBLE) AS nivel_alfabetizacao,
        balance / 97 AS percentual_participacao FROM ({YEARLY}) y WHERE price < 300000""",
    "silver.dim_municipio": f"""SELECT id_municipio, max(n_name) AS nome_municipio, max(r_name) AS sigla_uf, max(r_name) AS nome_regiao,
        max(c_mktsegment) AS nome_mesorregiao, CAST(max(n_nationkey) AS DOUBLE) AS latitude, -CAST(max(n_nationkey) AS DOUBLE) AS longitude,
        max(c_acctbal) > 9900 AS capital_uf, min(c_acctbal) < -900 AS amazonia_legal FROM {STAR} s GROUP BY id_municipio""",
    "gold.panorama_uf": f"""SELECT ano, r_name AS sigla_uf, CASE WHEN o_orderstatus = 'P' THEN 'Privada' ELSE 'Pública (Estadual e Municipal)' END AS rede,
        avg(o_totalprice) / 4999 AS taxa, CAST(max(n_nationkey) AS INT) AS ranking_taxa FROM {STAR} s
        GROUP BY ano, r_name, CASE WHEN o_orderstatus = 'P' THEN 'Privada' ELSE 'Pública (Estadual e Municipal)' END""",
    "censo_escolar.escola": f"""SELECT ano, id_municipio, CAST(1 + l_linenumber % 5 AS STRING) AS rede,
        CASE WHEN l_tax > 0.07 THEN '2' ELSE '1' END AS tipo_situacao_funcionamento,
        CAST(CASE WHEN l_discount > 0.09 THEN 0 ELSE 1 END AS INT) AS etapa_ensino_fundamental_anos_iniciais,
        {', '.join(f"CASE WHEN q > {2 * i} THEN q - {2 * i} END AS quantidade_{n}" for i, n in enumerate(QUANTITIES, 1))},
        CASE WHEN l_linestatus = 'O' THEN '1' ELSE '2' END AS tipo_localizacao, CAST(l_linenumber AS STRING) AS tipo_localizacao_diferenciada,
        {', '.join(f"CAST(CASE WHEN l_linenumber = 7 THEN NULL WHEN q > {3 * i} THEN 1 ELSE 0 END AS INT) AS {f}" for i, f in enumerate(SCHOOL_FLAGS, 1))}
        FROM {LINES} s""",
    "indicadores_edu.municipio": f"""SELECT ano, id_municipio, {PLACE} AS localizacao, CASE o_orderpriority WHEN '1-URGENT' THEN 'Municipal'
        WHEN '2-HIGH' THEN 'Estadual' WHEN '3-MEDIUM' THEN 'Privada' WHEN '4-NOT SPECIFIED' THEN 'Pública' ELSE 'Total' END AS rede,
        {_avg(*INDICATORS)} FROM {STAR} s GROUP BY ano, id_municipio, o_orderstatus, o_orderpriority""",
    "inse.escola": f"""SELECT ano, id_municipio, sigla_uf, CASE WHEN l_linenumber = 7 THEN 'x' ELSE CAST(1 + l_linenumber % 4 AS STRING) END AS rede,
        CASE WHEN l_linestatus = 'O' THEN '1' ELSE '2' END AS tipo_localizacao, '1' AS area, l_extendedprice / 10007 AS inse,
        CAST(q - 1 AS BIGINT) AS quantidade_alunos_inse,
        {', '.join(f"CASE WHEN q > {5 * i} THEN l_tax * {i} END AS percentual_nivel_{i}" for i in range(1, 9))} FROM {LINES} s""",
    "ideb.municipio": f"""SELECT ano, id_municipio, max(r_name) AS sigla_uf, CASE o_orderpriority WHEN '1-URGENT' THEN 'municipal' WHEN '2-HIGH' THEN 'estadual'
        WHEN '3-MEDIUM' THEN 'privada' WHEN '4-NOT SPECIFIED' THEN 'publica' ELSE 'federal' END AS rede,
        CASE WHEN o_orderstatus = 'P' THEN 'finais (6-9)' ELSE 'iniciais (1-5)' END AS anos_escolares, 'fundamental' AS ensino, {_avg(*EXAM)}
        FROM {STAR} s GROUP BY ano, id_municipio, o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN 'finais (6-9)' ELSE 'iniciais (1-5)' END""",
    "ideb.uf": f"""SELECT ano, r_name AS sigla_uf, CASE WHEN o_orderpriority = '1-URGENT' THEN 'publica' ELSE 'privada' END AS rede,
        CASE WHEN o_orderstatus = 'P' THEN 'finais (6-9)' ELSE 'iniciais (1-5)' END AS anos_escolares, 'fundamental' AS ensino, {_avg('ideb')}
        FROM {STAR} s GROUP BY 1, 2, 3, 4""",
    "saeb.municipio": f"""SELECT ano, id_municipio, CASE WHEN o_orderpriority <= '3' THEN 'total - estadual e municipal' ELSE 'privada' END AS rede,
        CASE WHEN c_acctbal < 4500 THEN 'LP' ELSE 'MT' END AS disciplina, lower({PLACE}) AS localizacao, CAST(5 AS INT) AS serie,
        {_avg('media', *[f'nivel_{i}' for i in range(10)])} FROM {STAR} s GROUP BY 1, 2, 3, 4, 5""",
    "ibge_pib.municipio": f"SELECT id_municipio, ano, CAST(price * n AS DOUBLE) AS pib FROM ({YEARLY}) y",
    "ibge_populacao.municipio": f"SELECT CASE WHEN n > 1 THEN id_municipio END AS id_municipio, ano, CAST(n - 2 AS BIGINT) AS populacao FROM ({YEARLY}) y",
    "censo2022.municipio": f"""SELECT id_municipio, price / 4999 AS taxa_alfabetizacao, CASE WHEN n > 100 THEN balance ELSE 0 END AS area,
        CAST(n - 100 AS BIGINT) AS domicilios, CAST(n AS BIGINT) AS populacao, price / 9001 AS idade_mediana, balance / 83 AS indice_envelhecimento,
        CAST(n - 90 AS BIGINT) AS populacao_indigena, CASE WHEN price > 250000 THEN CAST(3 AS BIGINT) END AS populacao_quilombola FROM ({TOWNS}) t""",
    "censo2022.populacao_idade": f"""SELECT id_municipio, CAST(CASE WHEN l_tax > 0.07 THEN 2010 ELSE 2022 END AS INT) AS ano,
        {_code(['0 a 4 anos', '5 a 9 anos', '10 a 14 anos', '15 a 19 anos', '25 a 34 anos', '35 a 44 anos', '45 anos ou mais'], 'l_linenumber')} AS grupo_idade,
        CAST(q AS BIGINT) AS populacao FROM {LINES} s""",
    "censo2022.alfabetizacao_idade": f"""SELECT id_municipio, {_code(['0 a 4 anos', '5 a 9 anos', '10 a 14 anos', '15 a 19 anos', '25 a 34 anos', '35 a 44 anos', '45 anos ou mais'], 'l_linenumber')}
        AS grupo_idade, CASE WHEN l_linestatus = 'O' THEN 'Alfabetizadas' ELSE 'Não alfabetizadas' END AS alfabetizacao, CAST(q AS BIGINT) AS populacao FROM {LINES} s""",
    "censo2022.esgotamento": f"""SELECT id_municipio, CAST(CASE WHEN l_tax > 0.07 THEN 2010 ELSE 2022 END AS INT) AS ano,
        {_code(['Vala', 'Rio, lago, córrego ou mar', 'Fossa séptica', 'Rede geral ou pluvial', 'Rede geral, rede pluvial ou fossa ligada à rede'], 'l_linenumber')}
        AS tipo_esgotamento_sanitario, CAST(q AS BIGINT) AS populacao FROM {LINES} s""",
    "censo2022.tipo_domicilio": f"""SELECT id_municipio, CAST(CASE WHEN l_tax > 0.07 THEN 2010 ELSE 2022 END AS INT) AS ano,
        {_code(['Casa', 'Apartamento', 'Habitação em casa de cômodos ou cortiço', 'Casa de vila'], 'l_linenumber')} AS tipo_domicilio,
        CAST(q AS BIGINT) AS populacao FROM {LINES} s""",
    "ipea_avs.municipio": f"""SELECT id_municipio, CAST(CASE WHEN ano > 2020 THEN 2010 ELSE 2000 END AS INT) AS ano, raca_cor, 'total' AS sexo, 'total' AS localizacao,
        CASE WHEN raca_cor = 'total' AND ano > 2024 THEN 'centro' END AS nome_udh, {_avg(*INDICES)} FROM (
        SELECT s.*, CASE WHEN o_orderstatus = 'P' THEN 'branca' ELSE 'total' END AS raca_cor FROM {STAR} s) x
        GROUP BY id_municipio, CASE WHEN ano > 2020 THEN 2010 ELSE 2000 END, raca_cor, CASE WHEN raca_cor = 'total' AND ano > 2024 THEN 'centro' END""",
    "onu_adh.municipio": f"""SELECT id_municipio, CAST(2010 AS INT) AS ano, price / 10007 AS expectativa_anos_estudo, price / 20011 AS taxa_atraso_2_fundamental,
        price / 30011 AS taxa_desocupacao_18_mais, balance / 97 AS prop_pobreza_criancas, balance / 193 AS taxa_freq_5_6 FROM ({TOWNS}) t""",
    "mc_indicadores.transferencias_municipio": f"""SELECT id_municipio, CAST(CASE WHEN o_orderstatus = 'P' THEN 2019 ELSE 2020 END AS INT) AS ano,
        CASE WHEN o_orderstatus <> 'P' THEN c_acctbal END AS pessoas_cadastradas_cu, c_acctbal / 2 AS pessoas_beneficiarias_pbf,
        c_acctbal / 3 AS familias_beneficiarias_pbf, o_totalprice AS valor_pago_pbf FROM {STAR} s""",
    "cgu_beneficios.novo_bolsa_familia": f"""SELECT ano AS ano_competencia, CAST(month(l_shipdate) AS INT) AS mes_competencia, id_municipio,
        l_quantity AS valor_parcela FROM {LINES} s""",
    "fundeb.indicador_municipal": _fund("municipal", "id_municipio", LINES),
    "fundeb.indicador_estadual": _fund("estadual", "'DF' AS sigla_uf", STATE),
    "siconfi.municipio_despesas_funcao": f"""SELECT id_municipio, ano, CASE WHEN l_linestatus = 'O' THEN 'Despesas Empenhadas' ELSE 'Despesas Pagas' END AS estagio_bd,
        {ACCOUNT} AS id_conta_bd, max(l_extendedprice) AS valor FROM {LINES} s GROUP BY 1, 2, 3, 4""",
    "siconfi.uf_despesas_funcao": f"""SELECT 'DF' AS sigla_uf, ano, CASE WHEN l_linestatus = 'O' THEN 'Despesas Empenhadas' ELSE 'Despesas Pagas' END AS estagio_bd,
        {ACCOUNT} AS id_conta_bd, max(l_extendedprice) AS valor FROM {STATE} s GROUP BY 1, 2, 3, 4""",
    "siconfi.municipio_receitas_orcamentarias": f"""SELECT id_municipio, ano, CASE WHEN l_linestatus = 'O' THEN 'Receitas Brutas Realizadas' ELSE 'Deduções' END AS estagio_bd,
        {INCOME} AS conta_bd, l_quantity AS valor FROM {LINES} s""",
    "siconfi.uf_receitas_orcamentarias": f"""SELECT 'DF' AS sigla_uf, ano, CASE WHEN l_linestatus = 'O' THEN 'Receitas Brutas Realizadas' ELSE 'Deduções' END AS estagio_bd,
        {INCOME} AS conta_bd, l_quantity AS valor FROM {STATE} s""",
}

BASE = ["orders", "customer", "nation", "region", "lineitem", "supplier"]


class StarCatalog:
    """Catalog whose tables are the statements above."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        for t in BASE:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)

    def table(self, name: str) -> DataFrame:
        return self.spark.sql(SOURCES[name])


def cte(*names: str) -> dict[str, str]:
    """The same statements for the checking engine, as views named ``layer_table``."""
    return {n.replace(".", "_"): SOURCES[n] for n in names}
