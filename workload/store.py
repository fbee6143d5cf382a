"""The feature tables over sources derived from the star schema (S, T)."""

from __future__ import annotations

from cohortlens.operators import audits as Q
from cohortlens.plans import contexts as C
from cohortlens.plans.base_table import DOCUMENTING
from cohortlens.plans.registry import BUILDERS, Store
from workload.registry import R, Star, query, sql
from workload.sources import SOURCES, StarCatalog, cte

YEARS = "(2023, 2024)"
EDITION = {2023: (2021, 2019), 2024: (2023, 2021)}


def build(s: Star, name: str, staged: bool = False):
    return BUILDERS[name](Store(s.spark, StarCatalog(s.spark, s.dir), staged=staged))


def ratio(a: str, b: str) -> str:
    return R(f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)")


def raw(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


POP = """SELECT ano, id_aluno, id_escola, id_municipio, sigla_uf, caderno, rede, peso_aluno, alfabetizado AS alvo_alfabetizado
    FROM silver_alunos WHERE presenca AND preenchimento_caderno AND fonte = 'batch' AND alfabetizado IS NOT NULL"""
POP_VIEWS = {**cte("silver.alunos"), "pop": POP}


@query("t1_evaluated_units", sql("SELECT * FROM pop", **POP_VIEWS))
def _(s: Star):
    return build(s, "populacao_avaliada")


GOAL = "CASE m.ano WHEN 2023 THEN meta_alfabetizacao_2024 WHEN 2024 THEN meta_alfabetizacao_2025 WHEN 2025 THEN meta_alfabetizacao_2026 END"
LAG_VIEWS = {
    **POP_VIEWS, **cte("silver.indicador_municipio", "silver.metas_municipio"),
    "seen": """SELECT ano, id_municipio, count(*) AS n, count(DISTINCT id_escola) AS k,
        avg(CAST(CAST(alvo_alfabetizado AS INTEGER) AS DOUBLE)) AS r FROM pop GROUP BY ALL""",
    "official": """SELECT ano, id_municipio, min(taxa_alfabetizacao) AS taxa, arg_min(media_portugues, taxa_alfabetizacao) AS media
        FROM silver_indicador_municipio WHERE serie = 2 AND rede = 'Municipal' GROUP BY ALL""",
    "goals": f"SELECT ano, id_municipio, {GOAL} AS goal, nivel_alfabetizacao AS nivel, percentual_participacao AS part FROM silver_metas_municipio m",
    "t2": f"""SELECT ano + 1 AS ano, id_municipio, {R('r')} AS mun_lag_taxa_observada, n AS mun_lag_n_avaliados, k AS mun_lag_n_escolas,
        {R('taxa')} AS mun_lag_taxa_oficial, {R('media')} AS mun_lag_media_portugues, {R('goal')} AS mun_lag_meta_ano_alvo,
        {R('nivel')} AS mun_lag_nivel_alfabetizacao, {R('part')} AS mun_lag_pct_participacao, {R('taxa - goal')} AS mun_lag_gap_meta_ano
        FROM seen LEFT JOIN official USING (ano, id_municipio) LEFT JOIN goals USING (ano, id_municipio)"""}


@query("t2_group_lag_context", sql("SELECT * FROM t2", **LAG_VIEWS))
def _(s: Star):
    return build(s, "ctx_municipio_lag")


TERRITORY_VIEWS = {
    **POP_VIEWS, **cte("silver.dim_municipio", "gold.panorama_uf"),
    "t3": f"""SELECT y.ano, id_municipio, nome_municipio, d.sigla_uf, {', '.join(f"{R(c) if c in ('latitude', 'longitude') else c} AS {o}" for c, o in C.TERRITORY.items())},
        {R('p.taxa')} AS uf_lag_taxa, p.ranking_taxa AS uf_lag_ranking FROM (SELECT DISTINCT ano FROM pop) y, silver_dim_municipio d
        LEFT JOIN gold_panorama_uf p ON p.rede LIKE 'Pública%' AND p.sigla_uf = d.sigla_uf AND p.ano + 1 = y.ano"""}


@query("t3_territory_context", sql("SELECT * FROM t3", **TERRITORY_VIEWS))
def _(s: Star):
    return build(s, "ctx_territorio")


_G = C.EARLY_GRADES
_SHARES = {**C.SCHOOL_FLAGS, "inf_pct_urbana": "CASE WHEN tipo_localizacao = '1' THEN 1 ELSE 0 END",
           "inf_pct_loc_diferenciada": "CASE WHEN tipo_localizacao_diferenciada BETWEEN '2' AND '4' THEN 1 ELSE 0 END",
           "inf_pct_banda_larga": "ifnull(banda_larga, 0)"}
CENSUS_VIEWS = {
    **cte("censo_escolar.escola"),
    "school": f"""SELECT *, ['Federal', 'Estadual', 'Municipal', 'Privada'][CAST(rede AS INTEGER)] AS net, ifnull(quantidade_matricula_{_G}, 0) AS w,
        ifnull(quantidade_turma_{_G}, 0) AS t, ifnull(quantidade_docente_{_G}, 0) AS d, ifnull(quantidade_matricula_{_G}_integral, 0) AS i,
        {' + '.join(f'ifnull({c}, 0)' for c in C.DEVICES)} AS dev FROM censo_escolar_escola
        WHERE ano IN {YEARS} AND tipo_situacao_funcionamento = '1' AND etapa_ensino_{_G} = 1 AND CAST(rede AS INTEGER) <= 4""",
    "t4": f"""SELECT ano, id_municipio, net AS rede, count(*) AS inf_n_escolas_ai, CAST(sum(w) AS BIGINT) AS inf_matriculas_ai,
        {ratio('sum(w)', 'sum(t)')} AS inf_alunos_por_turma_ai, {ratio('sum(w)', 'sum(d)')} AS inf_alunos_por_docente_ai,
        {ratio('sum(i)', 'sum(w)')} AS inf_pct_tempo_integral_ai, {ratio('sum(dev)', 'sum(w)')} AS inf_dispositivos_por_aluno,
        {', '.join(f"{ratio(f'sum(({e}) * w)', 'sum(w)')} AS {o}" for o, e in _SHARES.items())} FROM school GROUP BY 1, 2, 3"""}


@query("t4_school_census_context", sql("SELECT * FROM t4", **CENSUS_VIEWS))
def _(s: Star):
    return build(s, "ext_censo_escolar")


INDICATOR_VIEWS = {
    **cte("indicadores_edu.municipio"),
    "ind": "SELECT *, lower(localizacao) AS loc, replace(lower(rede), 'ú', 'u') AS net FROM indicadores_edu_municipio",
    "own": "SELECT * FROM ind WHERE loc = 'total' AND net IN ('municipal', 'estadual', 'privada')",
    "town": f"""SELECT ano, id_municipio, {', '.join(f"max({c}) FILTER (WHERE loc = 'total') AS {o}" for c, o in C.TEACHING.items())},
        max(tdi_ef_anos_iniciais) FILTER (WHERE loc = 'rural') - max(tdi_ef_anos_iniciais) FILTER (WHERE loc = 'urbana') AS edu_gap_tdi_rural_urbana,
        max(atu_ef_anos_iniciais) FILTER (WHERE loc = 'rural') AS edu_alunos_por_turma_rural FROM ind WHERE net = 'total' GROUP BY 1, 2""",
    "t5": f"""SELECT ano, id_municipio, upper(net[1]) || net[2:] AS rede, {', '.join(f"{R(f'own.{c}')} AS {o}" for c, o in C.STRUCTURAL.items())},
        {', '.join(f"{R(f'town.{o}')} AS {o}" for o in [*C.TEACHING.values(), 'edu_gap_tdi_rural_urbana', 'edu_alunos_por_turma_rural'])},
        {', '.join(f"(SELECT {R(f'b.{c}')} FROM own b WHERE b.ano = own.ano - 1 AND b.id_municipio = own.id_municipio AND b.net = own.net) AS {o}" for c, o in C.OUTCOME.items())}
        FROM own LEFT JOIN town USING (ano, id_municipio) WHERE ano IN {YEARS}"""}


@query("t5_education_indicators_context", sql("SELECT * FROM t5", **INDICATOR_VIEWS))
def _(s: Star):
    return build(s, "ext_indicadores_educacionais")


_LOW = " + ".join(f"ifnull(percentual_nivel_{i}, 0)" for i in (1, 2))
_HIGH = " + ".join(f"ifnull(percentual_nivel_{i}, 0)" for i in (6, 7, 8))
INSE_VIEWS = {
    **cte("inse.escola"),
    "sch": f"""SELECT e.*, m.alvo, CASE TRY_CAST(rede AS BIGINT) WHEN 2 THEN 'Estadual' WHEN 3 THEN 'Municipal' END AS net, quantidade_alunos_inse AS w,
        {_LOW} AS low, {_HIGH} AS high FROM inse_escola e JOIN (VALUES (2023, 2021), (2024, 2023)) m(alvo, ano) ON e.ano = m.ano
        WHERE quantidade_alunos_inse > 0 AND TRY_CAST(rede AS BIGINT) IN (2, 3)""",
    "uf": f"SELECT alvo, sigla_uf, net, {raw('sum(inse * w)', 'sum(w)')} AS mean_uf FROM sch GROUP BY 1, 2, 3",
    "mun": f"""SELECT alvo, ano, id_municipio, net, min(sigla_uf) AS sigla_uf, {raw('sum(inse * w)', 'sum(w)')} AS mean_mun, stddev_samp(inse) AS sd, min(inse) AS lowest,
        {raw('sum(low * w)', 'sum(w)')} AS low, {raw('sum(high * w)', 'sum(w)')} AS high, 100 * {raw("count(*) FILTER (WHERE tipo_localizacao = '2')", 'count(*)')} AS rural,
        {raw('sum(w)', 'count(*)')} AS size, count(*) AS n FROM sch GROUP BY 1, 2, 3, 4""",
    "t6": f"""SELECT mun.alvo AS ano, id_municipio, mun.net AS rede, mun.ano AS inse_ano_referencia, {R('mean_mun')} AS inse_medio, {R('mean_uf')} AS inse_medio_uf,
        {R('mean_mun - mean_uf')} AS inse_desvio_vs_uf, {R('sd')} AS inse_desvio_escolas, {R('lowest')} AS inse_min_escola, {R('low')} AS inse_pct_niveis_baixos,
        {R('high')} AS inse_pct_niveis_altos, {R('rural')} AS inse_pct_escolas_rurais, {R('size')} AS inse_tamanho_medio_escola, n AS inse_n_escolas
        FROM mun JOIN uf ON uf.alvo = mun.alvo AND uf.sigla_uf = mun.sigla_uf AND uf.net = mun.net"""}


@query("t6_socioeconomic_index_context", sql("SELECT * FROM t6", **INSE_VIEWS))
def _(s: Star):
    return build(s, "ext_inse")


_FIRST = "anos_escolares LIKE 'iniciais%' AND ensino = 'fundamental'"
_LEVELS = lambda a, b: " + ".join(f"nivel_{i}" for i in range(a, b + 1))
EXAM_VIEWS = {
    **cte("ideb.municipio", "ideb.uf", "saeb.municipio"),
    "exam": f"SELECT * FROM ideb_municipio WHERE {_FIRST}",
    "spine": """SELECT alvo, ref, prev, id_municipio, sigla_uf, net FROM (VALUES (2023, 2021, 2019), (2024, 2023, 2021)) m(alvo, ref, prev),
        (SELECT DISTINCT id_municipio, sigla_uf FROM exam WHERE rede = 'publica' AND ano IN (2019, 2021, 2023)), (VALUES ('municipal'), ('estadual'), ('privada')) v(net)""",
    "lp": f"""SELECT ano, id_municipio, max(media) FILTER (WHERE disciplina = 'LP' AND localizacao = 'total') AS mlp, max(media) FILTER (WHERE disciplina = 'MT' AND localizacao = 'total') AS mmt,
        max({_LEVELS(0, 2)}) FILTER (WHERE disciplina = 'LP' AND localizacao = 'total') AS low, max({_LEVELS(6, 9)}) FILTER (WHERE disciplina = 'LP' AND localizacao = 'total') AS high,
        max(media) FILTER (WHERE disciplina = 'LP' AND localizacao = 'urbana') - max(media) FILTER (WHERE disciplina = 'LP' AND localizacao = 'rural') AS gap
        FROM saeb_municipio WHERE serie = 5 AND rede LIKE 'total%' GROUP BY 1, 2""",
    "t7": f"""SELECT s.alvo AS ano, s.id_municipio, upper(s.net[1]) || s.net[2:] AS rede, s.ref AS edu_ideb_ano_referencia, {R('o.ideb')} AS edu_ideb_ai_rede_do_aluno,
        {R('a.ideb')} AS edu_ideb_ai_publica_anterior, {R('p.ideb - a.ideb')} AS edu_ideb_variacao, {', '.join(f"{R(f'p.{c}')} AS {o}" for c, o in C.PUBLIC_COLUMNS.items())},
        {R('mlp')} AS edu_saeb5_media_lp, {R('mmt')} AS edu_saeb5_media_mt, {R('low')} AS edu_saeb5_pct_lp_baixos, {R('high')} AS edu_saeb5_pct_lp_altos,
        {R('gap')} AS edu_saeb5_gap_urbano_rural_lp, {R('u.ideb')} AS edu_ideb_ai_uf, {R('ifnull(p.ideb, u.ideb)')} AS edu_ideb_ai_publica_imputado,
        p.ideb IS NULL AND u.ideb IS NOT NULL AS edu_ideb_imputado_uf FROM spine s
        LEFT JOIN exam p ON (p.id_municipio, p.ano, p.rede) = (s.id_municipio, s.ref, 'publica') LEFT JOIN exam o ON (o.id_municipio, o.ano, o.rede) = (s.id_municipio, s.ref, s.net)
        LEFT JOIN exam a ON (a.id_municipio, a.ano, a.rede) = (s.id_municipio, s.prev, 'publica') LEFT JOIN lp ON (lp.id_municipio, lp.ano) = (s.id_municipio, s.ref)
        LEFT JOIN (SELECT * FROM ideb_uf WHERE {_FIRST} AND rede = 'publica') u ON (u.sigla_uf, u.ano) = (s.sigla_uf, s.ref)"""}


@query("t7_exam_edition_context", sql("SELECT * FROM t7", **EXAM_VIEWS))
def _(s: Star):
    return build(s, "ext_ideb_saeb")


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"



def _share(src: str, cond: str, where: str = "true", base: str = "true") -> str:
    inner = f"sum(CASE WHEN ({cond}) AND {base} THEN populacao ELSE 0 END)"
    return (f"(SELECT {ratio(inner, f'sum(populacao) FILTER (WHERE {base})')} FROM {src} x WHERE x.id_municipio = c.id_municipio AND {where})")


IBGE_VIEWS = {
    **cte("ibge_pib.municipio", "ibge_populacao.municipio", *[n for n in SOURCES if n.startswith("censo2022")]),
    "t8": f"""SELECT y.ano, c.id_municipio, (SELECT {ratio('max(pib)', 'max(populacao)')} FROM ibge_pib_municipio b JOIN ibge_populacao_municipio p USING (id_municipio, ano)
          WHERE id_municipio = c.id_municipio AND b.ano = y.ano - 1) AS ses_pib_per_capita,
        (SELECT {R('ln(max(CASE WHEN populacao > 0 THEN populacao END))')} FROM ibge_populacao_municipio p WHERE p.id_municipio = c.id_municipio AND p.ano = y.ano - 1) AS ses_log_populacao,
        {R('idade_mediana')} AS ses_idade_mediana, {R('indice_envelhecimento')} AS ses_indice_envelhecimento,
        {_share('censo2022_populacao_idade', f"grupo_idade = '{C.AGE_5_9}'", 'x.ano = 2022')} AS ses_share_pop_5a9,
        {_share('censo2022_populacao_idade', f'grupo_idade IN {_in(C.CHILD_AGES)}', 'x.ano = 2022')} AS ses_share_pop_0a14,
        {ratio('populacao', 'domicilios')} AS ses_moradores_por_domicilio, {ratio('populacao', 'area')} AS ses_densidade_demografica,
        {ratio('populacao_indigena + populacao_quilombola', 'populacao')} AS ses_share_indigena_quilombola, {R('taxa_alfabetizacao')} AS ses_taxa_alfabetizacao_15mais,
        {_share('censo2022_alfabetizacao_idade', "alfabetizacao = 'Alfabetizadas'", base=f'grupo_idade IN {_in(C.PARENT_AGES)}')} AS ses_taxa_alfab_adultos_25a44,
        {_share('censo2022_esgotamento', f'tipo_esgotamento_sanitario IN {_in(C.POOR_SEWAGE)}', f"x.ano = 2022 AND tipo_esgotamento_sanitario <> '{C.AGGREGATE_SEWAGE}'")} AS ses_share_esgoto_inadequado,
        {_share('censo2022_tipo_domicilio', f'tipo_domicilio IN {_in(C.POOR_HOUSING)}', 'x.ano = 2022')} AS ses_share_domicilio_precario
        FROM censo2022_municipio c, (VALUES (2023), (2024)) y(ano)"""}


@query("t8_census_context", sql("SELECT * FROM t8", **IBGE_VIEWS))
def _(s: Star):
    return build(s, "ext_ibge")


VULNERABILITY_VIEWS = {
    **cte("ipea_avs.municipio", "onu_adh.municipio", "mc_indicadores.transferencias_municipio", "cgu_beneficios.novo_bolsa_familia", "ibge_populacao.municipio"),
    "t9": f"""SELECT p.ano, p.id_municipio, {', '.join(f"{R(f'a.{c}')} AS {o}" for c, o in C.SOCIAL_INDICES.items())},
        CASE WHEN a.renda_per_capita > 0 THEN {R('ln(a.renda_per_capita)')} END AS ses_log_renda_per_capita, {', '.join(f"{R(f'h.{c}')} AS {o}" for c, o in C.DEVELOPMENT.items())},
        {ratio('cu', 'populacao')} AS ses_taxa_cadunico, {ratio('pbf', 'populacao')} AS ses_taxa_pbf, {ratio('pbf', 'cu')} AS ses_razao_pbf_cadunico, {ratio('paid', 'fam')} AS ses_valor_medio_familia_pbf,
        {ratio('k', 'populacao')} AS ses_cobertura_pbf_atual, {ratio('v', 'populacao')} AS ses_valor_pbf_per_capita_atual FROM ibge_populacao_municipio p
        LEFT JOIN (SELECT * FROM ipea_avs_municipio WHERE ano = 2010 AND raca_cor = 'total' AND sexo = 'total' AND localizacao = 'total' AND nome_udh IS NULL) a USING (id_municipio)
        LEFT JOIN (SELECT * FROM onu_adh_municipio WHERE ano = 2010) h USING (id_municipio)
        LEFT JOIN (SELECT id_municipio, avg(pessoas_cadastradas_cu) AS cu, avg(pessoas_beneficiarias_pbf) AS pbf, avg(familias_beneficiarias_pbf) AS fam, avg(valor_pago_pbf) AS paid
          FROM mc_indicadores_transferencias_municipio WHERE ano = 2020 GROUP BY 1) USING (id_municipio)
        LEFT JOIN (SELECT id_municipio, ano_competencia AS ano, count(*) AS k, sum(valor_parcela) AS v FROM cgu_beneficios_novo_bolsa_familia WHERE mes_competencia = 6 GROUP BY 1, 2) b
          ON b.id_municipio = p.id_municipio AND b.ano = p.ano WHERE p.ano IN {YEARS} AND p.id_municipio IS NOT NULL"""}


@query("t9_vulnerability_context", sql("SELECT * FROM t9", **VULNERABILITY_VIEWS))
def _(s: Star):
    return build(s, "ext_vulnerabilidade")


def _fund_sql(src: str, key: str, spec: dict, flag: str, where: str = "true") -> str:
    codes = _in(sorted({c for c, _ in spec.values()}))
    cols = ", ".join(f"max({v}) FILTER (WHERE id_indicador = '{c}') AS {o}" for o, (c, v) in spec.items())
    return f"SELECT {key} AS id_municipio, ano, {flag} AS st, {cols} FROM {src} WHERE bimestre = 6 AND {where} AND id_indicador IN {codes} GROUP BY 1, 2"


def _pair(tail: str, text: str) -> str:
    both = [f"SELECT id_municipio, ano, {text} FROM siconfi_municipio_{tail}", f"SELECT '5300108', ano, {text} FROM siconfi_uf_{tail} WHERE sigla_uf = 'DF'"]
    return " UNION ALL ".join(both)


FINANCE_VIEWS = {
    **cte(*[n for n in SOURCES if n.startswith(("fundeb", "siconfi"))]),
    "fund": _fund_sql("fundeb_indicador_municipal", "id_municipio", C.FUND_MUNICIPAL, "false") + " UNION ALL "
    + _fund_sql("fundeb_indicador_estadual", "'5300108'", C.FUND_STATE, "true", "sigla_uf = 'DF'"),
    "spend": f"""SELECT id_municipio, ano, max(valor) FILTER (WHERE id_conta_bd = '3.00.000') AS tot, max(valor) FILTER (WHERE id_conta_bd = '3.12.000') AS edu,
        max(valor) FILTER (WHERE id_conta_bd = '3.12.361') AS prim FROM ({_pair('despesas_funcao', 'estagio_bd, id_conta_bd, valor')})
        WHERE estagio_bd = 'Despesas Empenhadas' GROUP BY 1, 2""",
    "earn": f"""SELECT id_municipio, ano, ifnull(sum(valor) FILTER (WHERE conta_bd LIKE 'Transferências de Recursos do Fundo%'), 0) AS fund_in,
        ifnull(sum(valor) FILTER (WHERE conta_bd LIKE 'Transferências de Recursos de Complementação da União%'), 0) AS fed
        FROM ({_pair('receitas_orcamentarias', 'estagio_bd, conta_bd, valor')}) WHERE estagio_bd LIKE 'Receitas Brutas%' AND lower(conta_bd) LIKE '%fundeb%' GROUP BY 1, 2""",
    "t10": f"""SELECT ano + 1 AS ano, id_municipio, ifnull(st, false) AS fin_fonte_estadual, {', '.join(f'{R(o)} AS {o}' for o in C.FUND_MUNICIPAL)},
        CASE WHEN edu > 0 THEN {R('ln(edu)')} END AS fin_log_desp_educacao, CASE WHEN fund_in > 0 THEN {R('ln(fund_in)')} END AS fin_log_receita_fundeb,
        {R(f'100 * {raw("edu", "tot")}')} AS fin_pct_educacao_sobre_desp_total, {R(f'100 * {raw("prim", "edu")}')} AS fin_pct_ens_fund_sobre_educacao,
        {R(f'100 * {raw("fund_in", "tot")}')} AS fin_pct_fundeb_sobre_desp_total, {R(f'ifnull(100 * {raw("fed", "fund_in")}, 0)')} AS fin_pct_complementacao_uniao
        FROM fund FULL JOIN spend USING (id_municipio, ano) FULL JOIN earn USING (id_municipio, ano) WHERE ano IN (2022, 2023)"""}


@query("t10_finance_context", sql("SELECT * FROM t10", **FINANCE_VIEWS))
def _(s: Star):
    return build(s, "ext_financas")


ALL_VIEWS = {**LAG_VIEWS, **TERRITORY_VIEWS, **CENSUS_VIEWS, **INDICATOR_VIEWS, **INSE_VIEWS, **EXAM_VIEWS, **IBGE_VIEWS,
             **VULNERABILITY_VIEWS, **FINANCE_VIEWS}
_NET = "USING (ano, id_municipio, rede)"
_TOWN = "USING (ano, id_municipio)"


@query("t11_analytical_base_table", sql(f"""
    SELECT * EXCLUDE (caderno, rede, peso_aluno, {', '.join(DOCUMENTING)}), caderno AS alu_caderno, rede AS alu_rede, peso_aluno AS alu_peso_amostral
    FROM pop LEFT JOIN t2 {_TOWN} LEFT JOIN t4 {_NET} LEFT JOIN t6 {_NET} LEFT JOIN t5 {_NET} LEFT JOIN t7 {_NET} LEFT JOIN t8 {_TOWN}
    LEFT JOIN t9 {_TOWN} LEFT JOIN t10 {_TOWN} LEFT JOIN (SELECT * EXCLUDE (sigla_uf) FROM t3) t {_TOWN}""", **ALL_VIEWS))
def _(s: Star):
    return build(s, "abt_aluno", staged=True)


@query("s5_load_abt", sql("SELECT ano, id_municipio, alvo_alfabetizado FROM pop WHERE ano IN (2023, 2024)", **POP_VIEWS))
def _(s: Star):
    """Write the units partitioned by year, then read three columns of two years."""
    from cohortlens.session import shared_dir
    from cohortlens.sources.storage import load_abt, write_partitioned
    path = f"{shared_dir(s.spark)}/load-abt-{s.spark.sparkContext.applicationId}-{abs(hash(s.dir))}"
    write_partitioned(build(s, "populacao_avaliada"), path, ["ano"], ["id_municipio", "id_escola"])
    return load_abt(s.spark, path, ["ano", "id_municipio", "alvo_alfabetizado"], [2023, 2024])


@query("q6_block_coverage", sql(f"""
    SELECT ano, count(*) AS n, {R('100.0 * count(mun_lag_n_avaliados) / count(*)')} AS history, {R('100.0 * count(inf_n_escolas_ai) / count(*)')} AS school
    FROM pop LEFT JOIN t2 {_TOWN} LEFT JOIN t4 {_NET} GROUP BY 1""", **LAG_VIEWS, **CENSUS_VIEWS))
def _(s: Star):
    from cohortlens.operators.joins import enrich
    store = Store(s.spark, StarCatalog(s.spark, s.dir))
    wide = enrich(store.feature("populacao_avaliada"), [
        (store.feature("ctx_municipio_lag").select("ano", "id_municipio", "mun_lag_n_avaliados"), ["ano", "id_municipio"]),
        (store.feature("ext_censo_escolar").select("ano", "id_municipio", "rede", "inf_n_escolas_ai"), ["ano", "id_municipio", "rede"])])
    return Q.coverage_matrix(wide, "ano", {"history": "mun_lag_n_avaliados", "school": "inf_n_escolas_ai"})
