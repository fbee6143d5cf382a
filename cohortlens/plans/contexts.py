"""Context tables at (year, municipality) or (year, municipality, network) grain.

Every builder filters and aggregates its source to context grain first; only those small
tables are joined. Column names are the contract with the analytical base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import (
    contains_ci, decode, fallback_with_flag, filled_sum, flag, normalize_label, pick_by_year, safe_div, safe_log,
    slice_filter, starts_with, title_label, to_code, zero_fill)
from cohortlens.operators.aggregates import (
    conditional_pivot, count_sum_by, dedupe, distinct_keys, outcome_by, ratio_of_means, share_where,
    union_sources, weighted_rollup)
from cohortlens.operators.joins import grid, lag_join, outer_merge
from cohortlens.plans.registry import Store, feature_table
from cohortlens.plans.units import evaluated_population

MUN = "id_municipio"
KEY = ["ano", MUN]

# Network codes and labels of the sources.
NETWORKS = {"1": "Federal", "2": "Estadual", "3": "Municipal", "4": "Privada"}
PUBLIC_NETWORKS = {2: "Estadual", 3: "Municipal"}


@feature_table("populacao_avaliada", ("ano",), (MUN, "id_escola"))
def evaluated_units(store: Store) -> DataFrame:
    df = evaluated_population(store.source("silver.alunos"), "presenca", "preenchimento_caderno",
                              "fonte", "alfabetizado", hidden=["proficiencia"])
    return df.withColumnRenamed("alfabetizado", "alvo_alfabetizado")


@feature_table("ctx_municipio_lag")
def group_lag_context(store: Store) -> DataFrame:
    """What was known about a municipality one year earlier: results, targets, and the gap."""
    cfg = store.config
    observed = outcome_by(store.feature("populacao_avaliada"), KEY, "alvo_alfabetizado", "id_escola",
                          n="mun_lag_n_avaliados", units="mun_lag_n_escolas",
                          out="mun_lag_taxa_observada")
    official = dedupe(
        slice_filter(store.source("silver.indicador_municipio"), eq={"serie": 2, "rede": "Municipal"})
        .select(*KEY, F.col("taxa_alfabetizacao").alias("mun_lag_taxa_oficial"),
                F.col("media_portugues").alias("mun_lag_media_portugues")),
        KEY, ["mun_lag_taxa_oficial"])
    agreed = store.source("silver.metas_municipio").select(
        *KEY, pick_by_year(F.col("ano") + 1, cfg.target_columns_by_year).alias("mun_lag_meta_ano_alvo"),
        F.col("nivel_alfabetizacao").alias("mun_lag_nivel_alfabetizacao"),
        F.col("percentual_participacao").alias("mun_lag_pct_participacao"))
    same_year = observed.join(official, KEY, "left").join(agreed, KEY, "left")
    return same_year.select(
        (F.col("ano") + 1).alias("ano"), MUN, "mun_lag_taxa_observada", "mun_lag_n_avaliados",
        "mun_lag_n_escolas", "mun_lag_taxa_oficial", "mun_lag_media_portugues",
        "mun_lag_meta_ano_alvo", "mun_lag_nivel_alfabetizacao", "mun_lag_pct_participacao",
        (F.col("mun_lag_taxa_oficial") - F.col("mun_lag_meta_ano_alvo")).alias("mun_lag_gap_meta_ano"))


# Static attributes of a municipality and their names in the base table.
TERRITORY = {"nome_regiao": "ter_regiao", "nome_mesorregiao": "ter_mesorregiao",
             "latitude": "ter_latitude", "longitude": "ter_longitude",
             "capital_uf": "ter_capital_uf", "amazonia_legal": "ter_amazonia_legal"}
STATE_NETWORK = "Pública (Estadual e Municipal)"


@feature_table("ctx_territorio")
def territory_context(store: Store) -> DataFrame:
    years = sorted(r["ano"] for r in distinct_keys(store.feature("populacao_avaliada"), ["ano"]).collect())
    places = store.source("silver.dim_municipio").select(
        MUN, "nome_municipio", "sigla_uf", *[F.col(c).alias(o) for c, o in TERRITORY.items()])
    state = slice_filter(store.source("gold.panorama_uf"), eq={"rede": STATE_NETWORK}).select(
        "ano", "sigla_uf", F.col("taxa").alias("uf_lag_taxa"),
        F.col("ranking_taxa").alias("uf_lag_ranking"))
    spine = grid(places, {"ano": years})
    return lag_join(spine, state, ["sigla_uf"], "ano").select(
        "ano", MUN, "nome_municipio", "sigla_uf", *TERRITORY.values(), "uf_lag_taxa", "uf_lag_ranking")


# yes/no attributes of a school and the share each one becomes.
SCHOOL_FLAGS = {
    "inf_pct_agua_potavel": "agua_potavel", "inf_pct_esgoto_publico": "esgoto_rede_publica",
    "inf_pct_energia_publica": "energia_rede_publica", "inf_pct_lixo_coleta": "lixo_servico_coleta",
    "inf_pct_internet_aprendizagem": "internet_aprendizagem",
    "inf_pct_biblioteca_leitura": "biblioteca_sala_leitura",
    "inf_pct_lab_informatica": "laboratorio_informatica", "inf_pct_quadra": "quadra_esportes",
    "inf_pct_parque_infantil": "parque_infantil", "inf_pct_material_jogo": "material_pedagogico_jogo",
    "inf_pct_refeitorio": "refeitorio", "inf_pct_alimentacao": "alimentacao",
    "inf_pct_prof_pedagogia": "profissional_pedagogia",
    "inf_pct_conselho_escolar": "orgao_conselho_escolar",
}
SPECIAL_LOCATIONS = ["2", "3", "4"]
DEVICES = ["quantidade_desktop_aluno", "quantidade_computador_portatil_aluno", "quantidade_tablet_aluno"]
EARLY_GRADES = "fundamental_anos_iniciais"


@feature_table("ext_censo_escolar")
def school_census_context(store: Store) -> DataFrame:
    """Size and equipment of a network, weighted by enrolment instead of by school."""
    schools = slice_filter(
        store.source("censo_escolar.escola"),
        eq={"tipo_situacao_funcionamento": "1", f"etapa_ensino_{EARLY_GRADES}": 1},
        in_={"ano": store.config.target_years})
    pupils, classes, teachers = (zero_fill(f"quantidade_{w}_{EARLY_GRADES}") for w in ("matricula", "turma", "docente"))
    rows = schools.select(
        *KEY, decode("rede", NETWORKS).alias("rede"), pupils.alias("pupils"), classes.alias("classes"),
        teachers.alias("teachers"), zero_fill(f"quantidade_matricula_{EARLY_GRADES}_integral").alias("full_day"),
        filled_sum(*DEVICES).alias("devices"),
        flag(F.col("tipo_localizacao") == "1").alias("inf_pct_urbana"),
        flag(F.col("tipo_localizacao_diferenciada").isin(SPECIAL_LOCATIONS)).alias("inf_pct_loc_diferenciada"),
        zero_fill("banda_larga").alias("inf_pct_banda_larga"),
        *[F.col(c).alias(o) for o, c in SCHOOL_FLAGS.items()],
    ).where(F.col("rede").isNotNull())
    shares = ["inf_pct_urbana", "inf_pct_loc_diferenciada", "inf_pct_banda_larga", *SCHOOL_FLAGS]
    sizes = [F.count(F.lit(1)).alias("inf_n_escolas_ai"), F.sum("pupils").alias("inf_matriculas_ai")] + [
        safe_div(F.sum(a), F.sum(b)).alias(o) for o, (a, b) in {
            "inf_alunos_por_turma_ai": ("pupils", "classes"),
            "inf_alunos_por_docente_ai": ("pupils", "teachers"),
            "inf_pct_tempo_integral_ai": ("full_day", "pupils"),
            "inf_dispositivos_por_aluno": ("devices", "pupils")}.items()]
    return weighted_rollup(rows, [*KEY, "rede"], {c: c for c in shares}, "pupils", extra=sizes)


# Indicator columns by the time at which they are known.
STRUCTURAL = {"tdi_ef_anos_iniciais": "edu_tdi_anos_iniciais", "tdi_ef_2_ano": "edu_tdi_2ano",
              "atu_ef_anos_iniciais": "edu_alunos_por_turma_ai", "had_ef_anos_iniciais": "edu_horas_aula_ai"}
TEACHING = {"afd_ef_anos_iniciais_grupo_1": "edu_afd_grupo1_ai",
            "afd_ef_anos_iniciais_grupo_5": "edu_afd_grupo5_ai",
            "dsu_ef_anos_iniciais": "edu_docentes_superior_ai",
            "ied_ef_anos_iniciais_nivel_1": "edu_esforco_docente_n1",
            "ied_ef_anos_iniciais_nivel_6": "edu_esforco_docente_n6",
            "icg_nivel_1": "edu_complexidade_gestao_n1", "ird_alta": "edu_regularidade_docente_alta",
            "ird_baixa_regularidade": "edu_regularidade_docente_baixa"}
OUTCOME = {"taxa_aprovacao_ef_anos_iniciais": "edu_aprovacao_ai_lag1",
           "taxa_reprovacao_ef_anos_iniciais": "edu_reprovacao_ai_lag1",
           "taxa_abandono_ef_anos_iniciais": "edu_abandono_ai_lag1"}


@feature_table("ext_indicadores_educacionais")
def education_indicators_context(store: Store) -> DataFrame:
    """Structural indicators of the same year, outcome rates of the year before.

    Teaching indicators exist only on the municipality's total row, and rural-urban gaps on
    its location rows; both come from one conditional aggregate over those rows.
    """
    years = store.config.target_years
    base = (slice_filter(store.source("indicadores_edu.municipio"),
                         between={"ano": (min(years) - 1, max(years))})
            .withColumn("place", normalize_label("localizacao"))
            .withColumn("network", normalize_label("rede")))
    by_network = slice_filter(base, eq={"place": "total"}, in_={"network": ["municipal", "estadual", "privada"]})
    place = F.col("place")
    town = conditional_pivot(slice_filter(base, eq={"network": "total"}), KEY, {
        **{o: (place == "total", c) for c, o in TEACHING.items()},
        "rural_delay": (place == "rural", "tdi_ef_anos_iniciais"),
        "urban_delay": (place == "urbana", "tdi_ef_anos_iniciais"),
        "edu_alunos_por_turma_rural": (place == "rural", "atu_ef_anos_iniciais")})
    now = by_network.where(F.col("ano").isin(list(years))).select(
        *KEY, "network", *[F.col(c).alias(o) for c, o in STRUCTURAL.items()])
    before = by_network.select(*KEY, "network", *[F.col(c).alias(o) for c, o in OUTCOME.items()])
    full = lag_join(now.join(town, KEY, "left"), before, [MUN, "network"], "ano")
    return full.select(
        *KEY, title_label("network").alias("rede"), *STRUCTURAL.values(), *TEACHING.values(),
        (F.col("rural_delay") - F.col("urban_delay")).alias("edu_gap_tdi_rural_urbana"),
        "edu_alunos_por_turma_rural", *OUTCOME.values())


@feature_table("ext_inse")
def socioeconomic_index_context(store: Store) -> DataFrame:
    """Pupil-weighted socioeconomic level of a network and its distance to the state's.

    One aggregate reaches municipality grain with its weighted sums; the state's mean is
    summed from that table. The edition map re-keys editions to target years.
    """
    current = {y: pair[0] for y, pair in store.config.editions.items()}
    schools = (slice_filter(store.source("inse.escola"), in_={"ano": sorted(set(current.values()))})
               .where(F.col("quantidade_alunos_inse") > 0)
               .select("ano", MUN, "sigla_uf", decode(to_code("rede"), PUBLIC_NETWORKS).alias("rede"), "inse",
                       F.col("quantidade_alunos_inse").alias("q"), "tipo_localizacao",
                       filled_sum("percentual_nivel_1", "percentual_nivel_2").alias("low"),
                       filled_sum("percentual_nivel_6", "percentual_nivel_7", "percentual_nivel_8").alias("high"))
               .where(F.col("rede").isNotNull()))
    grain = ["ano", MUN, "rede"]
    n = F.count(F.lit(1))
    town = schools.groupBy(*grain).agg(
        F.min("sigla_uf").alias("sigla_uf"), n.alias("inse_n_escolas"),
        F.stddev_samp("inse").alias("inse_desvio_escolas"), F.min("inse").alias("inse_min_escola"),
        *[safe_div(F.sum(F.col(c) * F.col("q")), F.sum("q")).alias(o) for o, c in {
            "inse_medio": "inse", "inse_pct_niveis_baixos": "low", "inse_pct_niveis_altos": "high"}.items()],
        (safe_div(F.count_if(F.col("tipo_localizacao") == "2"), n) * 100).alias("inse_pct_escolas_rurais"),
        safe_div(F.sum("q"), n).alias("inse_tamanho_medio_escola"))
    sums = schools.groupBy("ano", MUN, "sigla_uf", "rede").agg(
        F.sum(F.col("inse") * F.col("q")).alias("xq"), F.sum("q").alias("q"))
    state = sums.groupBy("ano", "sigla_uf", "rede").agg(
        safe_div(F.sum("xq"), F.sum("q")).alias("inse_medio_uf"))
    both = (town.join(state, ["ano", "sigla_uf", "rede"], "left")
            .withColumn("inse_desvio_vs_uf", F.col("inse_medio") - F.col("inse_medio_uf")))
    targets = F.explode(F.array(*[F.struct(F.lit(y).alias("ano"), F.lit(e).alias("edition"))
                                  for y, e in current.items()]))
    return (both.withColumnRenamed("ano", "inse_ano_referencia").withColumn("m", targets)
            .where(F.col("m.edition") == F.col("inse_ano_referencia"))
            .select(F.col("m.ano").alias("ano"), MUN, "rede", "inse_ano_referencia", "inse_medio",
                    "inse_medio_uf", "inse_desvio_vs_uf", "inse_desvio_escolas", "inse_min_escola",
                    "inse_pct_niveis_baixos", "inse_pct_niveis_altos", "inse_pct_escolas_rurais",
                    "inse_tamanho_medio_escola", "inse_n_escolas"))


# Slices and columns of the exam editions.
EXAM_SLICE = {"anos_escolares": "iniciais (1-5)", "ensino": "fundamental"}
PUBLIC_COLUMNS = {"ideb": "edu_ideb_ai_publica", "taxa_aprovacao": "edu_ideb_taxa_aprovacao",
                  "indicador_rendimento": "edu_ideb_indicador_rendimento",
                  "nota_saeb_lingua_portuguesa": "edu_saeb_nota_lp",
                  "nota_saeb_matematica": "edu_saeb_nota_mat",
                  "nota_saeb_media_padronizada": "edu_saeb_nota_padronizada"}
EXAM_NETWORKS = ["municipal", "estadual", "privada"]
SAEB_SLICE = {"serie": 5, "rede": "total - estadual e municipal"}


@feature_table("ext_ideb_saeb")
def exam_edition_context(store: Store) -> DataFrame:
    """Last exam edition published before each target year, the one before it, and the
    state's value where the municipality has none (always with a flag).

    The same table serves as public, own-network and previous edition: one conditional
    aggregate per (edition, municipality) instead of three scans.
    """
    cfg = store.config
    wanted = {"ano": cfg.edition_years}
    exam = slice_filter(store.source("ideb.municipio"), eq=EXAM_SLICE, in_=wanted)
    network = F.col("rede")
    wide = conditional_pivot(exam, KEY, {
        **{o: (network == "publica", c) for c, o in PUBLIC_COLUMNS.items()},
        **{f"own_{r}": (network == r, "ideb") for r in EXAM_NETWORKS}}).withColumnRenamed("ano", "edition")
    state = slice_filter(store.source("ideb.uf"), eq={**EXAM_SLICE, "rede": "publica"}, in_=wanted).select(
        F.col("ano").alias("edition"), "sigla_uf", F.col("ideb").alias("edu_ideb_ai_uf"))
    lp, total = F.col("disciplina") == "LP", F.col("localizacao") == "total"

    def levels(first: int, last: int):
        return sum((F.col(f"nivel_{i}") for i in range(first + 1, last + 1)), F.col(f"nivel_{first}"))

    reading = conditional_pivot(
        slice_filter(store.source("saeb.municipio"), eq=SAEB_SLICE,
                     in_={**wanted, "localizacao": ["total", "urbana", "rural"]}), KEY, {
            "edu_saeb5_media_lp": (lp & total, "media"),
            "edu_saeb5_media_mt": ((F.col("disciplina") == "MT") & total, "media"),
            "edu_saeb5_pct_lp_baixos": (lp & total, levels(0, 2)),
            "edu_saeb5_pct_lp_altos": (lp & total, levels(6, 9)),
            "lp_urban": (lp & (F.col("localizacao") == "urbana"), "media"),
            "lp_rural": (lp & (F.col("localizacao") == "rural"), "media")}).withColumnRenamed("ano", "edition")

    places = distinct_keys(exam.where(network == "publica"), [MUN, "sigla_uf"])
    spine = (grid(places, {"ano": sorted(cfg.editions), "network": EXAM_NETWORKS})
             .withColumn("edition", decode("ano", {y: e[0] for y, e in cfg.editions.items()}))
             .withColumn("earlier", decode("ano", {y: e[1] for y, e in cfg.editions.items()})))
    previous = wide.select(F.col("edition").alias("earlier"), MUN,
                           F.col("edu_ideb_ai_publica").alias("edu_ideb_ai_publica_anterior"))
    full = (spine.join(wide, ["edition", MUN], "left").join(previous, ["earlier", MUN], "left")
            .join(reading, ["edition", MUN], "left").join(state, ["edition", "sigla_uf"], "left"))
    value, imputed = fallback_with_flag("edu_ideb_ai_publica", "edu_ideb_ai_uf")
    own = pick_by_network({r: f"own_{r}" for r in EXAM_NETWORKS})
    return full.select(
        *KEY, title_label("network").alias("rede"), F.col("edition").alias("edu_ideb_ano_referencia"),
        "edu_ideb_ai_publica", own.alias("edu_ideb_ai_rede_do_aluno"), "edu_ideb_ai_publica_anterior",
        (F.col("edu_ideb_ai_publica") - F.col("edu_ideb_ai_publica_anterior")).alias("edu_ideb_variacao"),
        *[o for o in PUBLIC_COLUMNS.values() if o != "edu_ideb_ai_publica"],
        "edu_saeb5_media_lp", "edu_saeb5_media_mt", "edu_saeb5_pct_lp_baixos", "edu_saeb5_pct_lp_altos",
        (F.col("lp_urban") - F.col("lp_rural")).alias("edu_saeb5_gap_urbano_rural_lp"), "edu_ideb_ai_uf",
        value.alias("edu_ideb_ai_publica_imputado"), imputed.alias("edu_ideb_imputado_uf"))


def pick_by_network(columns: dict[str, str]):
    out = F.lit(None).cast("double")
    for label, c in columns.items():
        out = F.when(F.col("network") == label, F.col(c)).otherwise(out)
    return out


# Category labels of the census tables.
AGE_5_9 = "5 a 9 anos"
CHILD_AGES = ["0 a 4 anos", "5 a 9 anos", "10 a 14 anos"]
PARENT_AGES = ["25 a 34 anos", "35 a 44 anos"]
LITERATE = "Alfabetizadas"
POOR_SEWAGE = ["Não tinham banheiro nem sanitário", "Vala", "Rio, lago, córrego ou mar",
               "Fossa rudimentar ou buraco"]
AGGREGATE_SEWAGE = "Rede geral, rede pluvial ou fossa ligada à rede"
POOR_HOUSING = ["Estrutura residencial permanente degradada ou inacabada",
                "Habitação em casa de cômodos ou cortiço", "Habitação indígena sem paredes ou maloca"]


@feature_table("ext_ibge")
def census_context(store: Store) -> DataFrame:
    """Static census shares plus last year's output and population."""
    cfg = store.config
    census_year = {"ano": cfg.census_year}
    town = store.source("censo2022.municipio").select(
        MUN, F.col("idade_mediana").alias("ses_idade_mediana"),
        F.col("indice_envelhecimento").alias("ses_indice_envelhecimento"),
        safe_div("populacao", "domicilios").alias("ses_moradores_por_domicilio"),
        safe_div("populacao", "area").alias("ses_densidade_demografica"),
        safe_div(F.col("populacao_indigena") + F.col("populacao_quilombola"), "populacao")
        .alias("ses_share_indigena_quilombola"),
        F.col("taxa_alfabetizacao").alias("ses_taxa_alfabetizacao_15mais"))
    ages = share_where(slice_filter(store.source("censo2022.populacao_idade"), eq=census_year), [MUN], "populacao", {
        "ses_share_pop_5a9": (F.col("grupo_idade") == AGE_5_9, None),
        "ses_share_pop_0a14": (F.col("grupo_idade").isin(CHILD_AGES), None)})
    adults = share_where(store.source("censo2022.alfabetizacao_idade"), [MUN], "populacao", {
        "ses_taxa_alfab_adultos_25a44": (F.col("alfabetizacao") == LITERATE,
                                         F.col("grupo_idade").isin(PARENT_AGES))})
    sewage = share_where(
        slice_filter(store.source("censo2022.esgotamento"), eq=census_year,
                     ne={"tipo_esgotamento_sanitario": AGGREGATE_SEWAGE}), [MUN], "populacao",
        {"ses_share_esgoto_inadequado": (F.col("tipo_esgotamento_sanitario").isin(POOR_SEWAGE), None)})
    housing = share_where(
        slice_filter(store.source("censo2022.tipo_domicilio"), eq=census_year), [MUN], "populacao",
        {"ses_share_domicilio_precario": (F.col("tipo_domicilio").isin(POOR_HOUSING), None)})
    static = town
    for part in (ages, adults, sewage, housing):
        static = static.join(part, MUN, "left")
    lagged = {"ano": cfg.lag_years}
    output = slice_filter(store.source("ibge_pib.municipio"), in_=lagged)
    people = slice_filter(store.source("ibge_populacao.municipio"), in_=lagged).where(F.col(MUN).isNotNull())
    yearly = outer_merge([output, people], KEY).select(
        *KEY, safe_div("pib", "populacao").alias("ses_pib_per_capita"), safe_log("populacao").alias("ses_log_populacao"))
    spine = grid(static, {"ano": list(cfg.target_years)})
    return lag_join(spine, yearly, [MUN], "ano").select(
        *KEY, "ses_pib_per_capita", "ses_log_populacao", "ses_idade_mediana", "ses_indice_envelhecimento",
        "ses_share_pop_5a9", "ses_share_pop_0a14", "ses_moradores_por_domicilio", "ses_densidade_demografica",
        "ses_share_indigena_quilombola", "ses_taxa_alfabetizacao_15mais", "ses_taxa_alfab_adultos_25a44",
        "ses_share_esgoto_inadequado", "ses_share_domicilio_precario")


# Structural indices taken over unchanged.
SOCIAL_INDICES = {
    "ivs": "ses_ivs", "ivs_capital_humano": "ses_ivs_capital_humano",
    "ivs_renda_trabalho": "ses_ivs_renda_trabalho", "ivs_infraestrutura_urbana": "ses_ivs_infra_urbana",
    "idhm_e": "ses_idhm_educacao", "indice_gini": "ses_gini", "proporcao_vulneravel": "ses_prop_vulneravel",
    "proporcao_domicilio_densidade": "ses_prop_domicilio_denso",
    "proporcao_responsavel_fundamental_incompleto": "ses_prop_resp_sem_fundamental",
    "proporcao_maternidade_fundamental_incompleto_crianca_15_menos": "ses_prop_mae_sem_fundamental",
    "fecundidade_total": "ses_fecundidade_total", "mortalidade_1_menos": "ses_mortalidade_infantil",
    "proporcao_crianca_fora_escola_6_14": "ses_prop_crianca_fora_escola",
}
DEVELOPMENT = {"expectativa_anos_estudo": "ses_expectativa_anos_estudo",
               "taxa_atraso_2_fundamental": "ses_taxa_atraso_2anos_fund",
               "taxa_desocupacao_18_mais": "ses_taxa_desocupacao",
               "prop_pobreza_criancas": "ses_prop_pobreza_criancas",
               "taxa_freq_5_6": "ses_taxa_freq_escola_5_6"}
TOTAL_SLICE = {"raca_cor": "total", "sexo": "total", "localizacao": "total"}


@feature_table("ext_vulnerabilidade")
def vulnerability_context(store: Store) -> DataFrame:
    """Structural vulnerability and the reach of cash transfers, per head.

    The vulnerability source mixes demographic cuts and city districts under one key; the
    slice pins it to one row per municipality. The benefits table is cut to one month
    before it is counted, and counts instalments.
    """
    cfg = store.config
    social = slice_filter(store.source("ipea_avs.municipio"), eq={"ano": cfg.structural_year, **TOTAL_SLICE},
                          is_null=["nome_udh"]).select(
        MUN, *[F.col(c).alias(o) for c, o in SOCIAL_INDICES.items()],
        safe_log("renda_per_capita").alias("ses_log_renda_per_capita"))
    development = slice_filter(store.source("onu_adh.municipio"), eq={"ano": cfg.structural_year}).select(
        MUN, *[F.col(c).alias(o) for c, o in DEVELOPMENT.items()])
    registered = slice_filter(store.source("mc_indicadores.transferencias_municipio"), eq={"ano": cfg.registry_year})
    transfers = ratio_of_means(registered, [MUN], {
        "ses_razao_pbf_cadunico": ("pessoas_beneficiarias_pbf", "pessoas_cadastradas_cu"),
        "ses_valor_medio_familia_pbf": ("valor_pago_pbf", "familias_beneficiarias_pbf")},
        extra=[F.avg("pessoas_cadastradas_cu").alias("registered"),
               F.avg("pessoas_beneficiarias_pbf").alias("assisted")])
    paid = count_sum_by(
        slice_filter(store.source("cgu_beneficios.novo_bolsa_familia"),
                     eq={"mes_competencia": cfg.reference_month}, in_={"ano_competencia": cfg.target_years})
        .withColumnRenamed("ano_competencia", "ano"), KEY, "valor_parcela", n="instalments", total="amount")
    people = slice_filter(store.source("ibge_populacao.municipio"), in_={"ano": cfg.target_years}).where(
        F.col(MUN).isNotNull())
    full = (people.join(social, MUN, "left").join(development, MUN, "left").join(transfers, MUN, "left")
            .join(paid, KEY, "left"))
    return full.select(
        *KEY, *SOCIAL_INDICES.values(), "ses_log_renda_per_capita", *DEVELOPMENT.values(),
        safe_div("registered", "populacao").alias("ses_taxa_cadunico"),
        safe_div("assisted", "populacao").alias("ses_taxa_pbf"), "ses_razao_pbf_cadunico",
        "ses_valor_medio_familia_pbf", safe_div("instalments", "populacao").alias("ses_cobertura_pbf_atual"),
        safe_div("amount", "populacao").alias("ses_valor_pbf_per_capita_atual"))


# Indicator and account codes. The state level numbers its indicators differently.
FUND_MUNICIPAL = {
    "fin_invest_aluno_ens_fund": ("45", "valor_real"), "fin_invest_aluno_educ_basica": ("56", "valor_real"),
    "fin_desp_professor_por_aluno": ("58", "valor_real"), "fin_pct_mde_sobre_impostos": ("24", "valor_percentual"),
    "fin_pct_fundeb_remuneracao": ("67", "valor_percentual"), "fin_pct_fundeb_nao_aplicado": ("27", "valor_percentual"),
    "fin_pct_fundeb_ens_fund": ("29", "valor_percentual"), "fin_pct_fundeb_educ_infantil": ("28", "valor_percentual"),
    "fin_pct_desp_ens_fund_sobre_educ": ("32", "valor_percentual"),
}
FUND_STATE = {
    "fin_invest_aluno_ens_fund": ("66", "valor_real"), "fin_invest_aluno_educ_basica": ("72", "valor_real"),
    "fin_desp_professor_por_aluno": ("74", "valor_real"), "fin_pct_mde_sobre_impostos": ("40", "valor_percentual"),
    "fin_pct_fundeb_remuneracao": ("42", "valor_percentual"), "fin_pct_fundeb_nao_aplicado": ("44", "valor_percentual"),
    "fin_pct_fundeb_ens_fund": ("46", "valor_percentual"), "fin_pct_fundeb_educ_infantil": ("45", "valor_percentual"),
    "fin_pct_desp_ens_fund_sobre_educ": ("49", "valor_percentual"),
}
ACCOUNTS = {"spent_total": ("3.00.000", "valor"), "spent_education": ("3.12.000", "valor"),
            "spent_primary": ("3.12.361", "valor")}
COMMITTED, RECEIVED = "Despesas Empenhadas", "Receitas Brutas Realizadas"
FUND_TEXT = "fundeb"
FUND_PREFIX = "Transferências de Recursos do Fundo"
FEDERAL_PREFIX = "Transferências de Recursos de Complementação da União"


@feature_table("ext_financas")
def finance_context(store: Store) -> DataFrame:
    """Education finance of the closed fiscal year.

    One municipality reports through its state, in state tables; its rows get the same
    columns from the state's own codes and a flag. The filters on codes follow from the
    specification of the columns.
    """
    cfg = store.config
    years = {"ano": cfg.lag_years}

    def level(name: str, state: bool, **eq) -> DataFrame:
        df = slice_filter(store.source(name), eq={**eq, **({"sigla_uf": cfg.state_run_parent} if state else {})}, in_=years)
        return df.withColumn(MUN, F.lit(cfg.state_run_group)) if state else df

    fund = union_sources([
        (conditional_pivot(level("fundeb.indicador_municipal", False, bimestre=6), KEY, FUND_MUNICIPAL, "id_indicador"), False),
        (conditional_pivot(level("fundeb.indicador_estadual", True, bimestre=6), KEY, FUND_STATE, "id_indicador"), True),
    ], "state_source")
    spent = union_sources([
        (conditional_pivot(level("siconfi.municipio_despesas_funcao", False, estagio_bd=COMMITTED), KEY, ACCOUNTS, "id_conta_bd"), False),
        (conditional_pivot(level("siconfi.uf_despesas_funcao", True, estagio_bd=COMMITTED), KEY, ACCOUNTS, "id_conta_bd"), True),
    ], "_state").drop("_state")

    def income(name: str, state: bool) -> DataFrame:
        rows = level(name, state, estagio_bd=RECEIVED).where(contains_ci("conta_bd", FUND_TEXT))
        return rows.groupBy(*KEY).agg(*[
            F.sum(F.when(starts_with("conta_bd", prefix), F.col("valor")).otherwise(0.0)).alias(o)
            for o, prefix in {"fund_income": FUND_PREFIX, "federal_top_up": FEDERAL_PREFIX}.items()])

    earned = union_sources([(income("siconfi.municipio_receitas_orcamentarias", False), False),
                            (income("siconfi.uf_receitas_orcamentarias", True), True)], "_state").drop("_state")
    pct = {"fin_pct_educacao_sobre_desp_total": ("spent_education", "spent_total"),
           "fin_pct_ens_fund_sobre_educacao": ("spent_primary", "spent_education"),
           "fin_pct_fundeb_sobre_desp_total": ("fund_income", "spent_total")}
    return outer_merge([fund, spent, earned], KEY).select(
        (F.col("ano") + 1).alias("ano"), MUN, F.coalesce("state_source", F.lit(False)).alias("fin_fonte_estadual"),
        *FUND_MUNICIPAL, safe_log("spent_education").alias("fin_log_desp_educacao"),
        safe_log("fund_income").alias("fin_log_receita_fundeb"),
        *[(safe_div(a, b) * 100).alias(o) for o, (a, b) in pct.items()],
        # No top-up reported means none received.
        zero_fill(safe_div("federal_top_up", "fund_income") * 100).cast("double").alias("fin_pct_complementacao_uniao"))
