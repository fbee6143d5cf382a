"""Declared schemas of the source tables, as DDL strings.

Only the columns that the feature builders read are declared. Reading through a declared
schema prunes wide sources (hundreds of columns) at the scan and fails early when a
column is missing.
"""

from __future__ import annotations

# Table and column names of the public datasets the store is built from.
SCHEMAS: dict[str, str] = {
    "silver.alunos": (
        "ano int, id_aluno string, id_escola string, id_municipio string, sigla_uf string, "
        "caderno string, rede string, peso_aluno double, alfabetizado boolean, "
        "presenca boolean, preenchimento_caderno boolean, proficiencia double, fonte string"),
    "silver.indicador_municipio": (
        "ano int, id_municipio string, serie int, rede string, taxa_alfabetizacao double, "
        "media_portugues double"),
    "silver.metas_municipio": (
        "ano int, id_municipio string, meta_alfabetizacao_2024 double, "
        "meta_alfabetizacao_2025 double, meta_alfabetizacao_2026 double, "
        "meta_alfabetizacao_2030 double, nivel_alfabetizacao double, "
        "percentual_participacao double"),
    "silver.dim_municipio": (
        "id_municipio string, nome_municipio string, sigla_uf string, nome_regiao string, "
        "nome_mesorregiao string, latitude double, longitude double, capital_uf boolean, "
        "amazonia_legal boolean"),
    "gold.panorama_uf": "ano int, sigla_uf string, rede string, taxa double, ranking_taxa int",
    "censo_escolar.escola": (
        "ano int, id_municipio string, rede string, tipo_situacao_funcionamento string, "
        "etapa_ensino_fundamental_anos_iniciais int, "
        "quantidade_matricula_fundamental_anos_iniciais int, "
        "quantidade_turma_fundamental_anos_iniciais int, "
        "quantidade_docente_fundamental_anos_iniciais int, "
        "quantidade_matricula_fundamental_anos_iniciais_integral int, "
        "quantidade_desktop_aluno int, quantidade_computador_portatil_aluno int, "
        "quantidade_tablet_aluno int, tipo_localizacao string, "
        "tipo_localizacao_diferenciada string, agua_potavel int, esgoto_rede_publica int, "
        "energia_rede_publica int, lixo_servico_coleta int, internet_aprendizagem int, "
        "banda_larga int, biblioteca_sala_leitura int, laboratorio_informatica int, "
        "quadra_esportes int, parque_infantil int, refeitorio int, alimentacao int, "
        "material_pedagogico_jogo int, profissional_pedagogia int, orgao_conselho_escolar int"),
    "indicadores_edu.municipio": (
        "ano int, id_municipio string, localizacao string, rede string, "
        "tdi_ef_anos_iniciais double, tdi_ef_2_ano double, atu_ef_anos_iniciais double, "
        "had_ef_anos_iniciais double, taxa_aprovacao_ef_anos_iniciais double, "
        "taxa_reprovacao_ef_anos_iniciais double, taxa_abandono_ef_anos_iniciais double, "
        "afd_ef_anos_iniciais_grupo_1 double, afd_ef_anos_iniciais_grupo_5 double, "
        "dsu_ef_anos_iniciais double, ied_ef_anos_iniciais_nivel_1 double, "
        "ied_ef_anos_iniciais_nivel_6 double, icg_nivel_1 double, ird_alta double, "
        "ird_baixa_regularidade double"),
    "inse.escola": (
        "ano int, id_municipio string, sigla_uf string, rede string, tipo_localizacao string, "
        "area string, inse double, quantidade_alunos_inse bigint, percentual_nivel_1 double, "
        "percentual_nivel_2 double, percentual_nivel_3 double, percentual_nivel_4 double, "
        "percentual_nivel_5 double, percentual_nivel_6 double, percentual_nivel_7 double, "
        "percentual_nivel_8 double"),
    "ideb.municipio": (
        "ano int, id_municipio string, sigla_uf string, rede string, anos_escolares string, "
        "ensino string, ideb double, taxa_aprovacao double, indicador_rendimento double, "
        "nota_saeb_matematica double, nota_saeb_lingua_portuguesa double, "
        "nota_saeb_media_padronizada double"),
    "ideb.uf": (
        "ano int, sigla_uf string, rede string, anos_escolares string, ensino string, "
        "ideb double"),
    "saeb.municipio": (
        "ano int, id_municipio string, rede string, disciplina string, localizacao string, "
        "serie int, media double, nivel_0 double, nivel_1 double, nivel_2 double, "
        "nivel_3 double, nivel_4 double, nivel_5 double, nivel_6 double, nivel_7 double, "
        "nivel_8 double, nivel_9 double"),
    "ibge_pib.municipio": "id_municipio string, ano int, pib double",
    "ibge_populacao.municipio": "id_municipio string, ano int, populacao bigint",
    "censo2022.municipio": (
        "id_municipio string, taxa_alfabetizacao double, area double, domicilios bigint, "
        "populacao bigint, idade_mediana double, indice_envelhecimento double, "
        "populacao_indigena bigint, populacao_quilombola bigint"),
    "censo2022.populacao_idade": (
        "id_municipio string, ano int, grupo_idade string, populacao bigint"),
    "censo2022.alfabetizacao_idade": (
        "id_municipio string, grupo_idade string, alfabetizacao string, populacao bigint"),
    "censo2022.esgotamento": (
        "id_municipio string, ano int, tipo_esgotamento_sanitario string, populacao bigint"),
    "censo2022.tipo_domicilio": (
        "id_municipio string, ano int, tipo_domicilio string, populacao bigint"),
    "ipea_avs.municipio": (
        "id_municipio string, ano int, raca_cor string, sexo string, localizacao string, "
        "nome_udh string, ivs double, ivs_capital_humano double, ivs_renda_trabalho double, "
        "ivs_infraestrutura_urbana double, idhm_e double, renda_per_capita double, "
        "indice_gini double, proporcao_vulneravel double, proporcao_domicilio_densidade double, "
        "proporcao_responsavel_fundamental_incompleto double, "
        "proporcao_maternidade_fundamental_incompleto_crianca_15_menos double, "
        "fecundidade_total double, mortalidade_1_menos double, "
        "proporcao_crianca_fora_escola_6_14 double"),
    "onu_adh.municipio": (
        "id_municipio string, ano int, expectativa_anos_estudo double, "
        "taxa_atraso_2_fundamental double, taxa_desocupacao_18_mais double, "
        "prop_pobreza_criancas double, taxa_freq_5_6 double"),
    "mc_indicadores.transferencias_municipio": (
        "id_municipio string, ano int, pessoas_cadastradas_cu double, "
        "pessoas_beneficiarias_pbf double, familias_beneficiarias_pbf double, "
        "valor_pago_pbf double"),
    "cgu_beneficios.novo_bolsa_familia": (
        "ano_competencia int, mes_competencia int, id_municipio string, valor_parcela double"),
    "fundeb.indicador_municipal": (
        "id_municipio string, ano int, bimestre int, id_indicador string, valor_real double, "
        "valor_percentual double"),
    "fundeb.indicador_estadual": (
        "sigla_uf string, ano int, bimestre int, id_indicador string, valor_real double, "
        "valor_percentual double"),
    "siconfi.municipio_despesas_funcao": (
        "id_municipio string, ano int, estagio_bd string, id_conta_bd string, valor double"),
    "siconfi.uf_despesas_funcao": (
        "sigla_uf string, ano int, estagio_bd string, id_conta_bd string, valor double"),
    "siconfi.municipio_receitas_orcamentarias": (
        "id_municipio string, ano int, estagio_bd string, conta_bd string, valor double"),
    "siconfi.uf_receitas_orcamentarias": (
        "sigla_uf string, ano int, estagio_bd string, conta_bd string, valor double"),
}
