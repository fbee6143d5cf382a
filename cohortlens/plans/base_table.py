"""The analytical base table: every evaluated unit with all of its context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.joins import enrich
from cohortlens.operators.roles import TARGET, forbid_columns
from cohortlens.plans import contexts  # noqa: F401  (registers the context builders)
from cohortlens.plans.registry import Store, feature_table

TOWN, NETWORK = ["ano", "id_municipio"], ["ano", "id_municipio", "rede"]

# Order of the blocks in the base table, their join keys, and the columns of a
# context that document it without being features.
BLOCK_ORDER = [
    ("ctx_municipio_lag", TOWN), ("ext_censo_escolar", NETWORK), ("ext_inse", NETWORK),
    ("ext_indicadores_educacionais", NETWORK), ("ext_ideb_saeb", NETWORK), ("ext_ibge", TOWN),
    ("ext_vulnerabilidade", TOWN), ("ext_financas", TOWN), ("ctx_territorio", TOWN),
]
DOCUMENTING = ["inse_ano_referencia", "edu_ideb_ano_referencia", "edu_ideb_ai_publica_anterior",
               "edu_saeb_nota_padronizada", "edu_saeb5_media_mt"]
IDENTITY = ["ano", "id_aluno", "id_escola", "id_municipio", "sigla_uf", "nome_municipio"]
STUDENT = {"caderno": "alu_caderno", "rede": "alu_rede", "peso_aluno": "alu_peso_amostral"}


@feature_table("abt_aluno", ("ano",), ("id_municipio",))
def analytical_base_table(store: Store) -> DataFrame:
    units = store.feature("populacao_avaliada")
    blocks = []
    for name, keys in BLOCK_ORDER:
        ctx = store.feature(name).drop(*DOCUMENTING)
        blocks.append((ctx.drop("sigla_uf") if name == "ctx_territorio" else ctx, keys))
    wide = enrich(units, blocks)
    front = [c for c in IDENTITY] + [TARGET, *STUDENT]
    context = [c for c in wide.columns if c not in front]
    return forbid_columns(wide.select(
        *IDENTITY, TARGET, *[F.col(c).alias(o) for c, o in STUDENT.items()], *context))
