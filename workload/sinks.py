"""What sinks, catalog, checks on columns and registries leave behind, read back (S, F1, Q11, M4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortlens.operators import models as M
from cohortlens.operators import roles
from cohortlens.plans.registry import Store, materialize
from cohortlens.session import shared_dir
from cohortlens.sources import storage
from cohortlens.sources.catalog import Catalog
from workload.modelling import split
from workload.registry import R, Star, query, sql
from workload.sources import StarCatalog
from workload.store import ALL_VIEWS, DOCUMENTING, POP_VIEWS, build


def folder(s: Star, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(s.spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@query("s1_catalog", """
    SELECT c_custkey, c_nationkey, n_name, count(o_orderkey) AS n_orders FROM customer JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def _(s: Star):
    """Three tables by logical name: declared columns of two, all columns of the third, seen by SQL as views."""
    at = {f"star.{t}": f"{s.dir}/{t}.parquet" for t in ("customer", "nation", "orders")}
    schemas = {"star.customer": "c_custkey bigint,c_nationkey int", "star.orders": "o_orderkey bigint,o_custkey bigint"}
    Catalog(s.spark, s.dir, at, schemas).register_views(*at)
    return s.spark.sql("""SELECT c_custkey, c_nationkey, n_name, count(o_orderkey) AS n_orders FROM star_customer
        JOIN star_nation ON c_nationkey = n_nationkey LEFT JOIN star_orders ON o_custkey = c_custkey GROUP BY ALL""")


_NET, _TOWN = "USING (ano, id_municipio, rede)", "USING (ano, id_municipio)"
_ABT = f"""SELECT * EXCLUDE (caderno, rede, peso_aluno, {', '.join(DOCUMENTING)}), caderno AS alu_caderno, rede AS alu_rede, peso_aluno AS alu_peso_amostral
    FROM pop LEFT JOIN t2 {_TOWN} LEFT JOIN t4 {_NET} LEFT JOIN t6 {_NET} LEFT JOIN t5 {_NET} LEFT JOIN t7 {_NET} LEFT JOIN t8 {_TOWN}
    LEFT JOIN t9 {_TOWN} LEFT JOIN t10 {_TOWN} LEFT JOIN (SELECT * EXCLUDE (sigla_uf) FROM t3) t {_TOWN}"""
# The feature tables and the view that each one must equal.
_TABLES = {"populacao_avaliada": "pop", "ctx_municipio_lag": "t2", "ctx_territorio": "t3", "ext_censo_escolar": "t4", "ext_indicadores_educacionais": "t5",
           "ext_inse": "t6", "ext_ideb_saeb": "t7", "ext_ibge": "t8", "ext_vulnerabilidade": "t9", "ext_financas": "t10", "abt_aluno": "abt"}


def _cells(view: str) -> str:
    """Columns of a view and the values known in each."""
    return f"(UNPIVOT (SELECT count(COLUMNS(*)) FROM {view}) ON COLUMNS(*) INTO NAME c VALUE v)"


@query("s2_materialize", sql(" UNION ALL ".join(
    f"SELECT '{t}' AS name, (SELECT count(*) FROM {v}) AS n_rows, CAST(count(*) AS INTEGER) AS n_columns FROM {_cells(v)}" for t, v in _TABLES.items()),
    **ALL_VIEWS, abt=_ABT))
def _(s: Star):
    """All feature tables, built in order from stored ones, and the report of the run."""
    return materialize(Store(s.spark, StarCatalog(s.spark, s.dir), root=folder(s, "features"))).withColumnRenamed("table", "name")


@query("s3_write_partitioned", sql("SELECT * FROM pop", **POP_VIEWS))
def _(s: Star):
    """The unit table, written by year in ranges of group and school, as it is read back."""
    path = folder(s, "partitioned")
    units = build(s, "populacao_avaliada")
    storage.write_partitioned(units, path, ["ano"], ["id_municipio", "id_escola"])
    return s.spark.read.parquet(path).select(*units.columns)


@query("s4_verified_write", sql(f"""
    SELECT year, l_returnflag AS code, l_linestatus AS status, count(*) AS n, {R('sum(l_extendedprice * (1 - l_discount))', 2)} AS net
    FROM (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem) GROUP BY ALL"""))
def _(s: Star):
    """All line items through a verified write, then summed from the copy."""
    path = folder(s, "verified")
    back = storage.verified_write(s.t("lineitem"), path)
    return back.groupBy(F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("code"), F.col("l_linestatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double"), 2).alias("net"))


@query("s6_write_report", sql("""
    SELECT format, grp, n, hits FROM (SELECT grp, count(*) AS n, count(*) FILTER (WHERE target) AS hits FROM evaluated GROUP BY 1), (VALUES ('csv'), ('json'), ('parquet')) f(format)""",
    "evaluated"))
def _(s: Star):
    """Hits of each group, written in the three formats and read back from each."""
    report = s.evaluated.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if("target").alias("hits"))
    root, out = folder(s, "reports"), None
    for fmt in ("csv", "json", "parquet"):
        reader = s.spark.read.schema(report.schema)
        reader = reader.option("header", True) if fmt == "csv" else reader
        back = reader.format(fmt).load(storage.write_report(report, root, fmt, fmt, single_file=True)).withColumn("format", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


@query("s7_stored_model", sql(f"""
    SELECT unit_id AS row_id, (SELECT {R('avg(CAST(CAST(target AS INTEGER) AS DOUBLE))')} FROM evaluated WHERE year = 1999) AS p
    FROM evaluated WHERE year = 2000""", "evaluated"))
def _(s: Star):
    """The baseline with its preprocessing, fitted, stored, loaded and applied."""
    train, test = split(s)
    path = folder(s, "model")
    storage.save_model(M.fit_candidate("baseline", train, ["wealth", "segment"], kinds={"numeric": ["wealth"], "low": ["segment"], "high": []}), path)
    return M.score(storage.load_model(path), test, ["row_id"])


@query("s8_stored_scores", sql(f"SELECT row_id, model, y, {R('p')} AS p FROM scores", "scores"))
def _(s: Star):
    """The score table, stored by model and checked against the rows it must cover."""
    path = folder(s, "scores")
    storage.save_scores(s.scores.select("row_id", "model", "y", "p"), path)
    rows = s.evaluated.select(F.col("unit_id").alias("row_id"))
    return storage.load_scores(s.spark, path, rows, models=["A", "B"]).select("row_id", "model", "y", "p")


# Beginnings of names and their blocks.
_BLOCK_SQL = """CASE WHEN c IN ('id_municipio', 'sigla_uf') THEN 'geographic identity' WHEN c LIKE 'alu\\_%' ESCAPE '\\' THEN 'student'
    WHEN c LIKE 'inf\\_%' ESCAPE '\\' THEN 'school (infrastructure)' WHEN c LIKE 'inse\\_%' ESCAPE '\\' THEN 'school (socioeconomic)'
    WHEN c LIKE 'edu\\_%' ESCAPE '\\' THEN 'education' WHEN c LIKE 'mun\\_%' ESCAPE '\\' THEN 'municipality (education)'
    WHEN c LIKE 'ses\\_%' ESCAPE '\\' THEN 'municipality (socioeconomic)' WHEN c LIKE 'fin\\_%' ESCAPE '\\' THEN 'municipality (finance)'
    WHEN c LIKE 'ter\\_%' ESCAPE '\\' THEN 'territory' WHEN c LIKE 'uf\\_%' ESCAPE '\\' THEN 'state' ELSE 'others' END"""


@query("f1_blocks", sql(f"""
    SELECT {_BLOCK_SQL} AS block, count(*) AS n_features, CAST(sum(v) AS BIGINT) AS n_values
    FROM {_cells('abt')} GROUP BY 1""", **ALL_VIEWS, abt=_ABT))
def _(s: Star):
    """Columns of the base table by block, with the values that are known in each block."""
    abt = build(s, "abt_aluno", staged=True)
    known = abt.agg(*[F.count(c).alias(c) for c in abt.columns])
    cells = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.col(c).alias("v")) for b, cols in roles.blocks(abt.columns).items() for c in cols]))
    return known.select(cells.alias("s")).groupBy("s.block").agg(F.count(F.lit(1)).alias("n_features"), F.sum("s.v").alias("n_values"))


@query("q11_forbid_columns", sql("SELECT ano, rede AS alu_rede, count(*) AS n, count(DISTINCT id_escola) AS n_schools FROM pop GROUP BY ALL", **POP_VIEWS))
def _(s: Star):
    """The base table, refused if a rejected column is in it; counted as it passes through."""
    abt = roles.forbid_columns(build(s, "abt_aluno", staged=True))
    return abt.groupBy("ano", "alu_rede").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id_escola").alias("n_schools"))


@query("m4_candidate_registry", sql(f"""
    SELECT m.name, needs_scaling, n_rows, CASE WHEN m.name = 'logistic' THEN {R('1.0 / n_rows')} END AS penalty FROM (SELECT count(*) AS n_rows FROM evaluated WHERE year = 1999),
    (VALUES ('baseline', false), ('logistic', true), ('hist_boost', false), ('leaf_boost', false), ('depth_boost', false)) m(name, needs_scaling)""", "evaluated"))
def _(s: Star):
    """Every candidate by name, made for the training rows, with the penalty that depends on their number."""
    train = s.evaluated.where("year = 1999")
    n = train.count()
    rows = [(name, M.candidate(name).needs_scaling, n, float(made.getRegParam()) if name == "logistic" else None)
            for name in M.CANDIDATES for made in [M.candidate(name).make(n)]]
    return s.spark.createDataFrame(rows, "name string, needs_scaling boolean, n_rows long, penalty double")
