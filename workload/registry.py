"""Registry of queries, and the role map that reads the star schema as a cohort study."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, also: str | None = None):
    """Register a query, under a second name too if it has one; doubles are rounded to six digits at this boundary only."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Star(spark, sf_dir)))
        run.__name__ = name
        for n in filter(None, (name, also)):
            QUERIES[n] = run
            if sql is not None:
                ORACLES[n] = sql
        return fn
    return wrap


CUT = 200_000.0
TRAIN, TEST = 1999, 2000


class Star:
    """The given tables, and the cohort views of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def units(self) -> DataFrame:
        """One row per order: the unit rows of the study."""
        o, c, n = self.t("orders"), self.t("customer"), self.t("nation")
        joined = (o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey))
        present, completed = F.col("o_orderstatus") != "P", F.col("o_orderpriority") != "5-LOW"
        return joined.select(
            F.col("o_orderkey").alias("unit_id"), F.year("o_orderdate").alias("year"),
            F.col("c_nationkey").alias("grp"), F.col("n_regionkey").alias("parent"),
            F.col("c_mktsegment").alias("segment"), F.col("o_custkey").alias("school"),
            F.col("o_orderpriority").alias("control"),
            (1 + F.col("o_custkey") % 10).cast("bigint").alias("weight"),
            present.alias("present"), completed.alias("completed"),
            F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "4-NOT SPECIFIED"),
                   "stream").otherwise("batch").alias("source"),
            F.col("o_totalprice").alias("score"),
            F.when(F.col("o_totalprice") >= 60000.0, F.col("c_acctbal")).alias("wealth"),
            F.when(F.col("c_acctbal") >= 0, present & completed & (F.col("o_totalprice") >= CUT))
            .alias("target"))

    @property
    def evaluated(self) -> DataFrame:
        from cohortlens.plans.units import evaluated_population
        return evaluated_population(self.units, "present", "completed", "source", "target",
                                    hidden=["score"])

    @property
    def scores(self) -> DataFrame:
        """Two deterministic pseudo-models over the evaluated rows, as a long score table."""
        u = self.evaluated
        y = F.col("target").cast("int")
        a = (200 + 300 * y + (F.col("unit_id") * 7919) % 500).cast("double") / 1009
        b = (200 + 200 * y + (F.col("unit_id") * 104729) % 600).cast("double") / 1009
        models = F.explode(F.array(F.struct(F.lit("A").alias("model"), a.alias("p")),
                                   F.struct(F.lit("B").alias("model"), b.alias("p"))))
        return (u.select("*", y.alias("y"), models.alias("m"))
                .select(F.col("unit_id").alias("row_id"), "m.model", "y", "m.p", "year", "grp",
                        "parent", "segment", "school"))

    @property
    def lines(self) -> DataFrame:
        """Line items with the year and the supplier's group."""
        li, s = self.t("lineitem"), self.t("supplier")
        return li.join(s, li.l_suppkey == s.s_suppkey).select(
            F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
            F.col("s_nationkey").alias("grp"), F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
            F.col("l_returnflag").alias("code"), F.col("s_suppkey").alias("supplier"),
            (F.col("l_linestatus") == "O").cast("int").alias("open_line"),
            F.when(F.col("l_linenumber") != 7, (F.col("l_returnflag") == "R").cast("int"))
            .alias("returned"))


# --- SQL side ---------------------------------------------------------------------------------

CTES = {
    "units": """
        SELECT o_orderkey AS unit_id, CAST(year(o_orderdate) AS INTEGER) AS year,
               c_nationkey AS grp, n_regionkey AS parent, c_mktsegment AS segment,
               o_custkey AS school, o_orderpriority AS control,
               CAST(1 + o_custkey % 10 AS BIGINT) AS weight,
               o_orderstatus <> 'P' AS present, o_orderpriority <> '5-LOW' AS completed,
               CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED'
                    THEN 'stream' ELSE 'batch' END AS source,
               o_totalprice AS score,
               CASE WHEN o_totalprice >= 60000 THEN c_acctbal END AS wealth,
               CASE WHEN c_acctbal >= 0 THEN o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'
                    AND o_totalprice >= 200000 END AS target
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "evaluated": """
        SELECT unit_id, year, grp, parent, segment, school, control, weight, wealth, target
        FROM units WHERE present AND completed AND source = 'batch' AND target IS NOT NULL""",
    "scores": """
        SELECT unit_id AS row_id, 'A' AS model, CAST(target AS INTEGER) AS y, year, grp, parent,
               segment, school, CAST(200 + 300 * CAST(target AS INTEGER) + (unit_id * 7919) % 500 AS DOUBLE) / 1009 AS p
        FROM evaluated
        UNION ALL
        SELECT unit_id, 'B', CAST(target AS INTEGER), year, grp, parent, segment, school,
               CAST(200 + 200 * CAST(target AS INTEGER) + (unit_id * 104729) % 600 AS DOUBLE) / 1009
        FROM evaluated""",
    "lines": """
        SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
               s_nationkey AS grp, l_quantity AS quantity, l_extendedprice AS price,
               l_discount AS discount, l_returnflag AS code, s_suppkey AS supplier,
               CAST(l_linestatus = 'O' AS INTEGER) AS open_line,
               CASE WHEN l_linenumber <> 7 THEN CAST(l_returnflag = 'R' AS INTEGER) END AS returned
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
}
NEEDS = {"evaluated": ["units"], "scores": ["units", "evaluated"]}


def sql(body: str, *names: str, **extra: str) -> str:
    """A statement with the shared views it needs and views of its own, in order."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*NEEDS.get(n, []), n] if x not in wanted]
    parts = [f"{n} AS ({CTES[n].strip()})" for n in wanted]
    parts += [f"{n} AS ({text.strip()})" for n, text in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def R(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits})"


def H(seed: str, key: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT"
