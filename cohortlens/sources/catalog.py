"""Logical table names resolved to Parquet locations."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from cohortlens.sources.schemas import SCHEMAS


class Catalog:
    """Names of the form ``layer.table`` resolved under a root folder.

    ``locations`` overrides single names (an external dataset that lives elsewhere).
    The root may be replaced through the environment, so one program serves several
    deployments.
    """

    def __init__(self, spark: SparkSession, root: str,
                 locations: Mapping[str, str] | None = None,
                 schemas: Mapping[str, str] | None = None,
                 env: str = "COHORTLENS_ROOT"):
        self.spark = spark
        self.root = os.environ.get(env, root).rstrip("/")
        self.locations = dict(locations or {})
        self.schemas = SCHEMAS if schemas is None else dict(schemas)

    def path(self, name: str) -> str:
        return self.locations.get(name, f"{self.root}/{name.replace('.', '/')}")

    def table(self, name: str) -> DataFrame:
        """Read one table; declared columns only, missing columns fail here and now."""
        df = self.spark.read.parquet(self.path(name))
        declared = self.schemas.get(name)
        if declared is None:
            return df
        wanted = [part.split()[0] for part in declared.split(",")]
        missing = sorted(set(wanted) - set(df.columns))
        if missing:
            raise ValueError(f"{name}: columns missing from the source: {', '.join(missing)}")
        types = dict(part.split() for part in declared.split(","))
        return df.select(*[df[c].cast(types[c]).alias(c) for c in wanted])

    def register_views(self, *names: str) -> None:
        """Expose tables to SQL as ``layer_table``."""
        for name in names:
            self.table(name).createOrReplaceTempView(name.replace(".", "_"))
