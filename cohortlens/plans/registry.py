"""Feature tables as an ordered registry of builders, and their materialisation."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from cohortlens.session import stage
from cohortlens.sources.storage import counted_write, write_partitioned


@dataclass(frozen=True)
class StoreConfig:
    """Years, edition calendar and local exceptions of the feature store."""

    # Target years, the edition each one may read, and the one before it.
    target_years: tuple[int, ...] = (2023, 2024)
    editions: Mapping[int, tuple[int, int]] = field(
        default_factory=lambda: {2023: (2021, 2019), 2024: (2023, 2021)})
    target_columns_by_year: Mapping[int, str] = field(
        default_factory=lambda: {2024: "meta_alfabetizacao_2024", 2025: "meta_alfabetizacao_2025",
                                 2026: "meta_alfabetizacao_2026"})
    census_year: int = 2022
    structural_year: int = 2010
    registry_year: int = 2020
    reference_month: int = 6
    state_run_group: str = "5300108"
    state_run_parent: str = "DF"

    @property
    def lag_years(self) -> list[int]:
        return [y - 1 for y in self.target_years]

    @property
    def edition_years(self) -> list[int]:
        return sorted({e for pair in self.editions.values() for e in pair})


class Store:
    """Sources and already built feature tables, seen by the builders."""

    def __init__(self, spark: SparkSession, catalog, config: StoreConfig | None = None,
                 root: str | None = None, staged: bool = False):
        self.spark, self.catalog, self.root, self.staged = spark, catalog, root, staged
        self.config = config or StoreConfig()
        self._built: dict[str, DataFrame] = {}

    def source(self, name: str) -> DataFrame:
        return self.catalog.table(name)

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def feature(self, name: str) -> DataFrame:
        """A feature table: as built in this run, as stored, or built on demand.

        A table built on demand is staged if asked for, so it is not computed once for its
        key check and again for its join.
        """
        if name not in self._built:
            if self.root:
                self._built[name] = self.spark.read.parquet(self.path(name))
            else:
                df = BUILDERS[name](self)
                self._built[name] = stage(df, name) if self.staged else df
        return self._built[name]

    def remember(self, name: str, df: DataFrame) -> None:
        self._built[name] = df


BUILDERS: dict[str, Callable[[Store], DataFrame]] = {}
LAYOUT: dict[str, tuple[list[str], list[str]]] = {}


def feature_table(name: str, partition_by: tuple[str, ...] = (), cluster_by: tuple[str, ...] = ()):
    """Register a builder. Registration order is dependency order."""
    def wrap(fn: Callable[[Store], DataFrame]):
        BUILDERS[name] = fn
        LAYOUT[name] = (list(partition_by), list(cluster_by))
        return fn
    return wrap


def materialize(store: Store, only: str | None = None) -> DataFrame:
    """Build and replace the feature tables in order; report rows and columns per table.

    ``only`` restricts the run to tables whose name starts with a prefix; later tables read
    earlier ones from storage. Rows are counted while writing.
    """
    import cohortlens.plans.base_table  # noqa: F401  (registers every builder)

    names = [n for n in BUILDERS if only is None or n.startswith(only)]
    if not names:
        raise ValueError(f"no feature table starts with {only!r}; known: {', '.join(BUILDERS)}")
    report = []
    for name in names:
        df = BUILDERS[name](store)
        by, cluster = LAYOUT[name]
        path = store.path(name)
        if by:
            n = write_partitioned(df, path, by, cluster)
        else:
            n = counted_write(df, lambda d, p=path: d.write.mode("overwrite").parquet(p))
        report.append((name, n, len(df.columns)))
        stored = store.spark.read.parquet(path).select(*df.columns)
        store.remember(name, stored)
    return store.spark.createDataFrame(report, "table string, n_rows bigint, n_columns int")
