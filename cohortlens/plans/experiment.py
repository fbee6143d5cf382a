"""Experiments: a validation design, its features, candidates, panel, strata and artefacts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import models, roles
from cohortlens.operators.joins import coverage_strata
from cohortlens.operators.metrics import panel_by_stratum
from cohortlens.operators.splits import assert_disjoint, group_split, stratified_sample, temporal_split
from cohortlens.sources.storage import save_model, save_scores, write_report


@dataclass(frozen=True)
class Columns:
    """Names of the roles in a base table."""

    row_id: str = "id_aluno"
    year: str = "ano"
    group: str = "id_municipio"
    parent: str = "sigla_uf"
    target: str = roles.TARGET


@dataclass(frozen=True)
class Design:
    """How rows are split, and whether lagged features can exist for the training rows."""

    split: Callable[[DataFrame, Columns, int, int, int], tuple[DataFrame, DataFrame]]
    allow_lagged: bool
    description: str = ""


def _temporal(df: DataFrame, c: Columns, train_year: int, test_year: int, seed: int):
    return temporal_split(df, c.year, train_year, test_year)


def _spatial(df: DataFrame, c: Columns, train_year: int, test_year: int, seed: int):
    # Only the later year has a year of history behind it.
    train, test = group_split(df.where(F.col(c.year) == test_year), c.group, 0.25, seed)
    assert_disjoint(train, test, c.group)
    return train, test


DESIGNS: dict[str, Design] = {
    "temporal": Design(_temporal, False, "train on one year, test on the next"),
    "spatial": Design(_spatial, True, "hold out a quarter of the groups within one year"),
}


@dataclass
class Experiment:
    """Results of a run."""

    panel: DataFrame
    strata: DataFrame
    scores: DataFrame
    models: Mapping
    features: list[str]
    dropped: dict[str, str]
    train: DataFrame
    test: DataFrame
    best: str = ""
    extra: dict = field(default_factory=dict)


def design(name: str) -> Design:
    if name not in DESIGNS:
        raise KeyError(f"unknown design: {name}; available: {', '.join(sorted(DESIGNS))}")
    return DESIGNS[name]


def prepare(base: DataFrame, name: str, columns: Columns = Columns(), train_year: int = 2023,
            test_year: int = 2024, sample: int | None = None, seed: int = 42,
            select: Callable[..., list[str]] = roles.select_features,
            learn_on: Callable[[DataFrame], DataFrame] | None = None):
    """Split, sample and choose features; every choice looks at training rows only.

    ``learn_on`` replaces the training rows by a part of them before features are judged.
    """
    d = design(name)
    train, test = d.split(models.labelled(base, columns.target), columns, train_year, test_year, seed)
    if sample:
        train = stratified_sample(train, "y", sample, columns.row_id, seed)
        test = stratified_sample(test, "y", sample, columns.row_id, seed)
    if learn_on:
        train = learn_on(train)
    wanted = [c for c in select(base.columns, allow_lagged=d.allow_lagged) if c != "y"]
    features, dropped = roles.drop_degenerate(train, wanted)
    return train, test, features, dropped


def run_experiment(base: DataFrame, name: str = "temporal", names: Sequence[str] | None = None,
                   columns: Columns = Columns(), train_year: int = 2023, test_year: int = 2024,
                   sample: int | None = None, params: Mapping[str, Mapping] | None = None,
                   save_to: str | None = None, seed: int = 42, min_stratum: int = 500,
                   select: Callable[..., list[str]] = roles.select_features,
                   exact_medians: bool = True) -> Experiment:
    """Train every candidate under one design, rank them, and judge the best by stratum.

    Training rows are cached while the candidates are fitted and released afterwards.
    """
    train, test, features, dropped = prepare(base, name, columns, train_year, test_year, sample,
                                             seed, select)
    names = list(names or models.CANDIDATES)
    keep = [columns.group, columns.parent]
    needed = list(dict.fromkeys([columns.row_id, "y", *keep, *features]))
    train_rows = train.select(*needed).persist()
    try:
        panel, scores, fitted = models.train_and_score(
            train_rows, test.select(*needed), features, names, columns.row_id, keep, params, seed,
            exact_medians)
        best = panel.first()["model"]
        labelled = coverage_strata(scores.where(F.col("model") == best), train_rows, columns.group,
                                   columns.parent)
        strata = panel_by_stratum(labelled, min_n=min_stratum)
        result = Experiment(panel, strata, scores, fitted, features, dropped, train, test, best)
        if save_to:
            persist_experiment(result, name, save_to)
    finally:
        train_rows.unpersist()
    return result


def persist_experiment(result: Experiment, name: str, folder: str) -> None:
    """Store panel, strata, feature list, scores and the best pipeline."""
    spark = result.panel.sparkSession
    write_report(result.panel, folder, f"metrics_{name}", "csv", single_file=True)
    write_report(result.strata, folder, f"metrics_{name}_by_stratum", "csv", single_file=True)
    rows = [(f, roles.block_of(f)) for f in result.features]
    write_report(spark.createDataFrame(rows, "feature string, block string"), folder,
                 f"features_{name}", "json", single_file=True)
    save_scores(result.scores, f"{folder}/scores_{name}")
    save_model(result.models[result.best], f"{folder}/model_{name}")
