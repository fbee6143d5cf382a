"""Decision outputs: scored units to rankings, profiles, target risk and short lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import decide
from cohortlens.operators.aggregates import aggregate_groups
from cohortlens.operators.models import labelled, score
from cohortlens.plans.experiment import Columns
from cohortlens.session import stage
from cohortlens.sources.storage import write_report

GOAL = "mun_lag_meta_ano_alvo"


def decision_outputs(model: PipelineModel, test: DataFrame, columns: Columns = Columns(),
                     labels: Sequence[str] = ("nome_municipio", "ter_regiao"), segment: str = "alu_rede",
                     variables: Sequence[str] = tuple(decide.PROFILE_VARIABLES), goal: str = GOAL,
                     clusters: int = 5, min_n: int = 30, report_min_n: int = 100,
                     save_to: str | None = None) -> Mapping[str, DataFrame]:
    """Everything a decision maker gets from one trained model and its test rows.

    Unit rows are scored once and reduced to group grain; that small table is staged and all
    further outputs read it. Without agreed targets the target outputs are left out.
    """
    rows = test if "y" in test.columns else labelled(test, columns.target)
    scored = score(model, rows, [columns.row_id, columns.group, columns.parent, "y", *labels])
    ranking = stage(decide.group_risk_ranking(
        scored, columns.group, columns.parent, labels=labels, min_n=min_n), "ranking")
    context = [v for v in variables if v in rows.columns]
    groups = stage(aggregate_groups(rows, [columns.group], segment, "y", context, min_n=min_n), "groups")
    clustered = stage(decide.cluster_groups(groups, columns.group, context, "y", clusters), "clusters")
    profile = decide.cluster_profile(clustered, context, "y")
    out: dict[str, DataFrame] = {
        "ranking": ranking, "calibration": decide.aggregate_calibration(ranking),
        "clusters": clustered, "cluster_profile": profile,
        "cluster_traits": decide.characterize(profile, context)}
    risk = None
    if goal in rows.columns and rows.where(F.col(goal).isNotNull()).limit(1).count():
        risk = stage(decide.target_miss_risk(
            ranking, rows.select(columns.group, goal), columns.group, goal), "target-risk")
        out["target_risk"] = risk
    out.update(decide.decision_report(ranking, risk, columns.group, columns.parent, report_min_n))
    if save_to:
        for name, df in out.items():
            write_report(df, save_to, name, "csv")
    return out
