"""The evaluated population: the only rows whose label says something."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluated_population(df: DataFrame, present: str, completed: str, source: str, target: str,
                         accepted: str = "batch", hidden: Sequence[str] = ()) -> DataFrame:
    """Units that were present, completed the test and come from the accepted source.

    Elsewhere the label is deterministic. The flags and the hidden score, which define the
    label, are not passed on. Every predicate is a plain comparison on the scan.
    """
    kept = df.where(F.col(present) & F.col(completed) & (F.col(source) == accepted)
                    & F.col(target).isNotNull())
    return kept.drop(present, completed, source, *hidden)
