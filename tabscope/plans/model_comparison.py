"""Automated comparison: a leaderboard for a target column, and its winner."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from tabscope.operators.compare import Experiment, compare_classifiers, compare_regressors, fit_best, set_up


@dataclass
class ComparisonReport:
    """The candidates in order, and the best one fitted on all training rows."""

    experiment: Experiment
    leaderboard: DataFrame
    model: PipelineModel


def comparison_report(
    df: DataFrame, target: str, domain: str, key: list[str], folds: int = 10, hashed: list[str] | None = None, **options
) -> ComparisonReport:
    """'Classification' compares classifiers; any other domain compares regressors."""
    experiment = set_up(df, target, key, hashed=hashed)
    compare = compare_classifiers if domain == "Classification" else compare_regressors
    board = compare(experiment, folds, **options)
    return ComparisonReport(experiment, board, fit_best(experiment, board, options.get("candidates")))
