"""All queries of the analytics library, with their SQL."""

from __future__ import annotations

from . import beats, features, gaze, kernels, models, pose, series, tabular


def queries() -> dict:
    return series.Q | tabular.Q | kernels.Q | pose.Q | features.Q | models.Q | beats.Q | gaze.Q


def oracle_sql() -> dict:
    return series.SQL | tabular.SQL | kernels.SQL | pose.SQL | features.SQL | models.SQL | beats.SQL | gaze.SQL
