"""The detection job: readings to scores, flags and numbered anomalies, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.timeaxis import TimeAxis
from ..operators import baseline, detectors, events, forest, grid
from ..params import Params


def score_readings(
    readings: DataFrame, sensors: DataFrame, axis: TimeAxis, params: Params, peers: bool = True, with_forest: bool = True
) -> DataFrame:
    """Grid, baseline, z and (optionally) the isolation score of every gridded reading."""
    scores = baseline.fit_baseline(grid.to_cells(readings, axis), sensors, axis, params, peers)
    return forest.with_forest_scores(scores, params) if with_forest else scores


def flag_readings(scores: DataFrame, thresholds: DataFrame, params: Params) -> DataFrame:
    return detectors.with_flags(scores, thresholds, params)


def detect(
    readings: DataFrame,
    sensors: DataFrame,
    thresholds: DataFrame,
    axis: TimeAxis,
    params: Params,
    peers: bool = True,
    with_forest: bool = True,
) -> DataFrame:
    """Numbered, explained anomalies."""
    flags = flag_readings(score_readings(readings, sensors, axis, params, peers, with_forest), thresholds, params)
    return events.number_anomalies(events.with_explanation(events.find_events(flags, axis, params)))
