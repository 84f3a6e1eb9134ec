"""Scoring of feature rows that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.classify import nearest_centroid


def score_stream(train: DataFrame, stream: DataFrame) -> DataFrame:
    """Nearest-centroid predictions for a streaming ``stream`` of wide features; the
    model is fitted on the static ``train`` rows. Stateless: output mode append."""
    return nearest_centroid(train, stream)
