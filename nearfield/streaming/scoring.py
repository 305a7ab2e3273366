"""Scoring a stream of queries with a fitted index: stateless, so any trigger and output mode will do."""

from __future__ import annotations

from pyspark.sql import DataFrame

from nearfield.operators.index import NearestNeighborIndex


def score(stream: DataFrame, index: NearestNeighborIndex) -> DataFrame:
    """(query_id, ref_id, dist) of a streaming DataFrame of queries; the index tables are static and fit in one
    broadcast, which is checked."""
    if not stream.isStreaming:
        raise ValueError("score takes a streaming DataFrame; use transform for a static one")
    return index.transform(stream)
