"""Queries are batch: de-duplication and joins of several aggregates have no streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_batch(df: DataFrame, name: str) -> DataFrame:
    if df.isStreaming:
        raise ValueError(f"model {name} reads a stream; write it to a table and query that, for example in foreachBatch")
    return df
