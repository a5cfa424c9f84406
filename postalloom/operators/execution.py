"""Arbitrary callables over frames: batches, map and reduce."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_batches(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """``run`` over Arrow batches; rows carry their keys, so order cannot misalign results."""
    return df.mapInPandas(lambda frames: (run(f) for f in frames), schema)


def map_column(df: DataFrame, column: str, run: Callable[[pd.Series], pd.Series], kind, result: str | None = None) -> DataFrame:
    """A vectorised function of one column, into ``result`` or in place."""
    return df.withColumn(result or column, F.pandas_udf(run, kind)(F.col(column)))


def map_reduce(df: DataFrame, map_run: Callable[[pd.DataFrame], pd.DataFrame], reduce_run: Callable[[pd.DataFrame], pd.DataFrame], schema, fan_in: int = 64) -> DataFrame:
    """Maps batches, then reduces groups of at most about ``fan_in`` partial results until one is left.

    ``reduce_run`` must be associative: it turns partial rows into partial rows.
    """
    parts = df.mapInPandas(lambda frames: (map_run(f) for f in frames), schema)
    n = parts.rdd.getNumPartitions()
    while n > fan_in:
        n = -(-n // fan_in)
        parts = parts.coalesce(n).mapInPandas(lambda frames: _whole(frames, reduce_run), schema)
    return parts.coalesce(1).mapInPandas(lambda frames: _whole(frames, reduce_run), schema)


def _whole(frames, run):
    found = list(frames)
    if found:
        yield run(pd.concat(found, ignore_index=True))
