"""Traces as streams: consecutive repeats dropped with one call of state a script, and running one-gram counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import symbol

CALLS = "script string, seq long, symbol string, argument string, value string"


def read(spark, path: str) -> DataFrame:
    return spark.readStream.schema(CALLS).json(path)


def _unrepeated(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get if state.exists else (None, None, False)
    calls = pd.concat(list(parts)).sort_values("seq")
    keep = []
    for s, v in zip(calls["symbol"], calls["value"]):
        now = (None if pd.isna(s) else s, None if pd.isna(v) else v, True)
        keep.append(now != tuple(last))
        last = now
    state.update(last)
    yield calls[keep]


def without_repeats(calls: DataFrame) -> DataFrame:
    """Calls that differ from the one before them in their script; a micro-batch's calls of a script are taken in order of seq and follow those of earlier batches."""
    return calls.groupBy("script").applyInPandasWithState(_unrepeated, CALLS, "symbol string, value string, seen boolean", "append", GroupStateTimeout.NoTimeout)


def onegrams(calls: DataFrame) -> DataFrame:
    return calls.where("symbol is not null").groupBy("script", symbol(F.col("symbol")).alias("symbol")).agg(F.count("*").alias("n"))
