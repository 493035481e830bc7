"""Tables that several queries of a session share: each is written once for the state its source is in, so that no query repeats another's windows and nothing is persisted
in memory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidebar.sources.shared import drop_written, listed, written

_KEPT: dict[tuple, DataFrame] = {}


def shared_table(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """build()'s rows, written on the first call for a source folder and read on the others, until a file of the folder changes, comes or goes."""
    key = (spark.sparkContext.applicationId, source, name, tuple(listed(spark, source)))
    if key not in _KEPT:
        _KEPT[key] = written(build(), name)
    return _KEPT[key]


def drop_tables(spark: SparkSession) -> int:
    """Remove all written tables of this process; later queries write theirs again."""
    _KEPT.clear()
    return drop_written(spark)
