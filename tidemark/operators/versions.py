"""Latest versions of records, and re-attaching payload to chosen ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_version(history: DataFrame, key: str | Sequence[str] = "key", round_col: str = "round") -> DataFrame:
    """All rows of each key's last round, ties included. The rank filter runs before and after the shuffle (WindowGroupLimit)."""
    keys = [key] if isinstance(key, str) else list(key)
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(round_col)))
    return history.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def narrow(history: DataFrame, columns: Sequence[str] = ("key", "partition", "round")) -> DataFrame:
    """The columns that decide which rows are taken; payload follows in rejoin()."""
    return history.select(*columns)


def rejoin(full: DataFrame, ids: DataFrame, on: Sequence[str] = ("key", "partition", "round")) -> DataFrame:
    """The full rows of the chosen ids."""
    return full.join(ids.select(*on), list(on), "inner")
