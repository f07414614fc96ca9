"""Filters, projections, counts, unions and physical layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import generators as g


def in_partitions(df: DataFrame, partitions: Sequence[str], column: str = "partition") -> DataFrame:
    """Pushed to the scan as an IN filter."""
    return df.where(F.col(column).isin(list(partitions)))


def newest(partitions: Sequence[str], k: int) -> list[str]:
    """The first k of partitions in order from the newest."""
    return list(partitions[:k])


def partition_counts(df: DataFrame, column: str = "partition") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("rows"))


def rewrite_payload(df: DataFrame, round_no: int, ts: int, seed: int | str = 0, key: str = "key", salt: Column | None = None) -> DataFrame:
    """An update of each record: key and partition stay, round and ts are new, every payload field gets a value by its name's prefix.

    One projection for all columns, however many there are.
    """
    ident = F.col(key) if salt is None else salt

    def value(c: str) -> Column:
        mark = g.salted(seed, round_no, c, ident)
        if c == "round":
            return F.lit(round_no)
        if c == "ts":
            return F.lit(ts).cast("long")
        if c.startswith("textField"):
            return g.uuid_of(mark)
        if c.startswith("longField"):
            return F.shiftrightunsigned(g.whole(mark), 1)
        if c.startswith("decimalField"):
            return g.unit(mark).cast("float")
        if c.startswith("intField"):
            return F.shiftrightunsigned(g.whole(mark), 33).cast("int")
        return F.col(c)

    return df.select(*(value(c).alias(c) for c in df.columns))


def union_changes(inserts: DataFrame, updates: DataFrame) -> DataFrame:
    """By name, all rows."""
    return inserts.unionByName(updates)


def clustered(df: DataFrame, columns: Sequence[str] = ("partition", "key")) -> DataFrame:
    """Globally sorted, for a bulk load whose files cover narrow ranges."""
    return df.sort(*columns)


def spread(df: DataFrame, files: int) -> DataFrame:
    return df.repartition(files)


def by_partition(df: DataFrame, column: str = "partition") -> DataFrame:
    """Rows of a partition together, large partitions in several tasks: adaptive execution splits and joins them by size."""
    return df.hint("rebalance", column)
