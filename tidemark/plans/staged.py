"""Loading by hand, a step at a time: stage a round's folder under a name and schema, then insert or merge it."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.merge import MergeSpec, condition_columns
from ..sources.files import external_view
from ..sources.snapshot import SnapshotTable

log = logging.getLogger(__name__)


def stage_round(spark: SparkSession, path: str, round_no: int, schema: StructType, name: str = "stage") -> DataFrame:
    """The round as a view <name>_<round>: columns by name and type, nothing copied."""
    return external_view(spark, f"{path}/{round_no}", f"{name}_{round_no}", schema)


def insert_staged(table: SnapshotTable, staged: DataFrame, round_no: int, *, partition_by: str | None = "partition", merge_on_read: bool = False) -> None:
    """The first insert makes the table; a round is inserted once."""
    if table.exists():
        table.append(staged, f"round-{round_no}")
    else:
        table.create(staged, partition_by=partition_by, merge_on_read=merge_on_read, token=f"round-{round_no}")


def merge_staged(table: SnapshotTable, staged: DataFrame, round_no: int, spec: MergeSpec | None = None) -> bool:
    """Update-insert on key and partition, or by the spec; a round is merged once."""
    return table.merge(staged, spec or MergeSpec(condition_columns(True)), f"round-{round_no}")


def run_sql(spark: SparkSession, statement: str, show: int = 0) -> DataFrame:
    """Runs a statement, logs it with its time, and shows rows if wanted."""
    start = time.perf_counter()
    out = spark.sql(statement)
    if show:
        out.show(show, truncate=False)
    log.info("%.3f s: %s", time.perf_counter() - start, statement)
    return out
