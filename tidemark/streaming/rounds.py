"""Rounds as a stream: every file that appears is part of a micro-batch, merged into a snapshot table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.merge import MergeSpec
from ..sources.snapshot import SnapshotTable


def stream_rounds(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(path)


def merge_stream(changes: DataFrame, table: SnapshotTable, spec: MergeSpec, checkpoint: str, *, partition_by: str | None = None, merge_on_read: bool = False, query: str = "merge") -> StreamingQuery:
    """Merges each micro-batch once: its number is the commit's token, so a batch that Spark repeats after a failure changes nothing.

    Files of one round may come in several batches, so their keys must not repeat within a round.
    """

    def put(batch: DataFrame, number: int) -> None:
        token = f"{query}-{number}"
        if table.exists():
            table.merge(batch, spec, token)
        else:
            table.create(batch, partition_by=partition_by, merge_on_read=merge_on_read, token=token)

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
