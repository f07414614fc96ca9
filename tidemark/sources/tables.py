"""Table formats behind one protocol: create, append, merge, read, compact.

`snapshot` and `parquet` run everywhere. Delta, Iceberg and Hudi need their packages on the class path; without them a
write fails with Spark's own DATA_SOURCE_NOT_FOUND. What they send to Spark is in `statements`, which tests hold against the text
expected, since the packages are not here.
"""

from __future__ import annotations

from collections.abc import Mapping
from contextlib import contextmanager
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..operators.merge import MergeMode, MergeSpec
from ..operators.shape import by_partition
from ..plans.config import ApiType, LoaderConfig, OperationType, StorageFormat, WriteMode
from . import catalog as c
from .files import Files
from .snapshot import SnapshotTable


class TableFormat(Protocol):
    def prepare(self, df: DataFrame, round_no: int) -> None: ...

    def write(self, df: DataFrame, operation: OperationType, round_no: int, options: Mapping[str, str]) -> None: ...

    def read(self) -> DataFrame: ...

    def compact(self, force: bool = False) -> bool: ...

    @property
    def compaction_every(self) -> int: ...


@contextmanager
def scoped(spark: SparkSession, settings: Mapping[str, str]):
    """Session settings that are put back afterwards."""
    was = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Base:
    def __init__(self, spark: SparkSession, config: LoaderConfig):
        self.spark, self.config = spark, config
        self.name = c.table_name(config.format.value, config.catalog, config.database, config.experiment_id)
        self.path = c.table_path(config.output_path, self.name)
        self.partition_by = None if config.non_partitioned else "partition"
        self.statements: list[str] = []

    def prepare(self, df: DataFrame, round_no: int) -> None:
        pass

    def compact(self, force: bool = False) -> bool:
        return False

    @property
    def compaction_every(self) -> int:
        """Commits from one look for work to the next."""
        return self.config.compaction_frequency

    def sql(self, statement: str) -> DataFrame:
        self.statements.append(statement)
        return self.spark.sql(statement)

    @property
    def spec(self) -> MergeSpec:
        return self.config.spec

    def merge_sql(self, view: str) -> str:
        return c.merge_from(self.name, view, self.spec.on, self.spec.mode is MergeMode.DELETE_INSERT, self.spec.update_columns)


class ParquetFormat(_Base):
    """A folder of files that only grows."""

    def write(self, df: DataFrame, operation: OperationType, round_no: int, options: Mapping[str, str]) -> None:
        if operation is OperationType.UPSERT:
            raise ValueError("plain parquet cannot upsert")
        df.write.mode(self.config.save_mode(round_no)).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


class SnapshotFormat(_Base):
    def __init__(self, spark: SparkSession, config: LoaderConfig):
        super().__init__(spark, config)
        self.table = SnapshotTable(spark, self.path)

    def write(self, df: DataFrame, operation: OperationType, round_no: int, options: Mapping[str, str]) -> None:
        token = f"round-{round_no}"
        rows = by_partition(df) if self.partition_by and round_no else df
        if round_no == self.config.start_round and not self.table.exists():
            self.table.create(rows, partition_by=self.partition_by, merge_on_read=self.config.write_mode is WriteMode.MERGE_ON_READ, token=token)
        elif round_no == 0 and self.config.overwrite:
            if token not in self.table.manifest().tokens or len(self.table.manifest().tokens) > 1:
                self.table.create(rows, partition_by=self.partition_by, merge_on_read=self.config.write_mode is WriteMode.MERGE_ON_READ, token=token, replace=True)
        elif operation is OperationType.UPSERT:
            self.table.merge(rows, self.spec, token)
        else:
            self.table.append(rows, token)

    def read(self) -> DataFrame:
        return self.table.read()

    def compact(self, force: bool = False) -> bool:
        return self.table.compact(self.config.min_file_size, self.config.target_file_size)


class DeltaFormat(_Base):
    def write(self, df: DataFrame, operation: OperationType, round_no: int, options: Mapping[str, str]) -> None:
        if operation is not OperationType.UPSERT:
            writer = df.write.format("delta").mode(self.config.save_mode(round_no))
            if self.partition_by:
                writer = writer.partitionBy(self.partition_by)
            if self.config.write_mode is WriteMode.MERGE_ON_READ:
                writer = writer.option("delta.enableDeletionVectors", "true")
            writer.options(**options).save(self.path)
            return
        from delta.tables import DeltaTable

        if not DeltaTable.isDeltaTable(self.spark, self.path):
            raise ValueError(f"no delta table at {self.path}")
        on = " AND ".join(f"t.{c.quoted(x)} = s.{c.quoted(x)}" for x in self.spec.on)
        settings = {"spark.databricks.delta.optimizeWrite.enabled": str(self.config.delta_optimize_write).lower()} if self.partition_by else {}
        with scoped(self.spark, settings):
            builder = DeltaTable.forPath(self.spark, self.path).alias("t").merge(df.alias("s"), on)
            if self.spec.mode is MergeMode.DELETE_INSERT:
                builder = builder.whenMatchedDelete()
            elif self.spec.update_columns:
                builder = builder.whenMatchedUpdate(set={x: f"s.{c.quoted(x)}" for x in self.spec.update_columns})
            else:
                builder = builder.whenMatchedUpdateAll()
            builder.whenNotMatchedInsertAll().execute()

    def read(self) -> DataFrame:
        return self.spark.read.format("delta").load(self.path)

    def compact(self, force: bool = False) -> bool:
        sizes = {"spark.databricks.delta.optimize.minFileSize": str(self.config.min_file_size), "spark.databricks.delta.optimize.maxFileSize": str(self.config.target_file_size)}
        with scoped(self.spark, sizes):
            self.sql(f"OPTIMIZE delta.`{self.path}`")
        return True


class IcebergFormat(_Base):
    def properties(self) -> dict[str, str]:
        mode = self.config.write_mode.value
        own = {f"write.{x}.mode": mode for x in ("delete", "update", "merge")}
        if self.config.write_mode is WriteMode.MERGE_ON_READ and self.config.async_compaction:
            own["write.target-file-size-bytes"] = str(self.config.target_file_size)
        return own | dict(self.config.initial_options)

    def prepare(self, df: DataFrame, round_no: int) -> None:
        if round_no == self.config.start_round:
            if round_no == 0:
                self.sql(c.drop_table(self.name, purge=True))
            self.sql(c.create_table(self.name, df.schema, "iceberg", self.path, partition_by=self.partition_by, properties=self.properties()))
        if round_no >= 1 and self.partition_by:
            self.sql(c.set_properties(self.name, {"write.distribution-mode": "hash"}))

    def write(self, df: DataFrame, operation: OperationType, round_no: int, options: Mapping[str, str]) -> None:
        df.createOrReplaceTempView("source")
        self.sql(self.merge_sql("source") if operation is OperationType.UPSERT else c.insert_from(self.name, "source"))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def compact(self, force: bool = False) -> bool:
        options = f"map('min-file-size-bytes', '{self.config.min_file_size}', 'target-file-size-bytes', '{self.config.target_file_size}')"
        table = c.text(self.name.split(".", 1)[1])
        self.sql(f"CALL {c.quoted(self.config.catalog)}.system.rewrite_data_files(table => {table}, strategy => 'binpack', options => {options})")
        return True


class HudiFormat(_Base):
    def options(self, operation: OperationType, given: Mapping[str, str]) -> dict[str, str]:
        kind = {WriteMode.COPY_ON_WRITE: "COPY_ON_WRITE", WriteMode.MERGE_ON_READ: "MERGE_ON_READ"}[self.config.write_mode]
        own = {
            "hoodie.table.name": self.name.rsplit(".", 1)[-1],
            "hoodie.datasource.write.recordkey.field": "key",
            "hoodie.datasource.write.partitionpath.field": self.partition_by or "",
            "hoodie.datasource.write.operation": operation.value,
            "hoodie.datasource.write.table.type": kind,
        }
        return own | dict(given) | self.service_options()

    def service_options(self) -> dict[str, str]:
        """For the writer and the service alike: they work on one timeline. These win over given options."""
        if not self.config.compaction_enabled or self.config.write_mode is not WriteMode.MERGE_ON_READ:
            return {}
        return {
            "hoodie.compact.inline": "false",
            "hoodie.compact.schedule.inline": "true",
            "hoodie.compact.inline.max.delta.commits": str(self.config.compaction_frequency),
            "hoodie.write.concurrency.mode": "optimistic_concurrency_control",
            "hoodie.cleaner.policy.failed.writes": "LAZY",
            "hoodie.write.lock.provider": "org.apache.hudi.client.transaction.lock.InProcessLockProvider",
        }

    def prepare(self, df: DataFrame, round_no: int) -> None:
        if self.config.api is ApiType.SQL and round_no == self.config.start_round:
            if round_no == 0:
                self.sql(c.drop_table(self.name))
                # the table is external, so its files outlive it
                Files(self.spark, self.path).delete()
            kind = "cow" if self.config.write_mode is WriteMode.COPY_ON_WRITE else "mor"
            self.sql(c.create_table(self.name, df.schema, "hudi", self.path, partition_by=self.partition_by, properties={"primaryKey": "key", "type": kind} | dict(self.config.initial_options)))

    def write(self, df: DataFrame, operation: OperationType, round_no: int, options: Mapping[str, str]) -> None:
        if self.config.api is ApiType.DATASOURCE:
            df.write.format("hudi").options(**self.options(operation, options)).mode(self.config.save_mode(round_no)).save(self.path)
            return
        df.createOrReplaceTempView("source")
        if props := dict(options) | self.service_options():
            self.sql(c.set_properties(self.name, props))
        if operation is OperationType.UPSERT:
            self.sql(self.merge_sql("source"))
        else:
            self.sql(f"SET hoodie.spark.sql.insert.into.operation = {operation.value}")
            self.sql(c.insert_from(self.name, "source"))

    def read(self) -> DataFrame:
        return self.spark.read.format("hudi").load(self.path)

    @property
    def compaction_every(self) -> int:
        """The writer plans compactions by its own count of commits; one may wait after any of them."""
        return 1

    def pending(self) -> str | None:
        """The oldest compaction instant that waits; None if there is none or the timeline can't be read."""
        try:
            rows = self.sql(f"CALL show_compaction(path => {c.text(self.path)})").where("lower(state) = 'requested'").orderBy("timestamp").take(1)
        except Exception:  # noqa: BLE001
            return None
        return rows[0]["timestamp"] if rows else None

    def compact(self, force: bool = False) -> bool:
        instant = self.pending()
        if instant is None:
            return False
        self.sql(f"CALL run_compaction(op => 'run', path => {c.text(self.path)}, timestamp => {instant})")
        return True


FORMATS = {
    StorageFormat.PARQUET: ParquetFormat,
    StorageFormat.SNAPSHOT: SnapshotFormat,
    StorageFormat.DELTA: DeltaFormat,
    StorageFormat.ICEBERG: IcebergFormat,
    StorageFormat.HUDI: HudiFormat,
}


def table_format(spark: SparkSession, config: LoaderConfig) -> TableFormat:
    return FORMATS[config.format](spark, config)
