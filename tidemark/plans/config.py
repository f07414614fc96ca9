"""Options of generator and loader, checked when they are made."""

from __future__ import annotations

import secrets
import string
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date
from enum import Enum

from ..functions.distributions import ZIPF_SHAPE, distribution_matrix, padded
from ..operators.merge import MergeMode, MergeSpec, condition_columns


class OperationType(Enum):
    UPSERT = "upsert"
    INSERT = "insert"
    BULK_INSERT = "bulk_insert"


class StorageFormat(Enum):
    ICEBERG = "iceberg"
    DELTA = "delta"
    HUDI = "hudi"
    PARQUET = "parquet"
    #: the library's own transactional parquet table
    SNAPSHOT = "snapshot"


class ApiType(Enum):
    DATASOURCE = "spark-datasource"
    SQL = "spark-sql"


class WriteMode(Enum):
    COPY_ON_WRITE = "copy-on-write"
    MERGE_ON_READ = "merge-on-read"


class KeyType(Enum):
    RANDOM = "Random"
    TEMPORALLY_ORDERED = "TemporallyOrdered"


class UpdatePattern(Enum):
    UNIFORM = "Uniform"
    ZIPF = "Zipf"


def experiment_id() -> str:
    """Ten letters and digits, safe in paths and identifiers."""
    return "".join(secrets.choice(string.ascii_lowercase + string.digits) for _ in range(10))


@dataclass(frozen=True)
class GeneratorConfig:
    path: str
    rounds: int = 10
    records_per_round: Sequence[int] = (1_000_000,)
    columns: int = 10
    record_size: int = 1024
    update_ratio: float = 0.5
    #: -1: one partition, or the matrix's width
    total_partitions: int = -1
    file_size: int = 134_217_728
    skip_if_exists: bool = False
    start_round: int = 0
    key_type: KeyType = KeyType.RANDOM
    update_pattern: UpdatePattern = UpdatePattern.UNIFORM
    #: newest partitions that updates come from; -1: no updates; "all": every partition
    partitions_to_update: int | str = -1
    zipf_shape: float = ZIPF_SHAPE
    matrix: Sequence[Sequence[float]] | None = None
    seed: int = 378294793957830
    anchor_date: date = date(2025, 1, 1)
    #: epoch millis of round 0; each later round is a minute later
    start_ts: int = 1_735_689_600_000

    def __post_init__(self) -> None:
        if not self.path:
            raise ValueError("the output path is empty")
        if self.columns < 5:
            raise ValueError("five columns at least")
        if self.rounds < 1 or self.start_round < 0 or self.record_size < 1 or self.file_size < 1:
            raise ValueError("rounds, record size and file size must be positive")
        if not 0 <= self.update_ratio <= 1:
            raise ValueError("the update ratio must lie between 0 and 1")
        if not self.records_per_round or min(self.records_per_round) < 0:
            raise ValueError("numbers of records must not be negative")
        if self.updated > self.partitions:
            raise ValueError("cannot update more partitions than there are")
        if self.partitions_to_update == -1 and self.update_ratio > 0 and self.rounds > 1:
            warnings.warn("partitions_to_update is -1: no updates are generated", stacklevel=3)
        self.weights  # checks the matrix  # noqa: B018

    @property
    def partitions(self) -> int:
        return self.total_partitions if self.total_partitions > 0 else len(self.matrix[0]) if self.matrix else 1

    @property
    def updated(self) -> int:
        if isinstance(self.partitions_to_update, str):
            if self.partitions_to_update != "all":
                raise ValueError("partitions_to_update is a number or all")
            return self.partitions
        return self.partitions_to_update

    @property
    def counts(self) -> list[int]:
        """Records of each round of this run, the last number repeating."""
        return padded(self.records_per_round, self.rounds)

    @property
    def weights(self) -> list[list[float]]:
        return distribution_matrix(self.rounds, self.total_partitions if self.matrix else self.partitions, self.matrix)


@dataclass(frozen=True)
class LoaderConfig:
    input_path: str
    output_path: str
    rounds: int = 10
    format: StorageFormat = StorageFormat.SNAPSHOT
    initial_operation: OperationType = OperationType.BULK_INSERT
    operation: OperationType = OperationType.UPSERT
    api: ApiType = ApiType.DATASOURCE
    initial_options: Mapping[str, str] = field(default_factory=dict)
    options: Mapping[str, str] = field(default_factory=dict)
    non_partitioned: bool = False
    experiment_id: str = field(default_factory=experiment_id)
    start_round: int = 0
    catalog: str = "spark_catalog"
    database: str = "default"
    extra_condition_columns: Sequence[str] = ()
    merge_mode: MergeMode = MergeMode.UPDATE_INSERT
    update_columns: Sequence[str] = ()
    write_mode: WriteMode = WriteMode.COPY_ON_WRITE
    async_compaction: bool = False
    compaction_frequency: int = 3
    run_final_compaction: bool = True
    max_retries: int = 5
    min_file_size: int = 104_857_600
    target_file_size: int = 125_829_120
    delta_optimize_write: bool = True
    cache_input: bool = False
    overwrite: bool = True
    duplicates: str = "raise"

    def __post_init__(self) -> None:
        if not self.input_path or not self.output_path:
            raise ValueError("input and output path are needed")
        if self.api is ApiType.SQL and self.format is not StorageFormat.HUDI:
            raise ValueError("spark-sql is for hudi only")
        if self.format is StorageFormat.PARQUET and OperationType.UPSERT in (self.operation, self.initial_operation):
            raise ValueError("plain parquet cannot upsert")
        if self.format is StorageFormat.HUDI and self.api is ApiType.DATASOURCE:
            if self.merge_mode is MergeMode.DELETE_INSERT:
                raise ValueError("the hudi datasource has no delete-insert")
            if self.update_columns:
                raise ValueError("the hudi datasource updates all columns")
            if self.extra_condition_columns:
                raise ValueError("the hudi datasource matches by its record key")
        if self.compaction_frequency < 1 or self.max_retries < 0 or self.rounds < 1:
            raise ValueError("rounds and compaction frequency must be positive, retries not negative")

    @property
    def spec(self) -> MergeSpec:
        return MergeSpec(condition_columns(not self.non_partitioned, tuple(self.extra_condition_columns)), self.merge_mode, tuple(self.update_columns), self.duplicates)

    def operation_of(self, round_no: int) -> OperationType:
        return self.initial_operation if round_no == 0 else self.operation

    def options_of(self, round_no: int) -> dict[str, str]:
        return dict(self.initial_options if round_no == 0 else self.options)

    def save_mode(self, round_no: int) -> str:
        return "overwrite" if round_no == 0 and self.overwrite else "append"

    @property
    def compaction_enabled(self) -> bool:
        return self.async_compaction and self.format is not StorageFormat.PARQUET
