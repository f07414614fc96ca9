"""Command lines: `python -m tidemark.plans.cli generate|load ...`."""

from __future__ import annotations

import argparse
import sys
from datetime import date

from pyspark.sql import SparkSession

from ..operators.merge import MergeMode
from .config import ApiType, GeneratorConfig, KeyType, LoaderConfig, OperationType, StorageFormat, UpdatePattern, WriteMode, experiment_id
from .datagen import ChangeDataGenerator
from .loader import IncrementalLoader


def _flag(value: str) -> bool:
    if value.lower() in ("true", "yes", "1"):
        return True
    if value.lower() in ("false", "no", "0"):
        return False
    raise argparse.ArgumentTypeError(f"not a boolean: {value}")


def _numbers(value: str) -> list[int]:
    return [int(x) for x in value.split(",")]


def _names(value: str) -> list[str]:
    return [x for x in value.split(",") if x]


def _pairs(values: list[str] | None) -> dict[str, str]:
    """k=v, several of them by commas, spaces or repeated flags."""
    out = {}
    for x in (p for v in values or [] for p in v.split(",") if p):
        k, eq, v = x.partition("=")
        if not eq:
            raise ValueError(f"not key=value: {x}")
        out[k] = v
    return out


def _updated(value: str) -> int | str:
    return value if value == "all" else int(value)


def generator_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("generate")
    p.add_argument("-p", "--path", required=True)
    p.add_argument("--number-rounds", type=int, default=10)
    p.add_argument("--number-records-per-round", type=_numbers, default=[1_000_000])
    p.add_argument("--number-columns", type=int, default=10)
    p.add_argument("--record-size", type=int, default=1024)
    p.add_argument("--update-ratio", type=float, default=0.5)
    p.add_argument("--total-partitions", type=int, default=-1)
    p.add_argument("--datagen-file-size", type=int, default=134_217_728)
    p.add_argument("--skip-if-exists", type=_flag, default=False)
    p.add_argument("--start-round", type=int, default=0)
    p.add_argument("--update-pattern", type=UpdatePattern, default=UpdatePattern.UNIFORM)
    p.add_argument("--primary-key-type", type=KeyType, default=KeyType.RANDOM)
    p.add_argument("--num-partitions-to-update", type=_updated, default=-1)
    p.add_argument("--zipfian-shape", type=float, default=2.93)
    p.add_argument("--anchor-date", type=date.fromisoformat, default=date(2025, 1, 1))
    p.add_argument("--seed", type=int, default=GeneratorConfig.seed)
    return p


def loader_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("load")
    p.add_argument("--number-rounds", type=int, default=10)
    p.add_argument("-i", "--input-path", required=True)
    p.add_argument("-o", "--output-path", required=True)
    p.add_argument("--format", type=StorageFormat, default=StorageFormat.HUDI)
    p.add_argument("--initial-operation-type", type=OperationType, default=OperationType.BULK_INSERT)
    p.add_argument("--operation-type", type=OperationType, default=OperationType.UPSERT)
    p.add_argument("--api-type", type=ApiType, default=ApiType.DATASOURCE)
    p.add_argument("--initial-options", nargs="*", action="extend")
    p.add_argument("--options", nargs="*", action="extend")
    p.add_argument("--non-partitioned", type=_flag, default=False, nargs="?", const=True)
    p.add_argument("-e", "--experiment-id", default=None)
    p.add_argument("--start-round", type=int, default=0)
    p.add_argument("--catalog", default="spark_catalog")
    p.add_argument("--database", default="default")
    p.add_argument("--additional-merge-condition-columns", type=_names, default=[])
    p.add_argument("--merge-mode", type=MergeMode, default=MergeMode.UPDATE_INSERT)
    p.add_argument("--update-columns", type=_names, default=[])
    p.add_argument("--write-mode", type=WriteMode, default=WriteMode.COPY_ON_WRITE)
    p.add_argument("--async-compaction", type=_flag, default=False, nargs="?", const=True)
    p.add_argument("--compaction-frequency-commits", type=int, default=3)
    p.add_argument("--run-final-compaction", type=_flag, default=True)
    p.add_argument("--max-retries", type=int, default=5)
    p.add_argument("--compaction-min-file-size", type=int, default=104_857_600)
    p.add_argument("--compaction-target-file-size", type=int, default=125_829_120)
    p.add_argument("--delta-optimize-write", type=_flag, default=True)
    return p


def generator_config(argv: list[str]) -> GeneratorConfig:
    a = generator_parser().parse_args(argv)
    return GeneratorConfig(a.path, a.number_rounds, a.number_records_per_round, a.number_columns, a.record_size, a.update_ratio, a.total_partitions, a.datagen_file_size, a.skip_if_exists, a.start_round, a.primary_key_type, a.update_pattern, a.num_partitions_to_update, a.zipfian_shape, None, a.seed, a.anchor_date)


def loader_config(argv: list[str]) -> LoaderConfig:
    a = loader_parser().parse_args(argv)
    return LoaderConfig(
        a.input_path, a.output_path, a.number_rounds, a.format, a.initial_operation_type, a.operation_type, a.api_type, _pairs(a.initial_options), _pairs(a.options), a.non_partitioned, a.experiment_id or experiment_id(),
        a.start_round, a.catalog, a.database, a.additional_merge_condition_columns, a.merge_mode, a.update_columns, a.write_mode, a.async_compaction, a.compaction_frequency_commits, a.run_final_compaction, a.max_retries,
        a.compaction_min_file_size, a.compaction_target_file_size, a.delta_optimize_write,
    )


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if not argv or argv[0] not in ("generate", "load"):
        print(__doc__, file=sys.stderr)
        return 1
    try:
        config = (generator_config if argv[0] == "generate" else loader_config)(argv[1:])
    except SystemExit as e:
        return 1 if e.code else 0
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName(f"tidemark {argv[0]}").getOrCreate()
    if argv[0] == "generate":
        ChangeDataGenerator(spark, config).generate_workload()
    else:
        print(IncrementalLoader(spark, config).run().text())
    return 0


if __name__ == "__main__":
    sys.exit(main())
