"""Three usual workloads, at full size or scaled down: a fact table, a dimension, and a stream of events."""

from __future__ import annotations

from .config import GeneratorConfig, UpdatePattern


def _sized(first: int, later: int, scale: float) -> tuple[int, int]:
    return max(1, int(first * scale)), max(1, int(later * scale))


def _newest(partitions: int, shares: list[float]) -> list[list[float]]:
    """Round 0 over all partitions alike; later rounds by `shares` of the newest."""
    return [[1 / partitions] * partitions, shares + [0.0] * (partitions - len(shares))]


def fact(path: str, scale: float = 1.0, *, rounds: int = 20, partitions: int = 365, updated: int = 90, **options) -> GeneratorConfig:
    """1 TB: 1 billion records of 1 KB, then 10 million a round, a quarter of them updates by Zipf over 90 days; inserts into two days."""
    own = {"columns": 40, "record_size": 1000, "update_ratio": 0.25, "update_pattern": UpdatePattern.ZIPF}
    return GeneratorConfig(path, rounds, _sized(1_000_000_000, 10_000_000, scale), total_partitions=partitions, partitions_to_update=updated, matrix=_newest(partitions, [0.5, 0.5]), **(own | options))


def dimension(path: str, scale: float = 1.0, *, rounds: int = 20, **options) -> GeneratorConfig:
    """100 GB: 100 million records of 1 KB in one partition, then half a million a round, half of them updates anywhere."""
    own = {"columns": 99, "record_size": 1000, "update_ratio": 0.5, "total_partitions": 1, "partitions_to_update": 1}
    return GeneratorConfig(path, rounds, _sized(100_000_000, 500_000, scale), **(own | options))


def events(path: str, scale: float = 1.0, *, rounds: int = 20, partitions: int = 1095, **options) -> GeneratorConfig:
    """2 TB: 10 billion records of 200 bytes, then 50 million a round, all new and of the newest day."""
    own = {"columns": 30, "record_size": 200, "update_ratio": 0.0}
    return GeneratorConfig(path, rounds, _sized(10_000_000_000, 50_000_000, scale), total_partitions=partitions, matrix=_newest(partitions, [1.0]), **(own | options))
