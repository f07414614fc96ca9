"""Timings of rounds and compactions."""

from __future__ import annotations

import threading
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "kind string, round_no int, attempt int, start_ms long, end_ms long, duration_ms long, success boolean, error string"


def now_ms() -> int:
    return time.time_ns() // 1_000_000


@dataclass(frozen=True)
class Timing:
    kind: str
    round_no: int
    attempt: int
    start_ms: int
    end_ms: int
    success: bool
    error: str | None = None

    @property
    def duration_ms(self) -> int:
        return self.end_ms - self.start_ms


class Metrics:
    """Rounds are recorded by the loader's thread, compactions by the service's."""

    def __init__(self) -> None:
        self._lock, self._all = threading.Lock(), []

    def record(self, timing: Timing) -> None:
        with self._lock:
            self._all.append(timing)

    def of(self, kind: str) -> list[Timing]:
        with self._lock:
            return [t for t in self._all if t.kind == kind]

    @property
    def batches(self) -> list[Timing]:
        return self.of("batch")

    @property
    def compactions(self) -> list[Timing]:
        return self.of("compaction")

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            rows = [asdict(t) | {"duration_ms": t.duration_ms} for t in self._all]
        return spark.createDataFrame(rows, COLUMNS)

    def text(self) -> str:
        lines = []
        for kind, title in (("batch", "Rounds"), ("compaction", "Compactions")):
            own = self.of(kind)
            good = [t.duration_ms for t in own if t.success]
            lines.append(f"{title}: {len(good)} succeeded, {len(own) - len(good)} failed, {sum(good)} ms in all, {sum(good) // len(good) if good else 0} ms on average")
            lines += [f"  {'round ' + str(t.round_no) if kind == 'batch' else 'run'}, attempt {t.attempt}: {t.duration_ms} ms" + ("" if t.success else f", failed: {t.error}") for t in own]
        return "\n".join(lines)


def run_summary(timings: DataFrame) -> DataFrame:
    """Per kind: runs, successes, failures, and total and whole-number average of the successful ones."""
    good = F.when(F.col("success"), F.col("duration_ms"))
    done = F.count_if(F.col("success"))
    total = F.coalesce(F.sum(good), F.lit(0)).cast("long")
    return timings.groupBy("kind").agg(F.count("*").alias("runs"), done.alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), total.alias("total_ms"), F.when(done > 0, F.expr("cast(sum(if(success, duration_ms, 0)) div count_if(success) as bigint)")).otherwise(F.lit(0).cast("long")).alias("average_ms"))
