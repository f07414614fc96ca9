"""Loads rounds of change data into a table, one after the other."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession

from ..operators.shape import clustered
from ..sources.files import read_round
from ..sources.tables import TableFormat, table_format
from .compaction import CompactionService
from .config import LoaderConfig, OperationType
from .metrics import Metrics, Timing, now_ms

log = logging.getLogger(__name__)


class IncrementalLoader:
    def __init__(self, spark: SparkSession, config: LoaderConfig, table: TableFormat | None = None, *, retry_delay: float = 0.0, compaction_retry_delay: float = 60.0):
        self.spark, self.config, self.metrics = spark, config, Metrics()
        self.table = table or table_format(spark, config)
        self._retry_delay, self._compaction_delay = retry_delay, compaction_retry_delay

    def run(self) -> Metrics:
        """All rounds; a round that fails after all its attempts ends the run. The summary is logged in any case."""
        c, service, failure = self.config, None, None
        if c.compaction_enabled:
            service = CompactionService(self.table.compact, self.metrics, frequency=self.table.compaction_every, retry_delay=self._compaction_delay)
        try:
            for round_no in range(c.start_round, c.start_round + c.rounds):
                self.load_round(round_no)
                if service:
                    service.notify_commit()
        except Exception as e:
            failure = e
            raise
        finally:
            errors = service.shutdown(c.run_final_compaction and failure is None) if service else []
            log.info(self.metrics.text())
            if errors and failure is None:
                raise ExceptionGroup("compaction failed", errors)
            for e in errors:
                failure.add_note(f"compaction failed too: {e}")
        return self.metrics

    def load_round(self, round_no: int) -> None:
        c = self.config
        raw = read_round(self.spark, c.input_path, round_no)
        if c.cache_input:
            raw.persist()
            raw.count()
        try:
            self.table.prepare(raw, round_no)
            # clustered files for the bulk load of a partitioned table
            rows = clustered(raw) if round_no == 0 and not c.non_partitioned else raw
            self._attempts(rows, round_no)
        finally:
            if c.cache_input:
                raw.unpersist()

    def _attempts(self, rows: DataFrame, round_no: int) -> None:
        for attempt in range(self.config.max_retries + 1):
            start = now_ms()
            try:
                self.write_round(rows, round_no)
            except Exception as e:
                self.metrics.record(Timing("batch", round_no, attempt, start, now_ms(), False, str(e)[:500]))
                if attempt == self.config.max_retries:
                    raise
                time.sleep(self._retry_delay)
                continue
            self.metrics.record(Timing("batch", round_no, attempt, start, now_ms(), True))
            return

    def write_round(self, rows: DataFrame, round_no: int, operation: OperationType | None = None) -> None:
        self.table.write(rows, operation or self.config.operation_of(round_no), round_no, self.config.options_of(round_no))
