"""Rounds of change data: inserts with generated values, and updates of keys of earlier rounds."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import generators as g
from ..functions.distributions import cdf, draw_column, exact_zipf_quotas, file_count, split_round
from ..operators.sampling import exact_sample, stratified_quota
from ..operators.shape import in_partitions, newest, rewrite_payload, union_changes
from ..operators.versions import latest_version, narrow, rejoin
from ..sources.files import Files, read_history, round_exists, write_round
from ..sources.schema import change_schema
from .config import GeneratorConfig, KeyType, UpdatePattern

METADATA = "_workload.json"


def insert_values(columns: int, record_size: int, ident: Column, seed: int, round_no: int, ts: int, partition: Column, ordered: bool) -> list[Column]:
    """All columns of an inserted record, as expressions of its identity."""
    low = max(record_size // columns, 1)
    out = []
    for f in change_schema(columns):
        mark = g.salted(seed, round_no, f.name, ident)
        if f.name == "key":
            value = g.record_key(mark, round_no, ts if ordered else None)
        elif f.name == "partition":
            value = partition
        elif f.name == "round":
            value = F.lit(round_no)
        elif f.name == "ts":
            value = F.lit(ts).cast("long")
        elif f.name.startswith("textField"):
            value = g.text_of(mark, low)
        elif f.name.startswith("decimalField"):
            value = g.unit(mark).cast("float")
        elif f.name.startswith("longField"):
            value = g.whole(mark)
        else:
            value = F.shiftright(g.whole(mark), 32).cast("int")
        out.append(value.alias(f.name))
    return out


def inserts(spark: SparkSession, n: int, *, columns: int, record_size: int, seed: int, round_no: int, ts: int, partitions: Sequence[str], weights: Sequence[float], ordered: bool = False, tasks: int | None = None) -> DataFrame:
    """Exactly n records, made where the range's tasks run."""
    ids = spark.range(0, n, 1, tasks) if tasks else spark.range(n)
    index = draw_column(cdf(weights), g.unit(g.salted(seed, round_no, "partition", F.col("id"))))
    named = F.element_at(F.array(*(F.lit(p) for p in partitions)), index + 1)
    return ids.select(*insert_values(columns, record_size, F.col("id"), seed, round_no, ts, named, ordered))


def uniform_updates(history: DataFrame, n: int, partitions: Sequence[str], round_no: int, ts: int, seed: int) -> DataFrame:
    """n of the latest records in these partitions, every one as likely, with new payload.

    Ids are ranked and sampled on three columns; payload is read again for the chosen ones only.
    """
    old = in_partitions(history, partitions)
    chosen = exact_sample(latest_version(narrow(old)), n, ("key", "partition"), f"{seed}|{round_no}")
    return rewrite_payload(rejoin(old, chosen), round_no, ts, seed)


def zipf_updates(history: DataFrame, n: int, partitions: Sequence[str], round_no: int, ts: int, seed: int, shape: float) -> DataFrame:
    """n of the latest records, the newest partition most, quotas falling by rank; a partition with fewer records than its quota gives all."""
    old = in_partitions(history, partitions)
    quotas = old.sparkSession.createDataFrame(list(zip(partitions, exact_zipf_quotas(n, len(partitions), shape), strict=True)), "partition string, quota long")
    chosen = stratified_quota(latest_version(narrow(old)), quotas, "partition", ("key",), f"{seed}|{round_no}")
    return rewrite_payload(rejoin(old, chosen), round_no, ts, seed)


class ChangeDataGenerator:
    def __init__(self, spark: SparkSession, config: GeneratorConfig):
        self.spark, self.config = spark, config
        self.partitions = g.date_partitions(config.partitions, config.anchor_date)

    def ts_of(self, round_no: int) -> int:
        return self.config.start_ts + 60_000 * round_no

    def round(self, round_no: int) -> DataFrame:
        """The change records of one round; earlier rounds must be on disk if it has updates."""
        c, at = self.config, round_no - self.config.start_round
        n = c.counts[at]
        new, changed = split_round(round_no, n, c.update_ratio, c.updated)
        out = inserts(self.spark, new, columns=c.columns, record_size=c.record_size, seed=c.seed, round_no=round_no, ts=self.ts_of(round_no), partitions=self.partitions, weights=c.weights[at], ordered=c.key_type is KeyType.TEMPORALLY_ORDERED)
        if not changed:
            return out
        history = read_history(self.spark, c.path, round_no)
        hot = newest(self.partitions, c.updated)
        if c.update_pattern is UpdatePattern.UNIFORM:
            updates = uniform_updates(history, changed, hot, round_no, self.ts_of(round_no), c.seed)
        elif c.update_pattern is UpdatePattern.ZIPF:
            updates = zipf_updates(history, changed, hot, round_no, self.ts_of(round_no), c.seed, c.zipf_shape)
        else:
            raise ValueError(f"unknown pattern {c.update_pattern}")
        return union_changes(out, updates)

    def generate_workload(self) -> list[int]:
        """Writes the rounds one after the other; returns those written."""
        c = self.config
        self._check_metadata()
        written = []
        for round_no in range(c.start_round, c.start_round + c.rounds):
            if c.skip_if_exists and round_exists(self.spark, c.path, round_no):
                continue
            files = file_count(c.counts[round_no - c.start_round], c.record_size, c.file_size)
            write_round(self.round(round_no), c.path, round_no, files)
            written.append(round_no)
        return written

    def _check_metadata(self) -> None:
        """Partition names and values depend on these; a resumed run must have the same."""
        files, own = Files(self.spark, self.config.path), {"seed": self.config.seed, "anchor_date": self.config.anchor_date.isoformat(), "columns": self.config.columns, "partitions": self.config.partitions}
        if self.config.start_round and files.exists(METADATA):
            if (was := json.loads(files.read(METADATA))) != own:
                raise ValueError(f"the workload was begun with {was}, now {own}")
        else:
            files.write(METADATA, json.dumps(own))
