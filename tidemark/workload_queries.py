"""Queries over generator, files, staging, loader and layout, and the SQL that must give the same rows.

Change records are made of `orders`: the key is the order's number, the partition its status. Folders are scratch folders of the session.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.distributions import cdf, exact_zipf_quotas, exponential, normalise, uniform
from .functions.generators import date_partitions
from .operators import sampling, shape
from .operators.merge import MergeMode, MergeSpec
from .plans import datagen, staged
from .plans.config import ApiType, GeneratorConfig, LoaderConfig, OperationType, StorageFormat, UpdatePattern, WriteMode
from .plans.loader import IncrementalLoader
from .sources import files as disk
from .sources.shared import scratch
from .sources.snapshot import SnapshotTable
from .sources.tables import table_format
from .streaming.rounds import merge_stream, stream_rounds

STATUSES = ["F", "O", "P"]
SEED, TS = 42, 1_700_000_000_000


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def records(spark: SparkSession, sf_dir: str, round_no: int = 0, every: int = 1) -> DataFrame:
    """Change records of orders whose number is divisible by `every`."""
    o = _orders(spark, sf_dir).where(F.col("o_orderkey") % every == 0)
    return o.select(
        F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("partition"), F.lit(round_no).alias("round"),
        F.lit(TS + round_no).cast("long").alias("ts"), F.concat(F.col("o_orderpriority"), F.lit(f" {round_no}")).alias("textField10"), F.col("o_custkey").alias("longField15"),
    )


RECORDS = "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS partition, {0} AS round, CAST(1700000000000 + {0} AS BIGINT) AS ts, o_orderpriority || ' {0}' AS \"textField10\", o_custkey AS \"longField15\" FROM orders WHERE o_orderkey % {1} = 0"
SPEC = MergeSpec(("key", "partition"))


def _history(spark, sf_dir, path: str | None = None) -> tuple[str, DataFrame]:
    """Rounds 0 to 2 on disk, and the history before round 2."""
    path = path or scratch(spark, "rounds")
    for r in range(3):
        disk.write_round(records(spark, sf_dir, r, r + 1), path, r, 2)
    return path, disk.read_history(spark, path, 2)


_HISTORY = f"SELECT * FROM ({RECORDS.format(0, 1)}) UNION ALL SELECT * FROM ({RECORDS.format(1, 2)})"
_LATEST = f"SELECT * FROM ({_HISTORY}) QUALIFY rank() OVER (PARTITION BY key ORDER BY round DESC) = 1"


# ---------------------------------------------------------------- generator


def uniform_updates(spark, sf_dir):
    return datagen.uniform_updates(_history(spark, sf_dir)[1], 400, ["O", "F"], 2, TS, SEED)


def uniform_updates_large(spark, sf_dir):
    """A sample of more rows than one task may gather ranks only the band at its boundary."""
    keyed = records(spark, sf_dir)
    return sampling.exact_sample(keyed, 1000, ("key", "partition"), SEED, gathered=100)


def zipf_updates(spark, sf_dir):
    return datagen.zipf_updates(_history(spark, sf_dir)[1], 300, STATUSES, 2, TS, SEED, 2.93)


def _uuid(text: str) -> str:
    return "substr(md5({0}), 1, 8) || '-' || substr(md5({0}), 9, 4) || '-' || substr(md5({0}), 13, 4) || '-' || substr(md5({0}), 17, 4) || '-' || substr(md5({0}), 21, 12)".format(text)


def _long(text: str) -> str:
    whole = f"(('0x' || substr(md5({text}), 17, 8))::HUGEINT * 4294967296 + ('0x' || substr(md5({text}), 25, 8))::HUGEINT)"
    return f"CAST(CASE WHEN {whole} >= 9223372036854775808 THEN {whole} - 18446744073709551616 ELSE {whole} END AS BIGINT)"


def _unit(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0)"


def _updated(chosen: str) -> str:
    """Updates of round 2 with new payload."""
    text, long = _uuid("'42|2|textField10|' || key"), _long("'42|2|longField15|' || key")
    # an update's numbers are not negative: their bits move one place to the right
    shifted = f"CAST(CASE WHEN {long} >= 0 THEN {long} // 2 ELSE ({long} + CAST(18446744073709551616 AS HUGEINT)) // 2 END AS BIGINT)"
    return f"SELECT key, partition, 2 AS round, CAST({TS} AS BIGINT) AS ts, {text} AS \"textField10\", {shifted} AS \"longField15\" FROM ({chosen})"


_ZIPF = ", ".join(f"('{s}', {q})" for s, q in zip(STATUSES, exact_zipf_quotas(300, 3, 2.93), strict=True))
WEIGHTS, ROWS, WIDE = exponential(0.5, 6), 2000, 14


def generated_payload(spark, sf_dir):
    """Every kind of column that an insert has: two texts of each form, longs, floats and ints."""
    return datagen.inserts(spark, ROWS, columns=WIDE, record_size=420, seed=SEED, round_no=3, ts=TS, partitions=date_partitions(6, date(2025, 1, 1)), weights=WEIGHTS)


def _generated_sql() -> str:
    mark = lambda c: f"'42|3|{c}|' || i"
    steps = " ".join(f"WHEN {_unit(mark('partition'))} <= CAST({s!r} AS DOUBLE) THEN {i}" for i, s in enumerate(cdf(WEIGHTS)))
    low = 420 // WIDE
    body = lambda c: " || ".join(f"to_base64(unhex(sha256({mark(c)} || '|{k}')))" for k in range(-(-2 * low // 43)))
    size = lambda c: f"({low} + (({_long(mark(c))} % {low}) + {low}) % {low})"
    columns = [f"{_uuid(mark('key'))} || '-003' AS key", f"strftime(DATE '2025-01-01' - CAST(1 + CASE {steps} END AS INTEGER), '%Y-%m-%d') AS partition", "3 AS round", f"CAST({TS} AS BIGINT) AS ts"]
    columns += [f'substr({body(c)}, 1, {size(c)}) AS "{c}"' for c in ("textField10", "textField21", "textField32", "textField43", "textField54")]
    columns += [f'{_long(mark(c))} AS "{c}"' for c in ("longField15", "longField27", "longField38")]
    columns += [f"CAST({_unit(mark('decimalField6'))} AS FLOAT) AS \"decimalField6\"", f"CAST(floor({_long(mark('intField19'))} / 4294967296.0) AS INTEGER) AS \"intField19\""]
    return f"SELECT {', '.join(columns)} FROM range({ROWS}) r(i)"


def _workload(spark, pattern: UpdatePattern = UpdatePattern.UNIFORM) -> GeneratorConfig:
    c = GeneratorConfig(scratch(spark, "workload"), 3, (600, 200), columns=10, record_size=200, update_ratio=0.5, total_partitions=4, partitions_to_update=2, update_pattern=pattern, seed=SEED)
    datagen.ChangeDataGenerator(spark, c).generate_workload()
    return c


def generated_rounds(spark, sf_dir):
    """What three rounds hold: records, different keys, keys of earlier rounds, and partitions those come from."""
    out = None
    for pattern in UpdatePattern:
        c = _workload(spark, pattern)
        rounds = disk.read_history(spark, c.path, 3)
        old = rounds.select(F.col("key"), F.col("round").alias("first")).groupBy("key").agg(F.min("first").alias("first"))
        met = rounds.join(old, "key")
        got = met.groupBy(F.lit(pattern.value).alias("pattern"), "round").agg(F.count("*").alias("records"), F.countDistinct("key").alias("keys"), F.count_if(F.col("first") < F.col("round")).alias("updates"), F.countDistinct(F.when(F.col("first") < F.col("round"), F.col("partition"))).alias("partitions"))
        out = got if out is None else out.unionByName(got)
    return out


def resumed_rounds(spark, sf_dir):
    """A workload begun with two rounds and resumed for a third is that of one run; rounds that stand are skipped."""
    path, more = scratch(spark, "resumed"), {"columns": 10, "record_size": 200, "update_ratio": 0.5, "total_partitions": 4, "partitions_to_update": 2, "seed": SEED, "skip_if_exists": True}
    datagen.ChangeDataGenerator(spark, GeneratorConfig(path, 2, (600, 200), **more)).generate_workload()
    written = datagen.ChangeDataGenerator(spark, GeneratorConfig(path, 2, (200,), start_round=1, **more)).generate_workload()
    whole = disk.read_history(spark, _workload(spark).path, 3)
    resumed = disk.read_history(spark, path, 3)
    return whole.unionAll(resumed).groupBy(*whole.columns).count().groupBy("round", F.lit(",".join(map(str, written))).alias("written")).agg(F.count("*").alias("records"), F.min("count").alias("least"), F.max("count").alias("most"))


# ---------------------------------------------------------------- files, views, lists


def round_history(spark, sf_dir):
    """The rounds before the third, read one by one; a probe tells which rounds stand."""
    path, history = _history(spark, sf_dir)
    found = ",".join(str(r) for r in range(5) if disk.round_exists(spark, path, r))
    return history.withColumn("found", F.lit(found))


def single_round(spark, sf_dir):
    path, _ = _history(spark, sf_dir)
    return disk.read_round(spark, path, 2)


def external_stage(spark, sf_dir):
    """A round's folder as a view of stated columns, asked in SQL."""
    path, _ = _history(spark, sf_dir)
    staged.stage_round(spark, path, 1, records(spark, sf_dir).schema, "stage_query")
    return staged.run_sql(spark, "SELECT partition, count(*) AS records, max(ts) AS ts FROM stage_query_1 GROUP BY partition")


def text_lists(spark, sf_dir):
    """Numbers of a text file, one a line; what is no number is skipped."""
    with tempfile.TemporaryDirectory() as folder:
        place = Path(folder) / "numbers.txt"
        place.write_text("1\n 2 \nx\n\n3.5\n40\n")
        rows = [("double", float(x)) for x in disk.load_doubles(str(place))] + [("long", float(x)) for x in disk.load_longs(str(place))]
    return spark.createDataFrame(rows, "kind string, value double")


def weight_forms(spark, sf_dir):
    """Uniform and exponential weights, and weights brought to a sum of one."""
    rows = [(kind, i, float(w)) for kind, ws in (("uniform", uniform(4)), ("exponential", exponential(0.5, 4)), ("normalised", normalise([1.0, 3.0, 4.0]))) for i, w in enumerate(ws)]
    return spark.createDataFrame(rows, "kind string, bucket int, weight double")


# ---------------------------------------------------------------- tables


def parquet_table(spark, sf_dir):
    """The first round replaces what stood there, later rounds are appended."""
    c = LoaderConfig("/none", scratch(spark, "parquet"), format=StorageFormat.PARQUET, operation=OperationType.INSERT, experiment_id="q")
    t = table_format(spark, c)
    for r in (0, 0, 1):
        t.write(records(spark, sf_dir, r, r + 1), OperationType.INSERT, r, {})
    return t.read()


def staged_load(spark, sf_dir):
    """Rounds staged as views, then inserted and merged one by one; each is loaded once."""
    path, _ = _history(spark, sf_dir)
    table = SnapshotTable(spark, scratch(spark, "staged"))
    for r in (0, 1, 2, 2):
        rows = staged.stage_round(spark, path, r, records(spark, sf_dir).schema, "stage_load")
        staged.merge_staged(table, rows, r) if r else staged.insert_staged(table, rows, r)
    return table.read()


def streamed_rounds(spark, sf_dir):
    """Rounds that arrive as files of a stream, each merged once as a micro-batch; a second start finds nothing new."""
    path, shared = scratch(spark, "stream-rounds"), scratch(spark, "stream")
    for r in range(3):
        disk.write_round(records(spark, sf_dir, r, r + 1), path, r, 1)
    table = SnapshotTable(spark, f"{shared}/table")
    schema = records(spark, sf_dir).schema
    for _ in range(2):
        merge_stream(stream_rounds(spark, path, schema), table, SPEC, f"{shared}/state", partition_by="partition").awaitTermination()
    return table.read()


def staged_insert(spark, sf_dir):
    path, _ = _history(spark, sf_dir)
    table = SnapshotTable(spark, scratch(spark, "inserted"))
    for r in (0, 1, 1):
        staged.insert_staged(table, staged.stage_round(spark, path, r, records(spark, sf_dir).schema, "stage_insert"), r)
    return table.read()


def _table(spark, sf_dir, **options) -> SnapshotTable:
    table = SnapshotTable(spark, scratch(spark, "table"))
    table.create(records(spark, sf_dir), partition_by="partition", **options)
    return table


def snapshot_delete_insert(spark, sf_dir):
    """Matches go and are not inserted again: one partition is emptied, half of the others."""
    table = _table(spark, sf_dir)
    batch = records(spark, sf_dir, 1).where("partition = 'P' or cast(key as int) % 2 = 0")
    table.merge(batch.unionByName(batch.withColumn("key", F.concat(F.lit("new "), "key"))), MergeSpec(("key", "partition"), MergeMode.DELETE_INSERT), "round-1")
    return table.read()


def snapshot_update_columns(spark, sf_dir):
    table = _table(spark, sf_dir, merge_on_read=True)
    table.merge(records(spark, sf_dir, 1, 2), MergeSpec(("key", "partition"), update_columns=("textField10",)), "round-1")
    return table.read()


def snapshot_append(spark, sf_dir):
    """A token that was committed once does nothing again."""
    table = _table(spark, sf_dir, cluster_by=["key"])
    for _ in range(2):
        table.append(records(spark, sf_dir, 1, 2), "round-1")
    return table.read()


def snapshot_version(spark, sf_dir):
    """The table as it was before a merge, one partition of it."""
    table = _table(spark, sf_dir)
    table.merge(records(spark, sf_dir, 1, 2), SPEC)
    return table.read(version=1, partitions=["O"])


def snapshot_small_files(spark, sf_dir):
    """Many small files are packed; rows stay, and fewer files hold them."""
    table = _table(spark, sf_dir)
    for r in (1, 2, 3):
        table.append(records(spark, sf_dir, r, 10))
    before = len(table.manifest().files)
    table.compact()
    return table.read().groupBy("round").agg(F.count("*").alias("records")).withColumn("packed", F.lit(len(table.manifest().files) < before))


def loaded_table(spark, sf_dir):
    """A workload loaded by rounds with compaction beside it: how many keys there are, how many the last round has the last word on, and how many rounds went well."""
    c = _workload(spark)
    loader = IncrementalLoader(spark, LoaderConfig(c.path, scratch(spark, "loaded"), 3, write_mode=WriteMode.MERGE_ON_READ, async_compaction=True, compaction_frequency=2, experiment_id="q", cache_input=True))
    metrics = loader.run()
    rounds = metrics.to_dataframe(spark).where("kind = 'batch'").agg(F.count_if("success").alias("succeeded"))
    return loader.table.read().agg(F.countDistinct("key").alias("keys"), F.count_if(F.col("round") == 2).alias("newest")).join(F.broadcast(rounds))  # one row


# ---------------------------------------------------------------- layout and limits


def dealt_files(spark, sf_dir):
    """Rows dealt over a stated number of partitions."""
    dealt = shape.spread(records(spark, sf_dir), 7).withColumn("part", F.spark_partition_id())
    return dealt.agg(F.count("*").alias("records"), F.countDistinct("part").alias("parts"))


def rebalanced(spark, sf_dir):
    return shape.by_partition(records(spark, sf_dir))


def local_limits(spark, sf_dir):
    """n rows, each partition limited on its own."""
    cut = sampling.local_limit(records(spark, sf_dir), 50, 4)
    return cut.agg(F.count("*").alias("records"), F.countDistinct("key").alias("keys"))


def ratio_sampled(spark, sf_dir):
    """Strata of probability one and zero are exact."""
    return sampling.ratio_sample(records(spark, sf_dir), {"O": 1.0, "P": 0.0}, "partition", SEED)


def bernoulli_sampled(spark, sf_dir):
    """About n rows: never more, and seldom much fewer."""
    r = records(spark, sf_dir)
    n = r.count()
    return sampling.bernoulli_sample(r, n // 2, n, SEED).agg((F.count("*") <= n // 2).alias("no_more"), (F.count("*") > n // 3).alias("enough"), (F.countDistinct("key") == F.count("*")).alias("different"))


# ---------------------------------------------------------------- what the formats are sent


class _Recorder:
    """A session that only writes down what it is told."""

    def __init__(self, conf):
        self.conf = conf

    def sql(self, statement):
        return self


def format_statements(spark, sf_dir):
    """DDL, merges and procedures for the formats whose packages are not here, as text."""
    schema = records(spark, sf_dir).select("key", "partition").schema
    rows = []

    class Frame:
        def createOrReplaceTempView(self, name):  # noqa: N802
            pass

    frame = Frame()
    frame.schema = schema
    for fmt, more in ((StorageFormat.ICEBERG, {}), (StorageFormat.HUDI, {"api": ApiType.SQL, "start_round": 1})):
        t = table_format(_Recorder(spark.conf), LoaderConfig("/in", "/out", format=fmt, experiment_id="e1", write_mode=WriteMode.MERGE_ON_READ, **more))
        for r in (0, 1):
            t.prepare(frame, r)
        t.write(frame, OperationType.UPSERT, 1, {})
        if fmt is StorageFormat.ICEBERG:
            t.compact()
        rows += [(fmt.value, i, s) for i, s in enumerate(t.statements)]
    return spark.createDataFrame(rows, "format string, step int, statement string")


_ICE, _HUDI = "`spark_catalog`.`default`.`iceberg_e1`", "`spark_catalog`.`default`.`hudi_e1`"
_MERGE = "MERGE INTO {} t USING `source` s ON t.`key` = s.`key` AND t.`partition` = s.`partition` WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *"
_STATEMENTS = [
    ("iceberg", 0, f"DROP TABLE IF EXISTS {_ICE} PURGE"),
    ("iceberg", 1, f"CREATE TABLE IF NOT EXISTS {_ICE} (`key` string, `partition` string) USING iceberg PARTITIONED BY (`partition`) LOCATION '/out/spark_catalog/default/iceberg_e1' TBLPROPERTIES ('write.delete.mode' = 'merge-on-read', 'write.update.mode' = 'merge-on-read', 'write.merge.mode' = 'merge-on-read')"),
    ("iceberg", 2, f"ALTER TABLE {_ICE} SET TBLPROPERTIES ('write.distribution-mode' = 'hash')"),
    ("iceberg", 3, _MERGE.format(_ICE)),
    ("iceberg", 4, "CALL `spark_catalog`.system.rewrite_data_files(table => 'default.iceberg_e1', strategy => 'binpack', options => map('min-file-size-bytes', '104857600', 'target-file-size-bytes', '125829120'))"),
    ("hudi", 0, f"CREATE TABLE IF NOT EXISTS {_HUDI} (`key` string, `partition` string) USING hudi PARTITIONED BY (`partition`) LOCATION '/out/spark_catalog/default/hudi_e1' TBLPROPERTIES ('primaryKey' = 'key', 'type' = 'mor')"),
    ("hudi", 1, _MERGE.format(_HUDI)),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "uniform_updates": uniform_updates,
    "exact_sample_large": uniform_updates_large,
    "zipf_updates": zipf_updates,
    "generated_payload": generated_payload,
    "generated_rounds": generated_rounds,
    "resumed_rounds": resumed_rounds,
    "round_history": round_history,
    "single_round": single_round,
    "external_stage": external_stage,
    "text_lists": text_lists,
    "weight_forms": weight_forms,
    "parquet_table": parquet_table,
    "staged_load": staged_load,
    "streamed_rounds": streamed_rounds,
    "staged_insert": staged_insert,
    "snapshot_delete_insert": snapshot_delete_insert,
    "snapshot_update_columns": snapshot_update_columns,
    "snapshot_append": snapshot_append,
    "snapshot_version": snapshot_version,
    "snapshot_small_files": snapshot_small_files,
    "loaded_table": loaded_table,
    "dealt_files": dealt_files,
    "rebalanced": rebalanced,
    "local_limits": local_limits,
    "ratio_sampled": ratio_sampled,
    "bernoulli_sampled": bernoulli_sampled,
    "format_statements": format_statements,
}

_R = RECORDS.format
_UPSERT = lambda old, new: f"SELECT * FROM ({old}) t WHERE NOT EXISTS (SELECT 1 FROM ({new}) s WHERE s.key = t.key AND s.partition = t.partition) UNION ALL SELECT * FROM ({new})"
_literal = lambda rows: ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x) for x in r) + ")" for r in rows)

SQL: dict[str, str] = {
    "uniform_updates": _updated(f"SELECT * FROM ({_LATEST}) WHERE partition IN ('O', 'F') ORDER BY md5('42|2|' || key || '|' || partition), key, partition LIMIT 400"),
    "exact_sample_large": f"SELECT * FROM ({_R(0, 1)}) ORDER BY md5('42|' || key || '|' || partition), key, partition LIMIT 1000",
    "zipf_updates": _updated(f"SELECT l.* FROM ({_LATEST}) l JOIN (VALUES {_ZIPF}) z(partition, quota) ON l.partition = z.partition QUALIFY row_number() OVER (PARTITION BY l.partition ORDER BY md5('42|2|' || key), key) <= quota"),
    "generated_payload": _generated_sql(),
    "generated_rounds": "SELECT p AS pattern, CAST(r AS INTEGER) AS round, CAST(n AS BIGINT) AS records, CAST(n AS BIGINT) AS keys, CAST(u AS BIGINT) AS updates, CAST(k AS BIGINT) AS partitions FROM (VALUES ('Uniform'), ('Zipf')) a(p), (VALUES (0, 600, 0, 0), (1, 200, 100, 2), (2, 200, 100, 2)) b(r, n, u, k)",
    "resumed_rounds": "SELECT CAST(r AS INTEGER) AS round, '2' AS written, CAST(n AS BIGINT) AS records, CAST(2 AS BIGINT) AS least, CAST(2 AS BIGINT) AS most FROM (VALUES (0, 600), (1, 200), (2, 200)) b(r, n)",
    "round_history": f"SELECT *, '0,1,2' AS found FROM ({_HISTORY})",
    "single_round": _R(2, 3),
    "external_stage": f"SELECT partition, count(*) AS records, max(ts) AS ts FROM ({_R(1, 2)}) GROUP BY partition",
    "text_lists": "SELECT kind, CAST(value AS DOUBLE) AS value FROM (VALUES ('double', 1), ('double', 2), ('double', 3.5), ('double', 40), ('long', 1), ('long', 2), ('long', 40)) t(kind, value)",
    "weight_forms": """
        WITH e AS (SELECT i, exp(-0.5 * i) AS w FROM range(4) r(i))
        SELECT 'uniform' AS kind, CAST(i AS INTEGER) AS bucket, CAST(0.25 AS DOUBLE) AS weight FROM range(4) r(i)
        UNION ALL SELECT 'exponential', CAST(i AS INTEGER), w / sum(w) OVER () FROM e
        UNION ALL SELECT 'normalised', CAST(i AS INTEGER), CAST(w / 8.0 AS DOUBLE) FROM (VALUES (0, 1), (1, 3), (2, 4)) v(i, w)
    """,
    "parquet_table": _HISTORY,
    "staged_load": _UPSERT(_UPSERT(_R(0, 1), _R(1, 2)), _R(2, 3)),
    "streamed_rounds": _UPSERT(_UPSERT(_R(0, 1), _R(1, 2)), _R(2, 3)),
    "staged_insert": _HISTORY,
    "snapshot_delete_insert": f"""
        SELECT * FROM ({_R(0, 1)}) WHERE NOT (partition = 'P' OR CAST(key AS INTEGER) % 2 = 0)
        UNION ALL SELECT * REPLACE ('new ' || key AS key) FROM ({_R(1, 1)}) WHERE partition = 'P' OR CAST(key AS INTEGER) % 2 = 0
    """,
    "snapshot_update_columns": f"SELECT * REPLACE (CASE WHEN CAST(key AS INTEGER) % 2 = 0 THEN left(\"textField10\", length(\"textField10\") - 1) || '1' ELSE \"textField10\" END AS \"textField10\") FROM ({_R(0, 1)})",
    "snapshot_append": _HISTORY,
    "snapshot_version": f"SELECT * FROM ({_R(0, 1)}) WHERE partition = 'O'",
    "snapshot_small_files": " UNION ALL ".join(f"SELECT {r} AS round, count(*) AS records, true AS packed FROM ({_R(r, k)})" for r, k in ((0, 1), (1, 10), (2, 10), (3, 10))),
    "loaded_table": "SELECT CAST(800 AS BIGINT) AS keys, CAST(200 AS BIGINT) AS newest, CAST(3 AS BIGINT) AS succeeded",
    "dealt_files": f"SELECT count(*) AS records, CAST(7 AS BIGINT) AS parts FROM ({_R(0, 1)})",
    "rebalanced": _R(0, 1),
    "local_limits": "SELECT CAST(50 AS BIGINT) AS records, CAST(50 AS BIGINT) AS keys",
    "ratio_sampled": f"SELECT * FROM ({_R(0, 1)}) WHERE partition = 'O'",
    "bernoulli_sampled": "SELECT true AS no_more, true AS enough, true AS different",
    "format_statements": f"SELECT format, CAST(step AS INTEGER) AS step, statement FROM (VALUES {_literal(_STATEMENTS)}) t(format, step, statement)",
}
