import pytest
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidemark.operators.merge import MergeMode
from tidemark.plans import cli
from tidemark.plans.compaction import CompactionService
from tidemark.plans.config import ApiType, LoaderConfig, OperationType, StorageFormat, UpdatePattern, WriteMode
from tidemark.plans.metrics import Metrics, Timing, run_summary
from tidemark.sources import catalog as c
from tidemark.sources.tables import table_format

SCHEMA = StructType([StructField("key", StringType()), StructField("a`b", IntegerType())])


def test_sql_text():
    assert c.quoted("a.b`c") == "`a`.`b``c`"
    assert c.create_table("x.y", SCHEMA, "iceberg", "/t'1", partition_by="p", properties={"k": "v'"}) == r"CREATE TABLE IF NOT EXISTS `x`.`y` (`key` string, `a``b` int) USING iceberg PARTITIONED BY (`p`) LOCATION '/t\'1' TBLPROPERTIES ('k' = 'v\'')"
    assert c.merge_from("t", "source", ("key", "p"), False, ()) == "MERGE INTO `t` t USING `source` s ON t.`key` = s.`key` AND t.`p` = s.`p` WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *"
    assert "WHEN MATCHED THEN DELETE" in c.merge_from("t", "s", ("k",), True, ("v",))
    assert "UPDATE SET t.`v` = s.`v`" in c.merge_from("t", "s", ("k",), False, ("v",))
    assert c.table_name("hudi", "cat", "db", "a-b") == "cat.db.hudi_a_b"
    assert c.table_path("/o/", "cat.db.iceberg_x") == "/o/cat/db/iceberg_x"


class Fake:
    """Stands for a session: the formats' packages are not here, so only what they are sent is checked."""

    def __init__(self):
        self.conf = self
        self.set_, self.values = [], {}

    def sql(self, text):
        return self

    def get(self, k, default=None):
        return self.values.get(k, default)

    def set(self, k, v):
        self.values[k] = v
        self.set_.append((k, v))

    def unset(self, k):
        self.values.pop(k, None)


class Frame:
    schema = SCHEMA

    def createOrReplaceTempView(self, name):  # noqa: N802
        self.view = name


def made(fmt, **more):
    return table_format(Fake(), LoaderConfig("/in", "/out", format=fmt, experiment_id="e1", **more))


def test_iceberg_statements():
    t = made(StorageFormat.ICEBERG, write_mode=WriteMode.MERGE_ON_READ, async_compaction=True, initial_options={"write.merge.mode": "x"})
    t.prepare(Frame(), 0)
    t.write(Frame(), OperationType.BULK_INSERT, 0, {})
    t.prepare(Frame(), 1)
    t.write(Frame(), OperationType.UPSERT, 1, {})
    t.compact()
    drop, create, insert, alter, merge, call = t.statements
    assert drop == "DROP TABLE IF EXISTS `spark_catalog`.`default`.`iceberg_e1` PURGE"
    assert "'write.merge.mode' = 'x'" in create and "'write.target-file-size-bytes' = '125829120'" in create and "PARTITIONED BY (`partition`)" in create
    assert insert == "INSERT INTO `spark_catalog`.`default`.`iceberg_e1` SELECT * FROM `source`"
    assert "'write.distribution-mode' = 'hash'" in alter
    assert merge.startswith("MERGE INTO `spark_catalog`.`default`.`iceberg_e1` t") and "t.`partition` = s.`partition`" in merge
    assert call.startswith("CALL `spark_catalog`.system.rewrite_data_files(table => 'default.iceberg_e1', strategy => 'binpack'")


def test_iceberg_resume_keeps_the_table():
    t = made(StorageFormat.ICEBERG, start_round=3)
    t.prepare(Frame(), 3)
    assert not any(s.startswith("DROP") for s in t.statements)


def test_hudi(monkeypatch):
    gone = []
    monkeypatch.setattr("tidemark.sources.tables.Files", lambda spark, path: type("F", (), {"delete": lambda self: gone.append(path)})())
    t = made(StorageFormat.HUDI, api=ApiType.SQL, merge_mode=MergeMode.DELETE_INSERT)
    assert t.compaction_every == 1 and made(StorageFormat.DELTA, compaction_frequency=4).compaction_every == 4
    t.prepare(Frame(), 0)
    t.write(Frame(), OperationType.BULK_INSERT, 0, {"a": "b"})
    t.write(Frame(), OperationType.UPSERT, 1, {})
    assert [s.split(" ")[0] for s in t.statements] == ["DROP", "CREATE", "ALTER", "SET", "INSERT", "MERGE"]
    assert gone == [t.path]
    resumed = made(StorageFormat.HUDI, api=ApiType.SQL, start_round=2)
    resumed.prepare(Frame(), 2)
    assert gone == [t.path] and [s.split(" ")[0] for s in resumed.statements] == ["CREATE"]
    t = made(StorageFormat.HUDI, write_mode=WriteMode.MERGE_ON_READ, async_compaction=True, compaction_frequency=4)
    options = t.options(OperationType.UPSERT, {"hoodie.compact.inline": "true", "x": "y"})
    assert options["hoodie.compact.inline"] == "false" and options["x"] == "y" and options["hoodie.compact.inline.max.delta.commits"] == "4"
    assert options["hoodie.datasource.write.operation"] == "upsert" and "hoodie.write.lock.provider" in options


def test_delta_conf_is_put_back():
    t = made(StorageFormat.DELTA)
    t.spark.values["spark.databricks.delta.optimize.minFileSize"] = "old"
    assert t.compact() and t.statements == ["OPTIMIZE delta.`/out/delta-e1`"]
    assert t.spark.values == {"spark.databricks.delta.optimize.minFileSize": "old"}
    assert ("spark.databricks.delta.optimize.maxFileSize", "125829120") in t.spark.set_


def test_guards():
    for bad in ({"api": ApiType.SQL, "format": StorageFormat.DELTA}, {"format": StorageFormat.HUDI, "merge_mode": MergeMode.DELETE_INSERT}, {"format": StorageFormat.HUDI, "update_columns": ("v",)}, {"format": StorageFormat.HUDI, "extra_condition_columns": ("v",)}):
        with pytest.raises(ValueError):
            LoaderConfig("/in", "/out", **bad)


def test_cli():
    g = cli.generator_config(["-p", "/x", "--number-records-per-round", "10,5", "--total-partitions", "4", "--num-partitions-to-update", "all", "--update-pattern", "Zipf", "--skip-if-exists", "true"])
    assert g.counts[:3] == [10, 5, 5] and g.updated == 4 and g.update_pattern is UpdatePattern.ZIPF and g.skip_if_exists
    x = cli.loader_config(["-i", "/i", "-o", "/o", "--format", "snapshot", "--options", "a=b", "c=d,e=f=g", "--options", "h=i", "--update-columns", "v,w", "--write-mode", "merge-on-read", "--non-partitioned"])
    assert x.options == {"a": "b", "c": "d", "e": "f=g", "h": "i"} and x.spec.on == ("key",) and x.spec.update_columns == ("v", "w") and x.experiment_id.isalnum()
    assert cli.loader_config(["-i", "/i", "-o", "/o"]).format is StorageFormat.HUDI
    assert cli.main(["generate"]) == 1 and cli.main([]) == 1 and cli.main(["load", "-i", "a", "-o", "b", "--format", "parquet"]) == 1


def test_service_counts_retries_and_final_run():
    metrics, runs = Metrics(), []

    def run(force):
        runs.append(force)
        if len(runs) == 1:
            raise RuntimeError("first")
        return True

    s = CompactionService(run, metrics, frequency=2, retries=2, retry_delay=0.01)
    s.notify_commit().result()
    assert not runs
    s.notify_commit().result()
    assert runs == [False, False] and s.commits == 0
    s.notify_commit().result()
    assert s.shutdown() == [] and runs[-1] is True
    assert [t.success for t in metrics.compactions] == [False, True, True]


def test_service_reports_failures():
    def run(force):
        raise RuntimeError("always")

    s = CompactionService(run, Metrics(), frequency=1, retries=0)
    s.notify_commit()
    assert len(s.shutdown()) == 2


def test_metrics(spark):
    m = Metrics()
    for i, ok in enumerate((True, False, True)):
        m.record(Timing("batch", i, 0, 100 * i, 100 * i + 33 + i, ok, None if ok else "x"))
    row = run_summary(m.to_dataframe(spark)).first()
    assert (row.runs, row.succeeded, row.failed, row.total_ms, row.average_ms) == (3, 2, 1, 68, 34)
    assert "2 succeeded, 1 failed, 68 ms in all, 34 ms on average" in m.text()


def test_delta_gets_the_options():
    class Writer:
        def __init__(self):
            self.calls = []

        def __getattr__(self, name):
            return lambda *a, **k: self.calls.append((name, a, k)) or self

    frame = Frame()
    frame.write = Writer()
    made(StorageFormat.DELTA).write(frame, OperationType.INSERT, 0, {"mergeSchema": "true"})
    assert ("options", (), {"mergeSchema": "true"}) in frame.write.calls


def test_statements_parse(spark):
    """Every statement of the adapters is SQL to Spark's own parser; CALL is left out where it isn't."""
    iceberg = made(StorageFormat.ICEBERG, write_mode=WriteMode.MERGE_ON_READ, async_compaction=True, initial_options={"k": "it's"})
    hudi = made(StorageFormat.HUDI, api=ApiType.SQL, write_mode=WriteMode.MERGE_ON_READ, async_compaction=True, initial_options={"k": "v"}, start_round=1)
    delta = made(StorageFormat.DELTA)
    for t in (iceberg, hudi):
        for mode, columns in ((MergeMode.UPDATE_INSERT, ()), (MergeMode.UPDATE_INSERT, ("key",)), (MergeMode.DELETE_INSERT, ())):
            t.statements.append(c.merge_from(t.name, "source", ("key", "partition"), mode is MergeMode.DELETE_INSERT, columns))
    for r in (0, 1):
        iceberg.prepare(Frame(), r)
        iceberg.write(Frame(), OperationType.INSERT, r, {})
    hudi.prepare(Frame(), 1)
    hudi.write(Frame(), OperationType.INSERT, 1, {"a": "b"})
    iceberg.compact()
    parser = spark._jsparkSession.sessionState().sqlParser()
    said = [s for t in (iceberg, hudi, delta) for s in t.statements]
    assert len(said) > 12
    for statement in said:
        parser.parsePlan(statement)
