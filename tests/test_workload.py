import warnings
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators.merge import MergeMode, MergeSpec
from tidemark.plans import workloads
from tidemark.plans.config import GeneratorConfig, KeyType, LoaderConfig, OperationType, StorageFormat, UpdatePattern, WriteMode
from tidemark.plans.datagen import ChangeDataGenerator
from tidemark.plans.loader import IncrementalLoader
from tidemark.plans.staged import insert_staged, merge_staged, run_sql, stage_round
from tidemark.sources.files import load_doubles, load_longs, read_history, read_round, round_exists
from tidemark.sources.schema import change_schema
from tidemark.sources.snapshot import CommitConflict, SnapshotTable
from tidemark.streaming.rounds import merge_stream, stream_rounds


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def config(path, **more):
    own = {"rounds": 3, "records_per_round": (300, 100), "columns": 16, "record_size": 160, "update_ratio": 0.5, "total_partitions": 5, "partitions_to_update": 2}
    return GeneratorConfig(str(path), **(own | more))


@pytest.fixture(scope="module")
def workload(spark, tmp_path_factory):
    c = config(tmp_path_factory.mktemp("w"))
    ChangeDataGenerator(spark, c).generate_workload()
    return c


@pytest.mark.parametrize("pattern", list(UpdatePattern))
def test_invariants(spark, tmp_path, pattern):
    c = config(tmp_path, update_pattern=pattern)
    made = ChangeDataGenerator(spark, c)
    assert made.generate_workload() == [0, 1, 2]
    assert read_round(spark, c.path, 0).columns == change_schema(16).names
    for r, n in enumerate((300, 100, 100)):
        batch = read_round(spark, c.path, r)
        assert batch.count() == n and batch.select("key").distinct().count() == n
        if r:
            old = read_history(spark, c.path, r)
            again = batch.join(old.select("key", "partition").distinct(), ["key", "partition"])
            assert again.count() == 50
            assert {x.partition for x in again.select("partition").distinct().collect()} <= set(made.partitions[:2])
            if pattern is UpdatePattern.ZIPF:
                counts = {x.partition: x["count"] for x in again.groupBy("partition").count().collect()}
                assert counts[made.partitions[0]] > counts[made.partitions[1]]


def test_one_of_many_writers_makes_a_version(spark, tmp_path):
    """Threads that commit the same version at once: one succeeds, and no manifest is lost or replaced."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from tidemark.sources.files import Files

    files, writers = Files(spark, str(tmp_path / "race")), 8
    for version in range(12):
        gate = Barrier(writers)

        def commit(w, version=version, gate=gate):
            files.write(f"draft{w}", f"{version} by {w}")
            gate.wait()
            return files.rename(f"draft{w}", f"v{version}")

        with ThreadPoolExecutor(writers) as pool:
            won = list(pool.map(commit, range(writers)))
        assert sum(won) == 1 and files.read(f"v{version}") == f"{version} by {won.index(True)}"


def test_clustered_files(spark, tmp_path):
    """Rows of a file are in the order of the clustering columns, after appends, merges and compaction too."""
    import pyarrow.parquet as pq

    table = SnapshotTable(spark, str(tmp_path / "clustered"))
    rows = spark.range(400).select((F.col("id") * 37 % 401).alias("key"), (F.col("id") % 2).cast("string").alias("p"))
    table.create(rows, partition_by="p", cluster_by=["key"])
    table.append(rows.withColumn("key", F.col("key") + 1000), "a")
    table.merge(rows.limit(50), MergeSpec(("key", "p"), duplicates="latest", order=()))
    table.compact()
    for f in table.manifest().files:
        keys = pq.read_table(f"{tmp_path}/clustered/{f.path}").column("key").to_pylist()
        assert keys == sorted(keys)
    assert table.read().count() == 800


def test_same_seed_same_data_and_resume(spark, tmp_path, workload):
    first = config(tmp_path / "x", rounds=2)
    ChangeDataGenerator(spark, first).generate_workload()
    ChangeDataGenerator(spark, config(tmp_path / "x", rounds=1, start_round=2, records_per_round=(100,))).generate_workload()
    for r in range(3):
        assert rows(read_round(spark, first.path, r)) == rows(read_round(spark, workload.path, r))
    with pytest.raises(ValueError, match="begun"):
        ChangeDataGenerator(spark, config(tmp_path / "x", rounds=1, start_round=3, anchor_date=date(2024, 1, 1))).generate_workload()
    assert ChangeDataGenerator(spark, config(tmp_path / "x", skip_if_exists=True)).generate_workload() == []
    assert round_exists(spark, first.path, 2) and not round_exists(spark, first.path, 9)


def test_ordered_keys_and_odd_counts(spark, tmp_path):
    c = config(tmp_path, rounds=1, records_per_round=(103,), key_type=KeyType.TEMPORALLY_ORDERED, total_partitions=7, partitions_to_update=0)
    ChangeDataGenerator(spark, c).generate_workload()
    keys = [r.key for r in read_round(spark, c.path, 0).select("key").collect()]
    assert len(keys) == 103 and all(k.startswith("1735689600000-") and k.endswith("-000") for k in keys)


def test_generator_checks(tmp_path):
    for bad in ({"columns": 4}, {"partitions_to_update": 6}, {"update_ratio": 2}, {"partitions_to_update": "some"}, {"matrix": [[0.5, 0.5]]}):
        with pytest.raises(ValueError):
            config(tmp_path, **bad)
    with pytest.warns(UserWarning, match="no updates"):
        config(tmp_path, partitions_to_update=-1)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert config(tmp_path, total_partitions=-1, partitions_to_update=-1).partitions == 1
    assert config(tmp_path, partitions_to_update="all").updated == 5


def expected(spark, workload, rounds=3):
    """The last round of each key, which a replay of update-inserts must give."""
    h = read_history(spark, workload.path, rounds)
    return rows(h.join(h.groupBy("key").agg(F.max("round").alias("round")), ["key", "round"]).select(*h.columns))


@pytest.mark.parametrize("mode", list(WriteMode))
@pytest.mark.parametrize("service", [False, True])
@pytest.mark.parametrize("non_partitioned", [False, True])
def test_load_end_to_end(spark, tmp_path, workload, mode, service, non_partitioned):
    c = LoaderConfig(workload.path, str(tmp_path), rounds=3, write_mode=mode, async_compaction=service, compaction_frequency=2, experiment_id="e.1", non_partitioned=non_partitioned)
    loader = IncrementalLoader(spark, c, compaction_retry_delay=0.1)
    metrics = loader.run()
    assert rows(loader.table.read()) == expected(spark, workload)
    assert [t.success for t in metrics.batches] == [True] * 3 and "3 succeeded" in metrics.text()
    loader.table.compact()
    assert rows(loader.table.read()) == expected(spark, workload)
    assert not loader.table.table.manifest().deltas


def test_failed_round_is_retried_without_doubles(spark, tmp_path, workload):
    c = LoaderConfig(workload.path, str(tmp_path), rounds=3, max_retries=2, cache_input=True, operation=OperationType.INSERT)
    loader = IncrementalLoader(spark, c)
    write, failed = loader.table.write, []

    def flaky(df, operation, round_no, options):
        write(df, operation, round_no, options)
        if round_no == 1 and not failed:
            failed.append(1)
            raise RuntimeError("lost after the commit")

    loader.table.write = flaky
    loader.run()
    assert loader.table.read().count() == 500
    assert [t.success for t in loader.metrics.batches] == [True, False, True, True]
    # a second run over the same rounds, resumed in the middle, changes nothing
    again = IncrementalLoader(spark, LoaderConfig(workload.path, str(tmp_path), rounds=2, start_round=1, operation=OperationType.INSERT, experiment_id=c.experiment_id))
    again.run()
    assert again.table.read().count() == 500


def test_exhausted_retries(spark, tmp_path, workload):
    loader = IncrementalLoader(spark, LoaderConfig(workload.path, str(tmp_path), rounds=1, max_retries=1))

    def fail(*_):
        raise RuntimeError("no")

    loader.table.write = fail
    with pytest.raises(RuntimeError, match="no"):
        loader.run()
    assert [t.success for t in loader.metrics.batches] == [False, False]


def test_parquet_format(spark, tmp_path, workload):
    with pytest.raises(ValueError, match="cannot upsert"):
        LoaderConfig(workload.path, str(tmp_path), format=StorageFormat.PARQUET)
    c = LoaderConfig(workload.path, str(tmp_path), rounds=3, format=StorageFormat.PARQUET, operation=OperationType.INSERT)
    loader = IncrementalLoader(spark, c)
    loader.run()
    assert loader.table.read().count() == 500
    with pytest.raises(ValueError):
        loader.table.write(read_round(spark, workload.path, 1), OperationType.UPSERT, 1, {})


SCHEMA = "key int, partition string, v int"


def test_emptied_partition_and_moves(spark, tmp_path):
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.create(frame([(1, "p1", 1), (2, "p2", 2), (3, None, 3)]), partition_by="partition")
    t.merge(frame([(1, "p1", 9)]), MergeSpec(("key", "partition"), MergeMode.DELETE_INSERT))
    assert rows(t.read()) == [(2, "p2", 2), (3, None, 3)]
    # the condition omits the partition: the match lies in another one
    t.merge(frame([(2, "p 5/=", 7)]), MergeSpec(("key",)))
    assert rows(t.read()) == [(2, "p 5/=", 7), (3, None, 3)]
    assert rows(t.read(partitions=["p 5/="])) == [(2, "p 5/=", 7)]
    assert t.read(version=1).count() == 3
    assert t.vacuum() and rows(t.read()) == [(2, "p 5/=", 7), (3, None, 3)]
    with pytest.raises(FileExistsError):
        t.create(frame([]))


@pytest.mark.parametrize("spec", [MergeSpec(("key",)), MergeSpec(("key",), update_columns=("v",)), MergeSpec(("key",), MergeMode.DELETE_INSERT)])
def test_mor_equals_cow(spark, tmp_path, spec):
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    out = []
    for mor in (False, True):
        t = SnapshotTable(spark, str(tmp_path / f"t{mor}"))
        t.create(frame([(1, "a", 1), (2, "b", 2), (None, "b", 0)]), partition_by="partition", merge_on_read=mor)
        for batch in ([(2, "a", 20), (4, "c", 4)], [(4, "c", 40), (5, "a", 5), (None, "z", 1)], [(1, "b", 11)]):
            t.merge(frame(batch), spec)
        before = rows(t.read())
        t.compact()
        assert rows(t.read()) == before
        t.merge(frame([(5, "a", 55)]), spec)
        t.append(frame([(5, "a", 56)]))
        out.append(rows(t.read()))
    assert out[0] == out[1]


def test_concurrent_commits(spark, tmp_path):
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.create(frame([(1, "a", 1)]), merge_on_read=True)
    other, put, raced = SnapshotTable(spark, str(tmp_path / "t")), t._put, []

    def late(manifest):
        if not raced:  # another writer commits between reading and writing the manifest
            raced.append(1)
            other.merge(frame([(7, "a", 7)]), MergeSpec(("key",)))
        put(manifest)

    t._put = late
    assert t.merge(frame([(8, "a", 8)]), MergeSpec(("key",)), token="x")
    assert not t.merge(frame([(8, "a", 9)]), MergeSpec(("key",)), token="x")
    assert rows(t.read()) == [(1, "a", 1), (7, "a", 7), (8, "a", 8)]
    raced.clear()
    t._put = late
    assert t.compact()  # on top of the delta that came meanwhile
    assert len(t.manifest().deltas) == 1 and t.read().count() == 3
    with pytest.raises(CommitConflict):
        put(t.manifest())


@pytest.mark.parametrize("merge_on_read", [False, True])
def test_compaction_splits_large_partitions(spark, tmp_path, merge_on_read):
    """No task packs a whole partition: it takes as many tasks, and files, as its bytes need; small ones share a task, and no row is lost."""
    made = spark.range(40_000).select(F.col("id").cast("int").alias("key"), F.when(F.col("id") < 39_000, "large").when(F.col("id") < 39_500, "").when(F.col("id") < 39_900, "small").alias("partition"), F.pmod(F.xxhash64("id"), F.lit(1_000_000_007)).cast("int").alias("v"))
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.create(made.repartition(4), partition_by="partition", merge_on_read=merge_on_read)
    if merge_on_read:
        t.merge(made.withColumn("v", F.lit(0)).where("key % 2 = 0"), MergeSpec(("key", "partition")))
    else:
        t.append(made.repartition(4))
    before, large = rows(t.read().groupBy("partition").agg(F.count("*"), F.sum("key"), F.sum("v"))), [f for f in t.manifest().files if f.partition == "large"]
    target = sum(f.bytes for f in large) // 5
    assert t.compact(target * 10, target)
    after = t.manifest().files
    assert rows(t.read().groupBy("partition").agg(F.count("*"), F.sum("key"), F.sum("v"))) == before
    packed = [f.bytes for f in after if f.partition == "large"]
    assert len(packed) >= 4 and max(packed) < 2 * target
    assert all(len([f for f in after if f.partition == p]) == 1 for p in ("small", None))


def test_writes_sort_nothing(spark, tmp_path):
    """Rows of a few partitions are written as they come: a task's memory doesn't grow with its rows. With many partitions they are sorted, and all are there."""
    made, sc = spark.range(20_000).select(F.col("id").cast("int").alias("key"), (F.col("id") % 3).cast("string").alias("partition"), F.lit(1).alias("v")), spark.sparkContext
    own, peaks = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"), []
    for name, df in (("few", made), ("many", made.withColumn("partition", (F.col("key") % 40).cast("string")))):
        sc.setJobGroup(name, name)
        try:
            t = SnapshotTable(spark, str(tmp_path / name))
            t.create(df, partition_by="partition")
        finally:
            sc._jsc.clearJobGroup()
        store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
        peaks.append(max(store.lastStageAttempt(s).peakExecutionMemory() for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds))
        assert rows(t.read()) == rows(df) and len({f.partition for f in t.manifest().files}) == df.select("partition").distinct().count()
    assert peaks[0] == 0
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == own


def test_stream(spark, tmp_path, workload):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    single = tmp_path / "rounds"
    for r in range(3):
        read_round(spark, workload.path, r).coalesce(1).write.parquet(f"{single}/{r}")
    for _ in range(2):  # the second run finds nothing new
        query = merge_stream(stream_rounds(spark, str(single), change_schema(16)), t, MergeSpec(("key", "partition")), str(tmp_path / "c"), partition_by="partition")
        query.awaitTermination()
    assert rows(t.read()) == expected(spark, workload)


def test_text_lists(tmp_path):
    (tmp_path / "f").write_text("1.5\nx\n2\n")
    assert load_doubles(str(tmp_path / "f")) == [1.5, 2.0]
    assert load_longs(str(tmp_path / "f")) == [2]


def test_shapes(spark, tmp_path):
    f = workloads.fact(str(tmp_path / "f"), 2e-6, rounds=3, partitions=12, updated=4)
    assert f.counts == [2000, 20, 20] and f.weights[2][:3] == [0.5, 0.5, 0.0] and f.columns == 40
    made = ChangeDataGenerator(spark, f)
    made.generate_workload()
    later = read_round(spark, f.path, 1)
    fresh = later.join(read_round(spark, f.path, 0).select("key"), "key", "left_anti")
    assert later.count() == 20 and fresh.count() == 15 and {r.partition for r in fresh.select("partition").collect()} <= set(made.partitions[:2])
    assert workloads.dimension("/x").counts[:2] == [100_000_000, 500_000] and workloads.dimension("/x").columns == 99
    e = workloads.events("/x")
    assert e.partitions == 1095 and e.weights[1][0] == 1.0 and e.updated == -1


def test_staged_steps(spark, tmp_path, workload):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    for r in range(3):
        staged = stage_round(spark, workload.path, r, change_schema(16))
        for _ in range(2):  # a repeated step changes nothing
            if r == 0 and not t.exists():
                insert_staged(t, staged, r)
            elif r:
                merge_staged(t, staged, r)
    assert rows(t.read()) == expected(spark, workload)
    assert run_sql(spark, "SELECT count(*) AS n FROM stage_1").first().n == 100
