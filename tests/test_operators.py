import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import sampling, shape
from tidemark.operators.merge import MergeMode, MergeSpec, condition_columns, merge, replay
from tidemark.operators.versions import latest_version, narrow, rejoin

SCHEMA = "k int, p string, v int, w string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frames(spark, *data):
    return [spark.createDataFrame(d, SCHEMA) for d in data]


T = [(1, "a", 10, "x"), (2, "b", 20, None), (None, "c", 30, "z")]
S = [(2, "b", 21, "n"), (3, "c", 31, "m"), (None, "c", 32, "q")]


def test_update_insert_with_nulls(spark):
    t, s = frames(spark, T, S)
    assert rows(merge(t, s, MergeSpec(("k",)))) == sorted([T[0], T[2], *S], key=repr)


def test_update_columns(spark):
    t, s = frames(spark, T, S)
    out = rows(merge(t, s, MergeSpec(("k",), update_columns=("v",))))
    assert out == sorted([T[0], (2, "b", 21, None), T[2], S[1], S[2]], key=repr)


def test_delete_insert(spark):
    t, s = frames(spark, T, S)
    assert rows(merge(t, s, MergeSpec(("k",), MergeMode.DELETE_INSERT))) == sorted([T[0], T[2], S[1], S[2]], key=repr)


@pytest.mark.parametrize("mode", list(MergeMode))
def test_empty_sides(spark, mode):
    t, s, none = frames(spark, T, S, [])
    assert rows(merge(t, none, MergeSpec(("k",), mode))) == sorted(T, key=repr)
    assert rows(merge(none, s, MergeSpec(("k",), mode))) == sorted(S, key=repr)


def test_several_matches(spark):
    t, s = frames(spark, [(1, "a", 1, "x")], [(1, "a", 2, "y"), (1, "a", 3, "z")])
    with pytest.raises(Exception, match="several source rows"):
        merge(t, s, MergeSpec(("k",))).collect()
    assert rows(merge(t, s, MergeSpec(("k",), duplicates="latest", order=("v",)))) == [(1, "a", 3, "z")]


def test_spec_and_source_checks(spark):
    t, s = frames(spark, T, S)
    with pytest.raises(ValueError):
        MergeSpec(())
    with pytest.raises(ValueError, match="lacks"):
        merge(t, s.drop("w"), MergeSpec(("k",)))
    with pytest.raises(ValueError, match="no such columns"):
        merge(t, s, MergeSpec(("k",), update_columns=("nope",)))
    assert condition_columns(True, ("z", "key")) == ("key", "partition", "z")
    assert condition_columns(False) == ("key",)


key = st.one_of(st.none(), st.integers(0, 5))
row = st.tuples(key, st.sampled_from(["a", "b", None]), st.integers(0, 9), st.sampled_from(["x", None]))


def distinct_keys(data):
    seen, out = set(), []
    for r in data:
        if r[0] is None or r[1] is None or (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            out.append(r)
    return out


@settings(deadline=None, max_examples=8, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, max_size=8).map(distinct_keys), st.lists(row, max_size=8).map(distinct_keys), st.sampled_from(["all", "some", "delete"]))
def test_merge_equals_duckdb(spark, target, source, kind):
    con = duckdb.connect()
    for name, data in (("t", target), ("s", source)):
        con.execute(f"CREATE TABLE {name} (k INT, p VARCHAR, v INT, w VARCHAR)")
        if data:
            con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?, ?)", data)
    action = {"all": "UPDATE SET v = s.v, w = s.w", "some": "UPDATE SET v = s.v", "delete": "DELETE"}[kind]
    con.execute(f"MERGE INTO t USING s ON t.k = s.k AND t.p = s.p WHEN MATCHED THEN {action} WHEN NOT MATCHED THEN INSERT VALUES (s.k, s.p, s.v, s.w)")
    spec = MergeSpec(("k", "p"), MergeMode.DELETE_INSERT if kind == "delete" else MergeMode.UPDATE_INSERT, ("v",) if kind == "some" else ())
    t, s = frames(spark, target, source)
    assert rows(merge(t, s, spec)) == sorted(con.execute("SELECT * FROM t").fetchall(), key=repr)


def test_replay_equals_merges(spark):
    t, a, b = frames(spark, T, S, [(3, "c", 40, "k"), (None, "c", 1, "q"), (4, "d", 5, None)])
    assert rows(replay(t, [a, b], MergeSpec(("k",)))) == rows(merge(merge(t, a, MergeSpec(("k",))), b, MergeSpec(("k",))))


HISTORY = [("a", "p", 0, 1), ("a", "p", 1, 2), ("a", "p", 1, 3), ("b", "q", 0, 4)]


def test_latest_keeps_ties(spark):
    h = spark.createDataFrame(HISTORY, "key string, partition string, round int, v int")
    last = latest_version(h)
    assert rows(last) == sorted(HISTORY[1:], key=repr)
    assert "WindowGroupLimit" in last._jdf.queryExecution().toString()
    assert rows(rejoin(h, latest_version(narrow(h)).distinct())) == sorted(HISTORY[1:], key=repr)


def sample_frame(spark, n=500):
    return spark.range(n).select(F.col("id").alias("key"), (F.col("id") % 7).cast("string").alias("partition"))


@pytest.mark.parametrize("gathered", [10, 100_000])
def test_exact_sample(spark, monkeypatch, gathered):
    monkeypatch.setattr(sampling, "GATHERED", gathered)
    df = sample_frame(spark)
    for n in (0, 5, 123, 500, 900):
        found = sampling.exact_sample(df, n, ("key",), 1)
        assert found.count() == min(n, 500) and found.columns == df.columns
    keys = {r.key for r in sampling.exact_sample(df, 123, ("key",), 1).collect()}
    expected = sorted((r.key for r in df.collect()), key=lambda k: __import__("hashlib").md5(f"1|{k}".encode()).hexdigest())[:123]
    assert keys == set(expected)


def test_stratified_and_local_limit(spark):
    df = sample_frame(spark)
    quotas = spark.createDataFrame([("0", 5), ("1", 1000), ("2", 0)], "partition string, quota long")
    got = {r.partition: r["count"] for r in sampling.stratified_quota(df, quotas, "partition").groupBy("partition").count().collect()}
    assert got == {"0": 5, "1": df.where("partition = '1'").count()}
    assert sampling.local_limit(df, 5, 7).count() == 5
    assert sampling.local_limit(df, 100, 7).count() == 100
    assert sampling.bernoulli_sample(df, 50, 500, seed=1).count() <= 50
    assert sampling.ratio_sample(df, {"0": 1.0}, "partition").count() == df.where("partition = '0'").count()


def test_large_bernoulli_sample_gathers_nothing(spark):
    """The rows of a limit, dealt over the tasks they come from, also below a union and a coalesce; a sample below n is whole."""
    df = spark.range(5000).select(F.col("id").cast("string").alias("key"), F.lit(None).cast("string").alias("note")).repartition(8, "key")
    for n, rows in ((2000, 2000), (5000, 5000), (4999, 4999), (6000, 5000)):
        got = sampling.bernoulli_sample(df, n, 5000, seed=1, gathered=100)
        assert got.count() == rows == got.select("key").distinct().count() and got.columns == df.columns
        assert df.unionByName(got).coalesce(3).count() == 5000 + rows
    got = sampling.bernoulli_sample(df, 2000, 5000, seed=1, gathered=100)
    assert got.groupBy(F.spark_partition_id()).count().count() > 4
    assert "Limit" not in got._jdf.queryExecution().executedPlan().toString()
    short = sampling.bernoulli_sample(df, 2000, 5000, seed=1, margin=0.5, gathered=100)
    assert short.count() == df.sample(0.2, 1).count() < 2000
    assert sampling.bernoulli_sample(df.limit(0), 2000, 5000, gathered=100).count() == 0


def test_rewrite_payload(spark):
    df = spark.createDataFrame([("k", "p", 0, 1, "t", 5, 0.5, 7, "keep")], "key string, partition string, round int, ts long, textField10 string, longField15 long, decimalField6 float, intField19 int, other string")
    one, two = (shape.rewrite_payload(df, 3, 99, 1).first() for _ in range(2))
    assert one == two and one[:4] == ("k", "p", 3, 99) and one.other == "keep"
    assert len(one.textField10) == 36 and one.longField15 >= 0 and one.intField19 >= 0 and 0 <= one.decimalField6 < 1


def test_layout(spark):
    df = sample_frame(spark)
    assert [r.partition for r in shape.clustered(df).collect()] == sorted(str(i % 7) for i in range(500))
    assert "REBALANCE" in shape.by_partition(df)._jdf.queryExecution().toString().upper()
    assert shape.newest(["c", "b", "a"], 2) == ["c", "b"]
    assert shape.spread(df, 3).rdd.getNumPartitions() == 3
