import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import distributions as d
from tidemark.functions import generators as g


def test_zipf_examples():
    assert d.zipf_quotas(100, 4) == [84, 11, 3, 1]
    assert d.zipf_quotas(10, 5) == [8, 1, 1, 1, 1]


@given(st.integers(0, 10_000), st.integers(1, 60), st.floats(0.1, 5))
def test_zipf_properties(n, buckets, shape):
    quotas = d.zipf_quotas(n, buckets, shape)
    assert quotas == sorted(quotas, reverse=True) and min(quotas) >= 1
    assert sum(d.exact_zipf_quotas(n, buckets, shape)) == n
    assert min(d.exact_zipf_quotas(n, buckets, shape)) >= 0


@given(st.lists(st.floats(0.01, 10), min_size=1, max_size=50))
def test_cdf_is_monotone_and_ends_at_one(weights):
    steps = d.cdf(d.normalise(weights))
    assert steps[-1] == 1.0
    assert all(a <= b + 1e-9 for a, b in zip(steps, steps[1:]))
    assert all(0 <= d.draw(steps, u / 10) < len(steps) for u in range(10))


def test_draw_above_all():
    assert d.draw([0.2, 0.5], 0.9) == -1


@given(st.integers(0, 20), st.integers(0, 1000), st.floats(0, 1), st.integers(-1, 5))
def test_split_sums(round_no, n, ratio, k):
    inserts, updates = d.split_round(round_no, n, ratio, k)
    assert inserts + updates == n and 0 <= updates <= round_no * n
    if round_no == 0 or k <= 0:
        assert updates == 0


def test_file_count():
    assert d.file_count(1_000_000, 1024, 134_217_728) == 5
    assert d.file_count(10, 1024, 134_217_728) == 2


def test_matrix_checks():
    assert d.distribution_matrix(3, 2, [[0.5, 0.5], [1.0, 0.0]]) == [[0.5, 0.5], [1.0, 0.0], [1.0, 0.0]]
    for bad in ([[0.5, 0.4]], [[0.5, 0.5], [1.0]], [[1.2, -0.2]], []):
        with pytest.raises(ValueError):
            d.distribution_matrix(1, 2, bad)


@settings(deadline=None, max_examples=3)
@given(st.sampled_from([5, 64, 65, 400]))
def test_draw_column_equals_draw(spark, n):
    steps = d.cdf(d.exponential(0.05, n))
    rows = spark.range(300).select(g.unit(F.col("id").cast("string")).alias("u")).withColumn("i", d.draw_column(steps, F.col("u"))).collect()
    assert all(r.i == d.draw(steps, r.u) for r in rows)


def test_text_length(spark):
    sizes = spark.range(200).select(F.length(g.text_of(F.col("id").cast("string"), 100)).alias("n")).collect()
    assert all(100 <= r.n <= 199 for r in sizes) and len({r.n for r in sizes}) > 20
