"""Queries over the driver's tables, made of the library's operators, and the SQL that must give the same rows.

The change batch of the merge queries is all of `orders` with doubled keys: half of them meet an order, half are new.
The history is all of `events`: the day of the month is the round, the user the key, the event type the stratum.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workload_queries
from .functions import generators as g
from .functions.distributions import cdf, distribution_matrix, draw_column, exact_zipf_quotas, exponential, file_count, split_round, zipf_quotas
from .operators import sampling, shape
from .operators.merge import MergeMode, MergeSpec, merge, replay
from .operators.versions import latest_version, narrow, rejoin
from .plans.metrics import COLUMNS, run_summary

ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*ORDERS)


def _batch(orders: DataFrame, factor: int = 2) -> DataFrame:
    return orders.withColumns({"o_orderkey": F.col("o_orderkey") * factor, "o_totalprice": F.round(F.col("o_totalprice") + factor, 2), "o_orderstatus": F.lit("U")})


BATCH = "SELECT o_orderkey * {0} AS o_orderkey, o_custkey, 'U' AS o_orderstatus, round(o_totalprice + {0}, 2) AS o_totalprice, o_orderpriority FROM orders"
TARGET = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
BY_KEY = MergeSpec(("o_orderkey",))


def merge_update_insert(spark, sf_dir):
    t = _orders(spark, sf_dir)
    return merge(t, _batch(t), BY_KEY)


def merge_delete_insert(spark, sf_dir):
    t = _orders(spark, sf_dir)
    return merge(t, _batch(t), MergeSpec(("o_orderkey",), MergeMode.DELETE_INSERT))


def merge_update_columns(spark, sf_dir):
    t = _orders(spark, sf_dir)
    return merge(t, _batch(t), MergeSpec(("o_orderkey",), update_columns=("o_totalprice",)))


def merge_null_keys(spark, sf_dir):
    """Urgent orders have no key on either side: none of them matches."""
    t = _orders(spark, sf_dir).withColumn("o_orderkey", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderkey")))
    return merge(t, _batch(t), MergeSpec(("o_orderkey",), duplicates="latest", order=()))


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.max("l_partkey").alias("partkey"))


def merge_composite_key(spark, sf_dir):
    t = _lines(spark, sf_dir)
    return merge(t, t.withColumns({"l_linenumber": F.col("l_linenumber") + 1, "quantity": F.col("quantity") + 100}), MergeSpec(("l_orderkey", "l_linenumber")))


def multi_round_replay(spark, sf_dir):
    t = _orders(spark, sf_dir)
    return replay(t, [_batch(t, f) for f in (2, 3, 5)], BY_KEY)


def _snapshot(merge_on_read: bool, compact: bool):
    def run(spark, sf_dir):
        from .sources.shared import scratch
        from .sources.snapshot import SnapshotTable

        t = _orders(spark, sf_dir)
        own = SnapshotTable(spark, scratch(spark, "snapshot"))
        own.create(t, partition_by="o_orderpriority", merge_on_read=merge_on_read)
        for f in (2, 3, 5):
            own.merge(_batch(t, f), BY_KEY, token=f"round-{f}")
        if compact:
            own.compact()
        return own.read()

    return run


def _history(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("partition"), F.dayofmonth("ts").alias("round"), "event_id", "value")


HISTORY = "SELECT CAST(user_id AS VARCHAR) AS key, event_type AS partition, CAST(day(ts) AS INTEGER) AS round, event_id, value FROM events"


def latest(spark, sf_dir):
    return latest_version(_history(spark, sf_dir))


def latest_narrow(spark, sf_dir):
    h = narrow(_history(spark, sf_dir))
    return latest_version(h).groupBy("key", "partition", "round").agg(F.count("*").alias("ties"))


def payload_rejoin(spark, sf_dir):
    h = _history(spark, sf_dir)
    return rejoin(h, latest_version(narrow(h)).distinct())


def partition_filter(spark, sf_dir):
    return shape.in_partitions(_history(spark, sf_dir), ["click", "purchase"])


def partition_counts(spark, sf_dir):
    return shape.partition_counts(_history(spark, sf_dir))


def top_k_partitions(spark, sf_dir):
    """Records of the two newest days: the list of partitions is known, as a workload's is."""
    h = _history(spark, sf_dir)
    days = [f"{d:02d}" for d in range(31, 0, -1)]
    return shape.in_partitions(h.withColumn("partition", F.date_format(F.make_date(F.lit(2024), F.lit(1), "round"), "dd")), shape.newest(days, 2))


def exact_sample_n(spark, sf_dir):
    return sampling.exact_sample(_history(spark, sf_dir), 100, ("event_id",), 42)


def stratified_quota(spark, sf_dir):
    h = _history(spark, sf_dir)
    quotas = h.groupBy("partition").agg(F.floor(F.count("*") / 10).alias("quota"))
    return sampling.stratified_quota(h, quotas, "partition", ("event_id",), 42)


ZIPF_STRATA = ["click", "error", "purchase", "signup", "view"]


def zipf_quota_sample(spark, sf_dir):
    quotas = spark.createDataFrame(list(zip(ZIPF_STRATA, exact_zipf_quotas(200, 5), strict=True)), "partition string, quota long")
    return sampling.stratified_quota(_history(spark, sf_dir), quotas, "partition", ("event_id",), 42)


WEIGHTS = exponential(0.5, 6)


def cdf_assignment(spark, sf_dir):
    u = g.unit(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", draw_column(cdf(WEIGHTS), u).cast("long").alias("bucket"))


def rewrite_payload(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_brand").alias("partition"), F.lit(0).alias("round"), F.lit(0).cast("long").alias("ts"), F.col("p_name").alias("textField10"), F.col("p_type").alias("other"))
    return shape.rewrite_payload(p, 7, 1_700_000_000_000, 42)


UUID = "substr(md5({0}), 1, 8) || '-' || substr(md5({0}), 9, 4) || '-' || substr(md5({0}), 13, 4) || '-' || substr(md5({0}), 17, 4) || '-' || substr(md5({0}), 21, 12)"


def union_insert_update(spark, sf_dir):
    t = _orders(spark, sf_dir)
    fresh = _batch(t).withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000)
    return shape.union_changes(fresh, _batch(t))


INSERTS = 2000


def gen_inserts(spark, sf_dir):
    from .plans.datagen import inserts

    made = inserts(spark, INSERTS, columns=10, record_size=1024, seed=42, round_no=3, ts=1_700_000_000_000, partitions=g.date_partitions(6, date(2025, 1, 1)), weights=WEIGHTS)
    return made.select("key", "partition", "round", "ts")


def round_split(spark, sf_dir):
    rows = [(r, n, *split_round(r, n, ratio, k), file_count(n, 1024, 134_217_728)) for r in range(6) for n in (0, 7, 100_000) for ratio, k in ((0.25, 3), (0.5, -1), (1.0, 2))]
    return spark.createDataFrame(rows, "round_no int, n long, inserts long, updates long, files long")


def distribution_rows(spark, sf_dir):
    rows = [(r, i, float(w), zipf_quotas(100, 4)[i]) for r, row in enumerate(distribution_matrix(3, 4)) for i, w in enumerate(row)]
    return spark.createDataFrame(rows, "round_no int, bucket int, weight double, quota long")


def sorted_bulk_load(spark, sf_dir):
    h = _history(spark, sf_dir)
    return shape.clustered(h, ("partition", "key", "event_id"))


TIMINGS = [("batch", 0, 0, 0, 1234, 1234, True, None), ("batch", 1, 0, 2000, 2100, 100, False, "lost"), ("batch", 1, 1, 2100, 2667, 567, True, None), ("batch", 2, 0, 3000, 3890, 890, True, None), ("compaction", -1, 0, 2700, 2999, 299, True, None)]


def run_metrics(spark, sf_dir):
    return run_summary(spark.createDataFrame(TIMINGS, COLUMNS))


def json_fields(spark, sf_dir):
    """A field of semi-structured text with a type, as an external stage reads it."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of orders after an upsert, counted by status."""
    return merge_update_insert(spark, sf_dir).groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship": flagship,
    "merge_update_insert": merge_update_insert,
    "merge_update_columns": merge_update_columns,
    "merge_delete_insert": merge_delete_insert,
    "merge_null_keys": merge_null_keys,
    "merge_composite_key": merge_composite_key,
    "multi_round_replay": multi_round_replay,
    "snapshot_cow": _snapshot(False, False),
    "snapshot_mor": _snapshot(True, False),
    "snapshot_compacted": _snapshot(True, True),
    "latest_version": latest,
    "latest_version_ties": latest_narrow,
    "payload_rejoin": payload_rejoin,
    "partition_filter": partition_filter,
    "partition_counts": partition_counts,
    "top_k_partitions": top_k_partitions,
    "exact_sample_n": exact_sample_n,
    "stratified_quota": stratified_quota,
    "zipf_quota_sample": zipf_quota_sample,
    "cdf_assignment": cdf_assignment,
    "rewrite_payload": rewrite_payload,
    "union_insert_update": union_insert_update,
    "gen_inserts": gen_inserts,
    "round_split": round_split,
    "distribution_matrix": distribution_rows,
    "sorted_bulk_load": sorted_bulk_load,
    "run_metrics": run_metrics,
    "json_fields": json_fields,
    **workload_queries.QUERIES,
}

_REPLAY = f"""
    WITH b AS (
      SELECT 1 AS v, * FROM ({BATCH.format(2)}) UNION ALL SELECT 2, * FROM ({BATCH.format(3)}) UNION ALL SELECT 3, * FROM ({BATCH.format(5)})
    ), w AS (SELECT * EXCLUDE (v) FROM b QUALIFY v = max(v) OVER (PARTITION BY o_orderkey))
    SELECT * FROM ({TARGET}) t WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.o_orderkey = t.o_orderkey) UNION ALL SELECT * FROM w
"""
_UPSERT = f"SELECT * FROM ({TARGET}) t WHERE NOT EXISTS (SELECT 1 FROM ({BATCH.format(2)}) s WHERE s.o_orderkey = t.o_orderkey) UNION ALL SELECT * FROM ({BATCH.format(2)})"
_NULLED = "SELECT CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderkey END AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
_UNIT = "(('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0)"
_CDF = cdf(WEIGHTS)
_BUCKET = lambda u: "CASE " + " ".join(f"WHEN {u} <= CAST({s!r} AS DOUBLE) THEN {i}" for i, s in enumerate(_CDF)) + " END"
_ORDER = "md5('42|' || event_id)"
_ZIPF = ", ".join(f"('{s}', {q})" for s, q in zip(ZIPF_STRATA, exact_zipf_quotas(200, 5), strict=True))
_LINES = "SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, max(l_partkey) AS partkey FROM lineitem GROUP BY ALL"

SQL: dict[str, str] = {
    "flagship": f"SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM ({_UPSERT}) GROUP BY o_orderstatus",
    "merge_update_insert": _UPSERT,
    "merge_update_columns": f"""
        SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, CASE WHEN t.m THEN t.o_custkey ELSE s.o_custkey END AS o_custkey,
               CASE WHEN t.m THEN t.o_orderstatus ELSE s.o_orderstatus END AS o_orderstatus,
               CASE WHEN s.m THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice,
               CASE WHEN t.m THEN t.o_orderpriority ELSE s.o_orderpriority END AS o_orderpriority
        FROM (SELECT *, true AS m FROM ({TARGET})) t FULL JOIN (SELECT *, true AS m FROM ({BATCH.format(2)})) s ON t.o_orderkey = s.o_orderkey
    """,
    "merge_delete_insert": f"""
        SELECT * FROM ({TARGET}) t WHERE NOT EXISTS (SELECT 1 FROM ({BATCH.format(2)}) s WHERE s.o_orderkey = t.o_orderkey)
        UNION ALL SELECT * FROM ({BATCH.format(2)}) s WHERE NOT EXISTS (SELECT 1 FROM ({TARGET}) t WHERE s.o_orderkey = t.o_orderkey)
    """,
    "merge_null_keys": f"""
        WITH t AS ({_NULLED}), s AS (SELECT o_orderkey * 2 AS o_orderkey, o_custkey, 'U' AS o_orderstatus, round(o_totalprice + 2, 2) AS o_totalprice, o_orderpriority FROM t)
        SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = t.o_orderkey) UNION ALL SELECT * FROM s
    """,
    "merge_composite_key": f"""
        WITH t AS ({_LINES}), s AS (SELECT l_orderkey, l_linenumber + 1 AS l_linenumber, quantity + 100 AS quantity, partkey FROM t)
        SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber) UNION ALL SELECT * FROM s
    """,
    "multi_round_replay": _REPLAY,
    "snapshot_cow": _REPLAY,
    "snapshot_mor": _REPLAY,
    "snapshot_compacted": _REPLAY,
    "latest_version": f"SELECT * FROM ({HISTORY}) QUALIFY rank() OVER (PARTITION BY key ORDER BY round DESC) = 1",
    "latest_version_ties": f"SELECT key, partition, round, count(*) AS ties FROM (SELECT * FROM ({HISTORY}) QUALIFY rank() OVER (PARTITION BY key ORDER BY round DESC) = 1) GROUP BY ALL",
    "payload_rejoin": f"SELECT * FROM ({HISTORY}) QUALIFY round = max(round) OVER (PARTITION BY key)",
    "partition_filter": f"SELECT * FROM ({HISTORY}) WHERE partition IN ('click', 'purchase')",
    "partition_counts": "SELECT event_type AS partition, count(*) AS rows FROM events GROUP BY ALL",
    "top_k_partitions": f"SELECT * REPLACE (lpad(CAST(round AS VARCHAR), 2, '0') AS partition) FROM ({HISTORY}) WHERE round IN (30, 31)",
    "exact_sample_n": f"SELECT * FROM ({HISTORY}) ORDER BY {_ORDER}, event_id LIMIT 100",
    "stratified_quota": f"""
        SELECT * EXCLUDE (n, q) FROM (
          SELECT *, row_number() OVER (PARTITION BY partition ORDER BY {_ORDER}, event_id) AS n, count(*) OVER (PARTITION BY partition) // 10 AS q FROM ({HISTORY})
        ) WHERE n <= q
    """,
    "zipf_quota_sample": f"""
        WITH z(partition, quota) AS (VALUES {_ZIPF})
        SELECT * EXCLUDE (n, quota) FROM (
          SELECT h.*, quota, row_number() OVER (PARTITION BY h.partition ORDER BY {_ORDER}, event_id) AS n FROM ({HISTORY}) h JOIN z ON h.partition = z.partition
        ) WHERE n <= quota
    """,
    "cdf_assignment": f"SELECT event_id, CAST({_BUCKET(_UNIT.format('CAST(event_id AS VARCHAR)'))} AS BIGINT) AS bucket FROM events",
    "rewrite_payload": f"SELECT CAST(p_partkey AS VARCHAR) AS key, p_brand AS partition, 7 AS round, CAST(1700000000000 AS BIGINT) AS ts, {UUID.format(chr(39) + '42|7|textField10|' + chr(39) + ' || p_partkey')} AS \"textField10\", p_type AS other FROM part",
    "union_insert_update": f"SELECT * REPLACE (o_orderkey + 1000000000 AS o_orderkey) FROM ({BATCH.format(2)}) UNION ALL {BATCH.format(2)}",
    "gen_inserts": f"""
        SELECT {UUID.format("'42|3|key|' || i")} || '-003' AS key,
               strftime(DATE '2025-01-01' - CAST(1 + {_BUCKET(_UNIT.format("'42|3|partition|' || i"))} AS INTEGER), '%Y-%m-%d') AS partition,
               3 AS round, CAST(1700000000000 AS BIGINT) AS ts FROM range({INSERTS}) r(i)
    """,
    "round_split": """
        WITH x AS (SELECT r.r, n.n, k.ratio, k.k FROM range(6) r(r), (VALUES (0), (7), (100000)) n(n), (VALUES (0.25, 3), (0.5, -1), (1.0, 2)) k(ratio, k)),
        y AS (SELECT *, CASE WHEN r = 0 OR k <= 0 THEN 0 ELSE least(floor(ratio * n), r * n) END AS u FROM x)
        SELECT CAST(r AS INTEGER) AS round_no, CAST(n AS BIGINT) AS n, CAST(n - u AS BIGINT) AS inserts, CAST(u AS BIGINT) AS updates,
               CAST(greatest(2, floor(n / (134217728 / (1024 * 0.66)))) AS BIGINT) AS files FROM y
    """,
    "distribution_matrix": """
        WITH z AS (SELECT i, pow(i + 1, -2.93) AS w FROM range(4) b(i)), q AS (SELECT i, greatest(1, floor(100 * w / sum(w) OVER ())) AS quota FROM z)
        SELECT CAST(r AS INTEGER) AS round_no, CAST(i AS INTEGER) AS bucket, CAST(0.25 AS DOUBLE) AS weight, CAST(quota AS BIGINT) AS quota FROM range(3) m(r), q
    """,
    "sorted_bulk_load": f"SELECT * FROM ({HISTORY})",
    "run_metrics": """
        WITH t(kind, ms, ok) AS (VALUES ('batch', 1234, true), ('batch', 100, false), ('batch', 567, true), ('batch', 890, true), ('compaction', 299, true))
        SELECT kind, count(*) AS runs, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed,
               CAST(sum(ms) FILTER (ok) AS BIGINT) AS total_ms, CAST(sum(ms) FILTER (ok) // count(*) FILTER (ok) AS BIGINT) AS average_ms FROM t GROUP BY kind
    """,
    "json_fields": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    **workload_queries.SQL,
}
