"""Samples: exact ones by hash order, one pass for all strata, and the approximate forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many rows, a sample is an ordered limit, which gathers them in one task.
GATHERED = 100_000


def hash_order(seed: int | str, *ids: str | Column) -> Column:
    """Sort key of a random but repeatable order: md5 of the seed and the row's identity."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids)))


def exact_sample(df: DataFrame, n: int, ids: Sequence[str] = ("key",), seed: int | str = 0, gathered: int | None = None) -> DataFrame:
    """Exactly min(n, rows) rows: those first in hash order.

    A sample of more than `gathered` rows (GATHERED by default) takes all rows whose hash is surely low enough, and ranks only the band about the boundary:
    no task gathers the n rows.
    """
    order = hash_order(seed, *ids)
    if n <= (GATHERED if gathered is None else gathered):
        return df.withColumn("__o", order).orderBy("__o", *ids).limit(n).drop("__o")
    prefix = F.conv(F.substring(F.col("__o"), 1, 4), 16, 10).cast("int")
    keyed = df.withColumn("__o", order).withColumn("__p", prefix)
    # 65536 buckets of the hash; the counts are all that reaches the driver
    counts = sorted((r["__p"], r["count"]) for r in keyed.groupBy("__p").count().collect())
    taken = 0
    for bucket, rows in counts:
        if taken + rows > n:
            band = keyed.where(F.col("__p") == bucket).orderBy("__o", *ids).limit(n - taken)
            return keyed.where(F.col("__p") < bucket).unionByName(band).drop("__o", "__p")
        taken += rows
    return df


#: Ranges of the hash that a stratum's rows are counted in, as powers of 16.
DIGITS = 3


def stratified_quota(df: DataFrame, quotas: DataFrame, stratum: str, ids: Sequence[str] = ("key",), seed: int | str = 0) -> DataFrame:
    """Exactly min(quota, rows) rows of each stratum, those first in hash order. quotas: stratum and quota; others get none.

    Rows of each range of the hash are counted first. Ranges below the one in which a stratum's quota ends are taken whole, and only rows in that one
    are ranked: a stratum of any size is no single task, and no row is shuffled but those ranked.
    """
    spot, edge, most, left, place = "__o", "__edge", "__range", "__left", "__n"
    order = hash_order(seed, *ids)
    counts = df.select(stratum, F.substring(order, 1, DIGITS).alias(edge)).groupBy(stratum, edge).agg(F.count("*").alias(most))
    upto = F.sum(most).over(Window.partitionBy(stratum).orderBy(edge).rowsBetween(Window.unboundedPreceding, 0))
    wanted = quotas.select(F.col(stratum), F.col("quota").cast("long").alias("quota")).where("quota > 0")
    # the first range that reaches the quota, else one above all; what is left to take of it
    reached = counts.withColumn("upto", upto).join(wanted, stratum).groupBy(stratum).agg(
        F.min(F.when(F.col("upto") >= F.col("quota"), F.col(edge))).alias(edge),
        F.max("quota").alias("quota"),
        F.coalesce(F.max(F.when(F.col("upto") < F.col("quota"), F.col("upto"))), F.lit(0)).alias("below"),
    )
    reached = reached.select(stratum, F.coalesce(edge, F.lit("g")).alias(edge), (F.col("quota") - F.col("below")).alias(left))
    keyed = df.withColumn(spot, order).join(reached, stratum).withColumn(most, F.substring(spot, 1, DIGITS)).where(F.col(most) <= F.col(edge))
    whole = keyed.where(F.col(most) < F.col(edge))
    ranked = keyed.where(F.col(most) == F.col(edge)).withColumn(place, F.row_number().over(Window.partitionBy(stratum).orderBy(spot, *ids))).where(F.col(place) <= F.col(left)).drop(place)
    return whole.unionByName(ranked).select(*df.columns)


def ratio_sample(df: DataFrame, fractions: Mapping[str, float], stratum: str, seed: int = 0) -> DataFrame:
    """Each row of a stratum with its probability: no shuffle, numbers only about right."""
    return df.sampleBy(stratum, dict(fractions), seed)


def bernoulli_sample(df: DataFrame, n: int, total: int, seed: int = 0, margin: float = 1.1, gathered: int | None = None) -> DataFrame:
    """About n of total rows: a Bernoulli sample of a little more, then a limit.

    A limit of more than `gathered` rows (GATHERED by default) reads the sample twice and gathers nothing: its partitions are counted, then each gives its rows until n are reached.
    """
    if not total:
        return df.limit(0)
    sample = df.sample(min(1.0, margin * n / total), seed)
    return sample.limit(n) if n <= (GATHERED if gathered is None else gathered) else _first(sample, n)


def _first(df: DataFrame, n: int) -> DataFrame:
    """n rows, or all if there are fewer: those of the first partitions. A count a partition reaches the driver.

    Never more than n, even if partitions come out differently when they are read again.
    """
    part = "__part"
    # the number of the partition in this frame; a task's own number is another one below a union
    marked = df.withColumn(part, F.spark_partition_id())

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({part: pa.array([batch.column(part)[0].as_py()], pa.int32()), "rows": pa.array([batch.num_rows], pa.int64())})

    # counted over all columns, as they are read again, so that adaptive execution makes the same partitions of them
    counts = {r[part]: r["n"] for r in marked.mapInArrow(count, f"{part} int, rows long").groupBy(part).agg(F.sum("rows").alias("n")).collect()}
    quotas, left = {}, n
    for p in sorted(counts):
        quotas[p] = min(counts[p], left)
        left -= quotas[p]

    def cut(batches):
        open_rows = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if open_rows is None:
                open_rows = quotas.get(batch.column(part)[0].as_py(), 0)
            if open_rows <= 0:
                return
            out = batch.slice(0, min(open_rows, batch.num_rows))
            open_rows -= out.num_rows
            yield out.select(df_columns)

    df_columns = df.columns
    return marked.mapInArrow(cut, df.schema)


def local_limit(df: DataFrame, n: int, parts: int) -> DataFrame:
    """n rows dealt over `parts` partitions, each limited on its own: the first n % parts take one more than the rest.

    Unlike a limit it gathers nothing; where a partition holds fewer rows than its part, the result is short.
    """
    base, extra = divmod(n, parts)

    def cut(batches):
        from pyspark import TaskContext

        left = base + (TaskContext.get().partitionId() < extra)
        for batch in batches:
            if left <= 0:
                return
            out: pa.RecordBatch = batch.slice(0, min(left, batch.num_rows))
            left -= out.num_rows
            yield out

    return df.repartition(parts).mapInArrow(cut, df.schema)
