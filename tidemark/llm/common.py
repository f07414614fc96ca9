"""What several operators of this subpackage share.

* a folder that driver and executors share, and tables written there to cut lineage;
* Arrow text columns as numpy bytes, processed in slices of bounded size;
* connected components over links, which do not leave the cluster if they are many.
"""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# The kernels travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Bytes of text that the numpy kernels take at a time; their temporary arrays take about 60 times as much.
#: A longer text stands alone, and kernels go through it by CHUNK.
SLICE_BYTES = 1 << 19
GOLDEN = 0x9E3779B97F4A7C15
_RADIX = 0x5851F42D4C957F2D


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. In a local session without one (tests), a temporary folder is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: later stages restart from there, whatever executor is lost."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored() that no later step reads."""
    for df in tables:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, so that columns of the caller never clash with ours."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id):
    """crc32 of the id's decimal text, modulo 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


# ---------------------------------------------------------------- text as numpy


def as_text(column: pa.Array) -> pa.Array:
    """A string array without nulls and with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and where each row starts; offsets[-1] is the end."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of at most `rows` rows with about `limit` bytes each; a longer row stands alone."""
    if not len(column):
        return
    _, offsets = text_bytes(column)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), start + rows, len(column))
        yield start, stop
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(radix: int, n: int) -> np.ndarray:
    out = np.full(n, radix, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Word bytes: ASCII letters and digits, and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


#: Bytes that a kernel looks at together, however long the text is.
CHUNK = 1 << 20


def chunks(n: int, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of `size` that cover n."""
    return ((a, min(a + size, n)) for a in range(0, n, size))


def edges(inside: np.ndarray, raw_inside: Callable[[int], bool], a: int, b: int, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs start and end (last byte) within bytes a to b; breaks: places in the whole before which a run ends."""
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], after[-1] = raw_inside(a - 1), raw_inside(b)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    own = breaks[np.searchsorted(breaks, a, "left") : np.searchsorted(breaks, b, "right")]
    before[own[own < b] - a] = False
    after[own[own > a] - 1 - a] = False
    return np.flatnonzero(inside & ~before) + a, np.flatnonzero(inside & ~after) + a


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all rows, and where each row's words start (one more entry at the end).

    A hash is a polynomial of the word's bytes, from sums over all bytes that go on from chunk to chunk.
    """
    raw, offsets = text_bytes(pc.utf8_lower(column))
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    size = min(n, CHUNK)
    powers, inverse = _powers(_RADIX, size), _powers(pow(_RADIX, -1, 1 << 64), size)
    within = lambda i: 0 <= i < n and bool(WORD_BYTE[raw[i]])
    total, lefts, rights, starts = np.uint64(0), [], [], []
    for a, b in chunks(n):
        part = raw[a:b]
        start, end = edges(WORD_BYTE[part], within, a, b, offsets)
        sums = np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[: b - a] * np.uint64(pow(_RADIX, a, 1 << 64)), dtype=np.uint64) + total
        lefts.append(np.where(start > a, sums[np.maximum(start - 1 - a, 0)], total))
        # a word's hash doesn't tell where it stands
        rights.append(sums[end - a])
        starts.append(start)
        total = sums[-1]
    begin = np.concatenate(starts)
    back = np.concatenate([inverse[x - a] * np.uint64(pow(pow(_RADIX, -1, 1 << 64), a, 1 << 64)) for x, (a, _) in zip(starts, chunks(n), strict=True)])
    return mix((np.concatenate(rights) - np.concatenate(lefts)) * back), np.searchsorted(begin, offsets)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; a shorter text has one run, of all its words; no words, none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - k + 1)
    out = np.full(n, len(words) if len(words) < k else k, np.uint64)
    for i in range(min(k, len(words))):
        out = out * np.uint64(_RADIX) + words[i : i + n]
    return mix(out)


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Each hash combined with how often it occurred before in the array, so that all differ."""
    if not len(hashes):
        return hashes
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    if new.all():
        return hashes
    at = np.arange(len(hashes))
    occurrence = np.empty(len(hashes), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(occurrence > 0, mix(hashes + occurrence * np.uint64(GOLDEN)), hashes)


def give_back() -> None:
    """Returns freed memory to the system, so that an idle Python worker doesn't hold what its last task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run with give_back() at its end."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def with_struct(df: DataFrame, text_col: str, name: str, fields: str, kernel: Callable[[pa.Array], list], *, keep: list[str] | None = None, rows: int = 1 << 30) -> DataFrame:
    """Columns `keep` of df (all of them by default) and a struct of `fields` that kernel finds from slices of whole texts.

    kernel gets a string array without nulls (null texts are empty) and returns an array for each field.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != name.lower()]
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    text = free_name(df, "text")
    taken = df.select(*map(quoted, keep), F.col(quoted(text_col)).cast("string").alias(text))
    schema = StructType([*taken.schema.fields[:-1], StructField(name, StructType.fromDDL(fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = as_text(batch.column(batch.num_columns - 1))
            for start, stop in slices(whole, rows=rows):
                found = kernel(whole.slice(start, stop - start))
                own = pa.StructArray.from_arrays(found, names=[f.name for f in schema[name].dataType])
                yield pa.RecordBatch.from_arrays([*(c.slice(start, stop - start) for c in batch.columns[:-1]), own], names=schema.names)

    return taken.mapInArrow(tidy(run), schema)


# ---------------------------------------------------------------- hot keys

#: Parts that the rows of one key are dealt into.
PARTS = 256


def beside(df: DataFrame, key: list[str], spot: str, where: str | None = None, **totals: tuple[Callable, Column | str]) -> DataFrame:
    """df (its rows `where`) with columns over all rows of the same key, which must not be null; a total is (function, column) or (function, column, function that combines).

    The rows of a key are never in one task: they are dealt into PARTS by a hash of `spot`, each part is aggregated before the
    shuffle, a key's parts (PARTS at most) are combined, and rows meet the result by key and part.
    """
    part = free_name(df, "part")
    dealt = df.withColumn(part, F.pmod(F.xxhash64(spot), F.lit(PARTS)).cast("int"))
    own = dealt.groupBy(*key, part).agg(*(t[0](t[1]).alias(name) for name, t in totals.items()))
    whole = Window.partitionBy(*key)
    combined = own.select(*key, part, *((t[2] if len(t) > 2 else t[0])(F.col(name)).over(whole).alias(name) for name, t in totals.items()))
    return (dealt.where(where) if where else dealt).join(combined, [*key, part]).drop(part)


def attached(df: DataFrame, key: list[str], spot: str, table: DataFrame) -> DataFrame:
    """df joined with a table that has a row for each key (others drop out), a key's rows in PARTS tasks at most."""
    part = free_name(df, "part")
    dealt = df.withColumn(part, F.pmod(F.xxhash64(spot), F.lit(PARTS)).cast("int"))
    return dealt.join(dealt.select(*key, part).distinct().join(table, key), [*key, part]).drop(part)


# ---------------------------------------------------------------- components


#: Links that the driver joins itself (16 bytes each); more stay in the cluster.
FEW_LINKS = 1 << 15


def joined(edges: DataFrame) -> DataFrame:
    """components() of edges(hi, lo) on the driver, as rows (hi, lo): the node and its root."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    table = edges.select("hi", "lo").toArrow()
    for a, b in zip(table["hi"].to_pylist(), table["lo"].to_pylist(), strict=True):
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    found = [(x, top(x)) for x in parent]
    found = [(x, root) for x, root in found if x != root]
    return edges.sparkSession.createDataFrame(pa.table({"hi": pa.array([x for x, _ in found], pa.int64()), "lo": pa.array([x for _, x in found], pa.int64())}))


def components(links: DataFrame, label: str, few: int = FEW_LINKS) -> DataFrame:
    """Columns node and root (the least node of its component) for the nodes of links(a, b) that are not roots themselves.

    Up to `few` links are joined on the driver. Beyond, alternating large-star and small-star rounds: each gives every node the least of its neighbours, by beside(),
    so that a node with very many links is in many tasks. Every round is
    written to the shared folder, with a checksum taken on the way that tells when nothing changes.
    """

    def put(edges: DataFrame, step: str) -> tuple[DataFrame, tuple]:
        seen = Observation()
        done = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0)).alias("x")), f"{label}-{step}")
        return done, (seen.get["n"], seen.get["x"])

    edges, before = put(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    if 0 < before[0] <= few:
        old, edges = edges, stored(joined(edges), f"{label}-few")
        discard(old)
        before = (0, 0)
    while before[0]:
        both = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))).alias("e")).select("e.*")
        large = beside(both, ["u"], "v", "v > u", m=(F.min, "v")).select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct()
        floor = beside(large, ["hi"], "lo", m=(F.min, "lo"))
        # every neighbour below a node hangs on the least of them, and so does the node
        hung = floor.select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi <> lo")
        old, (edges, now) = edges, put(hung.distinct(), "star")
        discard(old)
        if now == before:
            break
        before = now
    out = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    out._stored_at = edges._stored_at
    return out
