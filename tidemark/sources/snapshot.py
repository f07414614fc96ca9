"""A transactional table of parquet files: copy-on-write and merge-on-read.

Data files are never changed. A version is a JSON manifest that lists base files by partition, then deltas in order
of commits. A commit writes the next manifest under a temporary name and renames it; if that version exists, another writer
was first, and the operation is done again on the new state. The rename is atomic on HDFS and local disks; an
object store needs a catalog or a lock instead. A commit may carry a token (such as a round): a second commit
with the same token does nothing, so retries never double rows.

Copy-on-write rewrites the partitions that the batch touches, and keeps other files by reference. Merge-on-read appends the
batch as a delta; readers apply deltas in the order of their versions, whatever the rows' own columns say. Compaction folds
deltas into base files and packs small files; it commits on top of writes that came meanwhile if those only added.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.merge import MergeMode, MergeSpec, merge, replay, unique_source
from .files import Files

MANIFESTS, DATA = "_manifests", "data"
MARK = "__in_partition"


#: A task that writes rows of so many partitions or fewer keeps a file of each open and sorts nothing; rows of further partitions are sorted, and spilled if need be.
OPEN_FILES = 16
_OPEN = "spark.sql.maxConcurrentOutputFileWriters"
_lock, _writing = threading.Lock(), Counter()


@contextmanager
def _open_files(session: SparkSession) -> Iterator[None]:
    """Sets OPEN_FILES for the writes within, of any thread, unless the session has a number of its own; the last one to end takes it back."""
    me = session._jsparkSession.sessionUUID()
    with _lock:
        if not _writing[me] and int(session.conf.get(_OPEN)) > 0:
            me = None
        else:
            session.conf.set(_OPEN, OPEN_FILES)
            _writing[me] += 1
    try:
        yield
    finally:
        if me:
            with _lock:
                _writing[me] -= 1
                if not _writing[me]:
                    del _writing[me]
                    session.conf.unset(_OPEN)


class CommitConflict(RuntimeError):
    """Another writer made this version first."""


@dataclass
class DataFile:
    path: str
    partition: str | None
    bytes: int


@dataclass
class Delta:
    version: int
    files: list[DataFile]
    on: list[str]
    mode: str
    update_columns: list[str]


@dataclass
class Manifest:
    version: int
    schema: str
    partition_by: str | None
    merge_on_read: bool
    cluster_by: list[str] = field(default_factory=list)
    files: list[DataFile] = field(default_factory=list)
    deltas: list[Delta] = field(default_factory=list)
    tokens: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Manifest:
        raw = json.loads(text)
        raw["files"] = [DataFile(**f) for f in raw["files"]]
        raw["deltas"] = [Delta(**{**d, "files": [DataFile(**f) for f in d["files"]]}) for d in raw["deltas"]]
        return Manifest(**raw)


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, *, attempts: int = 5):
        self.spark, self.path, self.attempts = spark, path.rstrip("/"), attempts
        self.files = Files(spark, self.path)

    # ------------------------------------------------------------ versions

    def exists(self) -> bool:
        return bool(self.versions())

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self.files.names(MANIFESTS) if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no table at {self.path}")
        return Manifest.from_json(self.files.read(f"{MANIFESTS}/v{found[-1] if version is None else version:08d}.json"))

    def _put(self, manifest: Manifest) -> None:
        name = f"{MANIFESTS}/v{manifest.version:08d}.json"
        draft = f"{MANIFESTS}/.{uuid.uuid4().hex}"
        self.files.write(draft, manifest.to_json())
        if not self.files.rename(draft, name):
            self.files.delete(draft)
            raise CommitConflict(name)

    def _commit(self, token: str | None, change: Callable[[Manifest], Manifest | None]) -> bool:
        """change gets the newest manifest and returns the next one, or None if there is nothing to do. False: nothing was done."""
        for attempt in range(self.attempts):
            now = self.manifest()
            if token is not None and token in now.tokens:
                return False
            after = change(now)
            if after is None:
                return False
            after.version = now.version + 1
            if token is not None:
                after.tokens = now.tokens | {token: after.version}
            try:
                self._put(after)
                return True
            except CommitConflict:
                if attempt == self.attempts - 1:
                    raise
        return False

    # ------------------------------------------------------------ files

    def _write(self, df: DataFrame, partition_by: str | None, cluster_by: Sequence[str] = ()) -> list[DataFile]:
        """New data files. The partition's name is in the folder and in the rows, so files can be read one by one with all columns.

        cluster_by orders the rows of each file, so that row groups cover narrow ranges of those columns and scans skip the others.
        """
        folder = f"{DATA}/{uuid.uuid4().hex}"
        if partition_by:
            df = df.withColumn(MARK, F.col(partition_by).cast("string"))
        if cluster_by:
            df = df.sortWithinPartitions(*([MARK] if partition_by else []), *cluster_by)
        if partition_by and not cluster_by:
            with _open_files(df.sparkSession):
                df.write.partitionBy(MARK).parquet(f"{self.path}/{folder}")
        else:
            (df.write.partitionBy(MARK) if partition_by else df.write).parquet(f"{self.path}/{folder}")
        out = []
        for name, size in self.files.tree(folder):
            if name.endswith(".parquet"):
                inside = name.split(f"{MARK}=")
                value = None if len(inside) == 1 else self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(inside[1].split("/")[0])
                out.append(DataFile(name, None if value == "__HIVE_DEFAULT_PARTITION__" else value, size))
        return out

    def _frame(self, manifest: Manifest, files: Sequence[DataFile]) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest.schema))
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f.path}" for f in files))

    # ------------------------------------------------------------ reading

    def read(self, version: int | None = None, partitions: Sequence[str] | None = None) -> DataFrame:
        """The table at a version; with `partitions`, only files of those are opened."""
        m = self.manifest(version)
        keep = None if partitions is None or not m.partition_by else {*partitions}
        base = [f for f in m.files if keep is None or f.partition in keep]
        # a delta's rows may move to other partitions if the partition is no condition column, so deltas are pruned only if it is
        pruned = [d if keep is None or m.partition_by not in d.on else Delta(d.version, [f for f in d.files if f.partition in keep], d.on, d.mode, d.update_columns) for d in m.deltas]
        if keep is not None and any(m.partition_by not in d.on for d in m.deltas):
            base = m.files
        out = self._apply(m, self._frame(m, base), pruned)
        return out if keep is None else out.where(F.col(m.partition_by).isin(sorted(keep)))

    def _apply(self, m: Manifest, base: DataFrame, deltas: Sequence[Delta]) -> DataFrame:
        """Runs of whole-row upserts with equal conditions are one pass; others are merged one by one."""
        out, i = base, 0
        while i < len(deltas):
            d = deltas[i]
            plain = lambda x: x.mode == MergeMode.UPDATE_INSERT.value and not x.update_columns and x.on == d.on  # noqa: B023, E731
            j = i + 1
            while plain(d) and j < len(deltas) and plain(deltas[j]):
                j += 1
            # uniqueness within a delta was enforced when it was written
            spec = MergeSpec(tuple(d.on), MergeMode(d.mode), tuple(d.update_columns), "latest")
            frames = [self._frame(m, x.files) for x in deltas[i:j]]
            out = replay(out, frames, spec) if plain(d) else merge(out, frames[0], spec)
            i = j
        return out

    # ------------------------------------------------------------ writing

    def create(self, df: DataFrame, *, partition_by: str | None = None, merge_on_read: bool = False, cluster_by: Sequence[str] = (), token: str | None = None, replace: bool = False) -> None:
        """The first version with the rows of df, or with `replace` the next one with these rows alone."""
        files, cluster_by = self._write(df, partition_by, cluster_by), list(cluster_by)
        schema = df.schema.json()
        if not self.exists():
            self._put(Manifest(1, schema, partition_by, merge_on_read, cluster_by, files, [], {token: 1} if token else {}))
        elif replace:
            self._commit(None, lambda m: Manifest(0, schema, partition_by, merge_on_read, cluster_by, files, [], {token: m.version + 1} if token else {}))
        else:
            raise FileExistsError(self.path)

    def append(self, df: DataFrame, token: str | None = None) -> bool:
        m = self.manifest()
        if token is not None and token in m.tokens:
            return False
        schema = StructType.fromJson(json.loads(m.schema))
        files = self._write(df.select(*schema.names), m.partition_by, m.cluster_by)

        def change(now: Manifest) -> Manifest:
            if now.deltas:
                # deltas must not change rows that came after them, so they are folded into base files first
                now.files = self._write(self._apply(now, self._frame(now, now.files), now.deltas), now.partition_by, now.cluster_by)
                now.deltas = []
            now.files = [*now.files, *files]
            return now

        return self._commit(token, change)

    def merge(self, source: DataFrame, spec: MergeSpec, token: str | None = None) -> bool:
        m = self.manifest()
        if token is not None and token in m.tokens:
            return False
        names = StructType.fromJson(json.loads(m.schema)).names
        missing = set(names) - set(source.columns)
        if missing:
            raise ValueError(f"the source lacks {sorted(missing)}")
        source = source.select(*names)
        return self._merge_on_read(m, source, spec, token) if m.merge_on_read else self._commit(token, lambda now: self._rewritten(now, source, spec))

    def _merge_on_read(self, m: Manifest, source: DataFrame, spec: MergeSpec, token: str | None) -> bool:
        files = self._write(unique_source(source, spec), m.partition_by, m.cluster_by)

        def change(now: Manifest) -> Manifest:
            now.deltas = [*now.deltas, Delta(now.version + 1, files, list(spec.on), spec.mode.value, list(spec.update_columns))]
            return now

        return self._commit(token, change)

    def _rewritten(self, m: Manifest, source: DataFrame, spec: MergeSpec) -> Manifest:
        by = m.partition_by
        if not by:
            old, rest = m.files, []
        else:
            touched = {r[0] for r in source.select(F.col(by).cast("string")).distinct().collect()}
            if by not in spec.on:
                # a match may lie in any partition: find those that hold one, by keys alone
                whole = self._frame(m, m.files)
                keys = source.select(*(F.col(c).alias(f"__s_{c}") for c in spec.on))
                condition = F.lit(True)
                for c in spec.on:
                    condition = condition & (whole[c] == keys[f"__s_{c}"])
                touched |= {r[0] for r in whole.join(keys, condition, "left_semi").select(F.col(by).cast("string")).distinct().collect()}
            old, rest = [f for f in m.files if f.partition in touched], [f for f in m.files if f.partition not in touched]
        new = self._write(merge(self._frame(m, old), source, spec), by, m.cluster_by)
        m.files = [*rest, *new]
        return m

    # ------------------------------------------------------------ service

    def compact(self, min_file_size: int = 100 << 20, target_file_size: int = 120 << 20) -> bool:
        """Folds deltas and packs files smaller than min_file_size into files of about target_file_size. False: nothing to do."""
        seen = self.manifest()
        by_partition: dict[str | None, list[DataFile]] = {}
        for f in seen.files:
            by_partition.setdefault(f.partition, []).append(f)
        small = [f for fs in by_partition.values() if len([f for f in fs if f.bytes < min_file_size]) > 1 for f in fs if f.bytes < min_file_size]
        old = seen.files if seen.deltas else small
        if not old and not seen.deltas:
            return False
        size = sum(f.bytes for f in old) + sum(f.bytes for d in seen.deltas for f in d.files)
        packed = self._apply(seen, self._frame(seen, old), seen.deltas)
        if seen.partition_by:
            packed = self._dealt(packed, seen.partition_by, [*old, *(f for d in seen.deltas for f in d.files)], target_file_size)
        else:
            pieces = max(1, -(-size // target_file_size))
            packed = packed.repartition(pieces) if pieces > 1 else packed.coalesce(1)
        new = self._write(packed, seen.partition_by, seen.cluster_by)
        gone = {f.path for f in old}
        folded = {d.version for d in seen.deltas}

        def change(now: Manifest) -> Manifest | None:
            if not gone <= {f.path for f in now.files} or not folded <= {d.version for d in now.deltas}:
                raise CommitConflict("a writer replaced files that were being compacted")
            now.files = [*(f for f in now.files if f.path not in gone), *new]
            now.deltas = [d for d in now.deltas if d.version not in folded]
            return now

        return self._commit(None, change)

    def _dealt(self, df: DataFrame, by: str, files: Sequence[DataFile], target: int) -> DataFrame:
        """Rows dealt over tasks of about `target` bytes of the files they come from: a large partition takes several tasks, small ones share one.

        A partition's tasks get a target each or more, so that their files are not packed again.
        """
        sizes: dict[str | None, int] = {}
        for f in files:
            sizes[f.partition] = sizes.get(f.partition, 0) + f.bytes
        places, tasks, room = [], 0, 0
        for value, size in sizes.items():
            if size > room:
                own = max(1, size // target)
                places.append((value, tasks, own))
                tasks, room = tasks + own, max(0, target - size)
            else:
                places.append((value, tasks - 1, 1))
                room -= size
        where = F.broadcast(self.spark.createDataFrame(places, "__value string, __first int, __own int"))
        name = F.col(by).cast("string")
        # an empty name's folder is that of NULL
        found = df.join(where, F.when(name != "", name).eqNullSafe(F.col("__value")), "left")
        # maps and variants have no hash
        hashed = [f.name for f in df.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
        task = F.coalesce(F.col("__first") + F.pmod(F.xxhash64(*hashed), F.col("__own")), F.lit(0)).cast("int")
        return found.repartitionById(max(1, tasks), task).select(*df.columns)

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Deletes manifests but the newest, then files that none of the kept lists. Not while others read or write."""
        versions = self.versions()
        for v in versions[:-keep_versions]:
            self.files.delete(f"{MANIFESTS}/v{v:08d}.json")
        used = {f.path for v in versions[-keep_versions:] for m in [self.manifest(v)] for f in [*m.files, *(x for d in m.deltas for x in d.files)]}
        gone = [n for n, _ in self.files.tree(DATA) if n.endswith(".parquet") and n not in used]
        for n in gone:
            self.files.delete(n)
        return gone
