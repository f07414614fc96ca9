"""Small files and listings on whatever file system Spark is configured for."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Files:
    """The Hadoop file system of a path."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def tree(self, name: str) -> list[tuple[str, int]]:
        """All files below, relative to the root, with their sizes."""
        found, out = self._fs.listFiles(self._path(name), True), []
        base = self._fs.makeQualified(self._path("")).toUri().getPath().rstrip("/") + "/"
        while found.hasNext():
            status = found.next()
            out.append((status.getPath().toUri().getPath().removeprefix(base), status.getLen()))
        return sorted(out)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        """False if new is there already. Of several writers one succeeds on HDFS and local disks; not so on object stores.

        HDFS refuses an existing target in the rename itself. A local rename would replace it, so there the new name is a hard link,
        which the file system makes only if the name is free.
        """
        if self.exists(new):
            return False
        if self._fs.getScheme() != "file":
            return self._fs.rename(self._path(old), self._path(new))
        here, there = (self._path(n).toUri().getPath() for n in (old, new))
        os.makedirs(os.path.dirname(there), exist_ok=True)
        try:
            os.link(here, there)
        except FileExistsError:
            return False
        self.delete(old)
        return True

    def delete(self, name: str = "") -> bool:
        return self._fs.delete(self._path(name), True)


def round_exists(spark: SparkSession, path: str, round_no: int) -> bool:
    """Whether the round's folder holds any file."""
    return bool(Files(spark, path).names(str(round_no)))


def read_round(spark: SparkSession, path: str, round_no: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{round_no}")


def read_history(spark: SparkSession, path: str, before: int, start: int = 0) -> DataFrame:
    """Rounds start to before - 1, named one by one: later rounds, or the one being written, never leak in."""
    return spark.read.parquet(*(f"{path}/{r}" for r in range(start, before)))


def external_view(spark: SparkSession, path: str, name: str, schema: StructType) -> DataFrame:
    """A view of a folder with the given columns, matched by name and cast; nothing is copied."""
    df = spark.read.parquet(path)
    own = df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in schema))
    own.createOrReplaceTempView(name)
    return own


def _parsed(path: str, kind) -> list:
    out = []
    for line in Path(path).read_text().splitlines():
        try:
            out.append(kind(line.strip()))
        except ValueError:
            continue
    return out


def load_doubles(path: str) -> list[float]:
    """Numbers of a local text file, one a line; other lines are skipped."""
    return _parsed(path, float)


def load_longs(path: str) -> list[int]:
    return _parsed(path, int)


def write_round(df: DataFrame, path: str, round_no: int, files: int) -> None:
    df.repartition(files).write.mode("overwrite").parquet(f"{path}/{round_no}")

