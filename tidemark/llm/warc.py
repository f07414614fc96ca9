"""WARC archives: writing, normalising monolithic gzip, reading by index.

`write` packs pages into archives that are one gzip stream each, as many tools make them: such an
archive cannot be read from the middle. `normalise` inflates an archive once, in one pass of bounded memory,
and rewrites every record as a gzip member of its own, with a sidecar index (a line of JSON for each record:
offset, length, type, id, uri, digest). It takes archives of one or of many members. On the way it turns
records whose payload stands elsewhere already into revisits without payload. `read` opens each record by the
offsets of the sidecar alone.

Archives are written under names with the task's attempt, and only names of tasks that succeeded reach
the stored listing, so lost executors and speculative copies leave unused files and nothing else. All archives
are in the shared folder; tasks open it by its URI.

Defined cases: a null html is an empty payload; a null url is an empty target URI, and line breaks in one are
percent-encoded; payloads shorter than `least` bytes are never revisits; of equal payloads the row with the least
page_id (nulls last, then by archive and place) is the response, also among repeated rows; an empty
table gives no archive and an empty result; other columns are not stored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import count

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, scratch, stored

LEAST, LEVEL, ARCHIVE_BYTES, ARCHIVE_RECORDS, CHUNK = 100, 3, 64 << 20, 4096, 1 << 18
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def qualified(spark: SparkSession, path: str) -> str:
    """A URI that pyarrow opens too."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def record_id(page_id, digest: str, place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{place}')}>"


def head(fields: dict) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode()


def parse_head(raw: bytes) -> dict[str, str]:
    """Field names in lower case."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Inflater:
    """Bytes of a gzip stream of one or more members, read once and never held whole."""

    def __init__(self, source):
        self.source, self.gunzip, self.buffer, self.ended = source, zlib.decompressobj(31), bytearray(), False
        self.rest = b""

    def more(self) -> bool:
        while not self.ended:
            raw = self.rest or self.source.read(CHUNK)
            self.rest = b""
            if not raw:
                self.ended = True
                break
            if self.gunzip.eof:
                self.gunzip = zlib.decompressobj(31)
            got = self.gunzip.decompress(raw, 4 * CHUNK)
            self.rest = self.gunzip.unused_data or self.gunzip.unconsumed_tail
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Through the next mark; None at the end of the stream."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("the archive ends within a record")
                return None
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise ValueError("the archive ends within a record")
            out = bytes(self.buffer[:n])
            del self.buffer[: len(out)]
            n -= len(out)
            yield out


def normalise_stream(source, target, revisits: dict[int, dict], level: int = LEVEL) -> Iterator[dict]:
    """Copies records from source to target, each as its own member; yields their index entries.

    revisits: by the record's place in the archive, fields to add to a record that becomes a revisit.
    """
    stream, offset = Inflater(source), 0
    for place in count():
        raw = stream.until(END)
        if raw is None:
            return
        fields = parse_head(raw.lstrip(b"\r\n"))
        left = int(fields["content-length"])
        packer, written = zlib.compressobj(level, zlib.DEFLATED, 31), 0

        def put(data: bytes) -> None:
            nonlocal written
            packed = packer.compress(data)  # noqa: B023
            written += len(packed)
            target.write(packed)

        kind = fields.get("warc-type", "")
        if place in revisits:
            # the HTTP headers stay, with the length of the payload that is left out
            block, http = bytearray(), b""
            for piece in stream.take(left):
                if not http:
                    block += piece
                    if (at := block.find(END)) >= 0:
                        http = bytes(block[: at + 4])
                        block.clear()
            kind = "revisit"
            put(head({"WARC-Type": kind} | _titled({k: v for k, v in fields.items() if k not in ("warc-type", "content-length")}) | {"WARC-Profile": PROFILE} | revisits[place] | {"Content-Length": len(http)}) + http)
        else:
            put(raw.lstrip(b"\r\n"))
            for piece in stream.take(left):
                put(piece)
        put(END)
        tail = packer.flush()
        target.write(tail)
        written += len(tail)
        for _ in stream.take(4):
            pass
        yield {"offset": offset, "length": written, "type": kind, "id": fields.get("warc-record-id", ""), "uri": fields.get("warc-target-uri", ""), "digest": fields.get("warc-payload-digest", "")}
        offset += written


def _titled(fields: dict[str, str]) -> dict[str, str]:
    special = {"warc": "WARC", "id": "ID", "uri": "URI"}
    return {"-".join(special.get(x, x.capitalize()) for x in k.split("-")): v for k, v in fields.items()}


def _writer(folder: str, level: int, most_bytes: int, most_records: int):
    schema = pa.schema([("archive", pa.string()), ("place", pa.int32()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("record_id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        stem, made = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", 0
        out = packer = None
        size = place = 0
        name = ""
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if out is None:
                    name = f"{stem}-{made:05d}.warc.gz"
                    out, packer, size, place = disk.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                    made += 1
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = sha256(payload).hexdigest()
                ident = record_id(page_id, digest, f"{name}/{place}")
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                uri = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in (url or "") or "\n" in (url or "") else url or ""
                fields = {"WARC-Type": "response", "WARC-Record-ID": ident, "WARC-Date": DATE, "WARC-Target-URI": uri, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}"}
                if page_id is not None:
                    fields["WARC-Page-ID"] = page_id
                data = head(fields | {"Content-Length": len(http) + len(payload)}) + http + payload + END
                out.write(packer.compress(data))
                rows.append((name, place, page_id, len(payload), digest, ident))
                size, place = size + len(data), place + 1
                if size >= most_bytes or place >= most_records:
                    out.write(packer.flush())
                    out.close()
                    out = None
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
        if out is not None:
            out.write(packer.flush())
            out.close()

    return run


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = LEVEL, archive_bytes: int = ARCHIVE_BYTES, archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Archives of one gzip stream each in `folder`; returns the stored listing of their records."""
    disk, base = fs.FileSystem.from_uri(folder)
    disk.create_dir(base, recursive=True)
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return stored(rows.mapInArrow(_writer(folder, level, archive_bytes, archive_records), "archive string, place int, page_id long, payload_bytes long, digest string, record_id string"), "warc-listing")


def revisits(listing: DataFrame, least: int = LEAST) -> DataFrame:
    """The listing's records whose payload an earlier one holds: archive, place, refers_to (its page_id) and refers_id."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "place", "record_id")
    long = listing.where(F.col("payload_bytes") >= least)
    first = long.groupBy("digest", "payload_bytes").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = long.join(first, ["digest", "payload_bytes"]).where("not (archive = first.archive and place = first.place)")
    return same.select("archive", "place", F.col("first.page_id").alias("refers_to"), F.col("first.record_id").alias("refers_id"))


def _tasks(archives: int) -> int:
    """Partitions for so many archives: about one each, until tasks would be too many to schedule."""
    return max(1, min(2 * archives, 20_000))


def normalise(listing: DataFrame, folder: str, target: str, *, least: int = LEAST, level: int = LEVEL) -> DataFrame:
    """Normalised archives and sidecars in `target`; returns the stored names of the archives with their numbers of records.

    A task holds the places of one archive's revisits, `archive_records` at most, and no record's whole payload.
    """
    disk, base = fs.FileSystem.from_uri(target)
    disk.create_dir(base, recursive=True)
    marks = listing.select("archive").distinct().withColumns({"place": F.lit(-1), "refers_to": F.lit(None).cast("long"), "refers_id": F.lit(None).cast("string")})
    todo = marks.unionByName(revisits(listing, least))

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        name = rows[0]["archive"]
        turned = {r["place"]: {"WARC-Refers-To": r["refers_id"]} | ({} if r["refers_to"] is None else {"WARC-Refers-To-Page-ID": r["refers_to"]}) for r in rows if r["place"] >= 0}
        source, here = fs.FileSystem.from_uri(folder)
        disk, there = fs.FileSystem.from_uri(target)
        made = f"{name.removesuffix('.warc.gz')}-{TaskContext.get().taskAttemptId()}.warc.gz"
        n = 0
        with source.open_input_stream(f"{here}/{name}", compression=None) as src, disk.open_output_stream(f"{there}/{made}", compression=None) as dst, disk.open_output_stream(f"{there}/{made}.idx", compression=None) as idx:
            for entry in normalise_stream(src, dst, turned, level):
                idx.write(json.dumps(entry).encode() + b"\n")
                n += 1
        return pa.table({"archive": pa.array([made], pa.string()), "records": pa.array([n], pa.int64())})

    # rows are few and small but each archive is much work: a stated number of partitions is never coalesced
    todo = todo.repartition(_tasks(marks.count()), "archive")
    return stored(todo.groupBy("archive").applyInArrow(run, "archive string, records long"), "warc-archives")


def read(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of normalised archives, opened by the sidecar's offsets: uri, page_id, record_type, digest, payload_bytes, refers_to, payload (null for revisits)."""
    schema = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with disk.open_input_stream(f"{base}/{name}.idx", compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                rows, size = [], 0
                with disk.open_input_file(f"{base}/{name}") as f:
                    for e in entries:
                        f.seek(e["offset"])
                        rows.append(_record(zlib.decompress(f.read(e["length"]), 31)))
                        size += len(rows[-1]["payload"] or b"")
                        if size >= 4 * CHUNK or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    spread = archives.select("archive").repartition(_tasks(archives.count()), "archive")
    return spread.mapInArrow(run, "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def _record(raw: bytes) -> dict:
    at = raw.index(END) + 4
    fields = parse_head(raw[:at])
    block = raw[at : at + int(fields["content-length"])]
    http = block.index(END) + 4
    kind, number = fields["warc-type"], lambda k: int(fields[k]) if k in fields else None
    own = {"page_id": number("warc-page-id"), "uri": fields["warc-target-uri"], "record_type": kind, "refers_to": number("warc-refers-to-page-id")}
    if kind == "revisit":
        return own | {"payload_bytes": int(parse_head(block[:http])["content-length"]), "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:"), "payload": None}
    payload = block[http:]
    return own | {"payload_bytes": len(payload), "payload_digest": sha256(payload).hexdigest(), "payload": payload}


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Pages written as monolithic archives, normalised, and read back by index. The monolithic archives go once all are normalised."""
    spark = pages.sparkSession
    raw, clean = (qualified(spark, scratch(spark, label)) for label in ("warc-raw", "warc"))
    listing = write(pages, raw, **options)
    archives = normalise(listing, raw, clean)
    discard(listing)
    disk, base = fs.FileSystem.from_uri(raw)
    disk.delete_dir(base)
    return read(archives, clean)
