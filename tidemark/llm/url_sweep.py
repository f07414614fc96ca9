"""URL filter rules by a sort-merge range join.

A host's canonical key is its labels in reverse, each followed by a dot: `www.example.com` is
`com.example.www.`. A rule for a host and its subdomains is then the interval of all keys that begin with the
rule's, and intervals of two rules are nested or apart. Urls are sorted by key within their
partitions (no shuffle), rules once; a sweep merges both and keeps a stack of the rules whose intervals are
open. Of the rules on the stack whose path begins the url's path, the longest (host and path together,
then host) decides; among equal rules with different verdicts the greatest verdict does (`block` over `allow`).

Rules are a query set: they are read in blocks of at most `block_bytes`, each is sent to all
tasks, and the longest rule over all blocks wins.

Defined cases: a null url or one without `://` has empty host and path, and fits no rule of a
non-empty host; rules with a null or empty field host or verdict are ignored, a null path is empty; urls that no
rule fits get `default`; repeated rows are judged alike; columns named like the result's are replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import free_name

DEFAULT, BLOCK_BYTES = "allow", 8 << 20
FOUND = "struct<length:int,host_length:int,verdict:string,rule:string>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def key_of(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def sweep(rules: list[tuple[str, list[tuple[int, int, str, str, str]]]]):
    """A function from (key, path), called in the order of keys, to the best rule or None.

    rules: keys in order, each with (length, length of host, verdict, rule, path) of its rules, best first.
    """
    stack: list = []
    at = 0

    def best(key: str, path: str):
        nonlocal at
        while at < len(rules) and rules[at][0] <= key:
            while stack and not rules[at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        fit = [r[:4] for _, own in stack for r in own if path.startswith(r[4])]
        return max(fit) if fit else None

    return best


def judge(urls: DataFrame, rules: DataFrame, *, url_col: str = "url", out: str = "rule_match", default: str = DEFAULT, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """urls (or its columns `keep`) with a struct: host, path, rule (null if none fits) and verdict. rules: host, path, verdict."""
    keep = [c for c in (urls.columns if keep is None else keep) if c.lower() != out.lower()]
    quoted = ["`" + c.replace("`", "``") + "`" for c in keep]
    whole = rules.select(F.translate(F.col("host").cast("string"), _UPPER, _LOWER).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict")).where("host <> '' and verdict is not null").distinct()
    size = whole.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    host, path = parts(F.col("`" + url_col.replace("`", "``") + "`").cast("string"))
    h, p, k = (free_name(urls, x) for x in ("host", "path", "key"))
    done = urls.select(*quoted, host.alias(h), path.alias(p)).withColumn(k, F.concat(F.concat_ws(".", F.reverse(F.split(F.col(h), r"\.", -1))), F.lit("."))).sortWithinPartitions(k)
    names = []
    for b in range(blocks):
        by: dict[str, list] = {}
        for r in whole.where(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == b).collect():
            by.setdefault(key_of(r.host), []).append((len(r.host) + len(r.path), len(r.host), r.verdict, r.host + r.path, r.path))
        ordered = sorted((key, sorted(own, reverse=True)) for key, own in by.items())
        name = free_name(done, f"best{b}")
        names.append(name)
        found = StructType.fromDDL(f"x {FOUND}")["x"].dataType
        done = done.mapInArrow(_merge(ordered, done.columns.index(k), done.columns.index(p)), StructType([*done.schema.fields, StructField(name, found)]))
    best = F.array_max(F.array(*names)) if len(names) > 1 else F.col(names[0])
    verdict = F.coalesce(best["verdict"], F.lit(default).cast(StringType()))
    return done.select(*quoted, F.struct(F.col(h).alias("host"), F.col(p).alias("path"), best["rule"].alias("rule"), verdict.alias("verdict")).alias(out))


def _merge(rules: list, key_at: int, path_at: int):
    kind = pa.struct([("length", pa.int32()), ("host_length", pa.int32()), ("verdict", pa.string()), ("rule", pa.string())])
    names = ("length", "host_length", "verdict", "rule")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = sweep(rules)
        for batch in batches:
            keys, paths = batch.column(key_at).to_pylist(), batch.column(path_at).to_pylist()
            found = [best(k, p) for k, p in zip(keys, paths, strict=True)]
            own = pa.array([dict(zip(names, f, strict=True)) if f else None for f in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "best"])

    return run
