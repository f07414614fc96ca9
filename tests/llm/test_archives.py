"""Archives, url rules and mixing."""

import gzip
import hashlib
import io
import json
import random
import zlib

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, DOCS, awkward, empty
from tidemark.llm import cube_mixing, url_sweep, warc
from tidemark.llm.common import scratch

PAGES = "page_id long, url string, html string"


def pages():
    draw = random.Random(1)
    body = lambda n: "".join(draw.choices("abc é\n\r", k=n))
    data = [(i, f"http://x/{i}", body(draw.choice([0, 5, 99, 100, 300, 5000]))) for i in range(60)]
    data += [(100, None, None), (None, "http://n", body(150)), (101, "http://a\r\nb", "same " * 40), (90, "http://c", "same " * 40), (102, "", "same " * 40), (102, "", "same " * 40), (103, "u", "tiny"), (104, "u", "tiny"), (105, "u", "x" * 2_000_000)]
    return data


def test_round_trip(spark):
    data = pages()
    raw, clean = (warc.qualified(spark, scratch(spark, x)) for x in ("raw", "clean"))
    listing = warc.write(spark.createDataFrame(data, PAGES).repartition(3), raw, archive_records=10)
    archives = warc.normalise(listing, raw, clean)
    assert archives.agg(F.sum("records")).first()[0] == len(data) and archives.count() >= 7
    rows = warc.read(archives, clean).collect()
    expected = []
    for p, _, html in data:
        body = (html or "").encode()
        first = min((q for q, _, h in data if (h or "").encode() == body and q is not None), default=p)
        again = len(body) >= 100 and p is not None and first < p
        expected.append((p, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None, None if again else body))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in rows]
    # of two equal rows, one is the response of none but the other's
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    disk, base = fs.FileSystem.from_uri(clean)
    for name in [r.archive for r in archives.collect()]:
        whole = disk.open_input_file(f"{base}/{name}").read()
        index = [json.loads(x) for x in disk.open_input_file(f"{base}/{name}.idx").read().splitlines()]
        assert sum(e["length"] for e in index) == len(whole)
        for e in index:  # each record is a member by itself
            one = zlib.decompress(whole[e["offset"] : e["offset"] + e["length"]], 31)
            assert one.startswith(b"WARC/1.1\r\n") and one.endswith(warc.END) and e["id"].encode() in one
        assert gzip.decompress(whole).count(b"WARC/1.1\r\n") == len(index)


def test_normaliser_takes_any_members():
    record = lambda body: warc.head({"WARC-Type": "resource", "WARC-Record-ID": "<x>", "Content-Length": len(body)}) + body + warc.END
    bodies = [b"a" * 10, b"", b"\r\n\r\n" * 5, random.Random(2).randbytes(700_000)]
    flat = b"".join(map(record, bodies))
    cuts = [flat, flat[:7], flat[7:100_000], flat[100_000:]]
    for packed in (gzip.compress(cuts[0]), b"".join(gzip.compress(c) for c in cuts[1:]), b"".join(gzip.compress(record(b)) for b in bodies)):
        out = io.BytesIO()
        index = list(warc.normalise_stream(io.BytesIO(packed), out, {}))
        assert gzip.decompress(out.getvalue()) == flat and len(index) == 4
        last = zlib.decompress(out.getvalue()[index[3]["offset"] :], 31)
        assert last == record(bodies[3])
    with pytest.raises((ValueError, EOFError, zlib.error)):
        list(warc.normalise_stream(io.BytesIO(gzip.compress(flat[:-50])), io.BytesIO(), {}))


def test_archives_awkward(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    clash = spark.createDataFrame([(1, "u", "h")], PAGES).withColumns({"digest": F.lit(1), "archive": F.lit(2), "payload": F.lit(3)})
    assert warc.round_trip(clash).first().payload == b"h"


def brute_rule(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((max(fit)[3], max(fit)[2]) if fit else (None, "allow"))


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_rules_equal_brute_force(spark, block):
    draw = random.Random(3)
    labels, paths = ["com", "net", "a", "b", "www", "example", "a-b", "é", ""], ["", "/", "/en", "/en/", "/en/x", "/fr/"]
    host = lambda n: ".".join(draw.choices(labels, k=draw.randint(1, n)))
    rules = [(h, draw.choice(paths), draw.choice(["allow", "block"])) for _ in range(40) if (h := host(3))]
    urls = [f"{draw.choice(['http', 'HTTPS', ''])}://{host(5).title()}{draw.choice(paths)}{draw.choice(['', '?q=/en/', '#x', 'y'])}" for _ in range(400)] + [None, "", "no scheme", "://", "x://?a", "a://b://c/"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").repartition(3)
    odd = [*rules, (None, "/", "block"), ("x", None, None), ("", "/", "block")]
    out = url_sweep.judge(frame, spark.createDataFrame(odd, "host string, path string, verdict string"), block_bytes=block).collect()
    assert len(out) == len(urls)
    for r in out:
        assert tuple(r.rule_match) == brute_rule(urls[r.i], rules)


def test_rules_awkward(spark):
    rules = spark.createDataFrame([("x", "/", "block")], "host string, path string, verdict string")
    frame = spark.createDataFrame([("u1", "http://x/", 1), ("u1", "http://x/", 1)], "host string, url string, rule int").withColumn("__key", F.lit(1))
    out = url_sweep.judge(frame, rules).collect()
    assert len(out) == 2 and out[0].rule_match.verdict == "block" and out[0].host == "u1" and out[0].rule == 1
    assert url_sweep.judge(frame.where("false"), rules).count() == 0
    assert url_sweep.judge(frame, rules.where("false"), default="block").first().rule_match.rule is None


def brute_targets(sizes, weights, most=3.0):
    """Shares by weight; what is over the limit is shared again among the others until none is above."""
    out, full, left = [0.0] * len(sizes), set(), float(sum(sizes))
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        total = sum(weights[i] for i in free)
        share = {i: left * weights[i] / total for i in free}
        over = [i for i in free if share[i] > most * sizes[i] + 1e-9]
        if not over:
            for i in free:
                out[i] = share[i]
            return out
        for i in over:
            out[i] = most * sizes[i]
            full.add(i)
            left -= out[i]


def test_targets_equal_brute_force():
    draw = random.Random(4)
    for _ in range(200):
        sizes = [draw.choice([0, 1, 5, 100, 10_000]) for _ in range(draw.randint(1, 12))]
        weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
        if sum(sizes):
            assert cube_mixing.targets(sizes, weights) == pytest.approx(brute_targets(sizes, weights))


def test_flight_keeps_sums():
    import numpy as np

    draw = random.Random(5)
    for n in (0, 1, 3, 50, 400):
        p = [0.37] * n
        words = [float(draw.choice([1, 5, 5, 80, 3000])) for _ in range(n)]
        rows = [float(draw.choice([1, 1, 2])) for _ in range(n)]
        for out in (cube_mixing.flight(p, rows, words, np.random.default_rng(1)), cube_mixing.heavy_first(np.array(p), np.array(rows), np.array(words), np.random.default_rng(1)) if n else p):
            assert all(0 <= x <= 1 for x in out)
            for weight in (rows, words):
                assert sum(a * b for a, b in zip(out, weight, strict=True)) == pytest.approx(0.37 * sum(weight), abs=1e-5)
        assert sum(0 < x < 1 for x in cube_mixing.flight(p, rows, words, np.random.default_rng(1))) <= 2
    mean = np.mean([cube_mixing.flight([0.3] * 9, [1.0] * 9, [1.0, 2, 3, 4, 5, 6, 7, 8, 9], np.random.default_rng(s)) for s in range(3000)], axis=0)
    assert np.allclose(mean, 0.3, atol=0.03)  # fair for each document


@pytest.mark.parametrize("chunk", [2048, 40])
def test_mix(spark, chunk):
    draw = random.Random(6)
    data = [(i, " ".join("w" for _ in range(draw.choice([0, 1, draw.randint(2, 300), draw.randint(100, 400), draw.randint(100, 5000)]))), None, draw.choice(["a", "b", "c", "d", None]), 0) for i in range(1500)]
    frame = spark.createDataFrame(data, DOCS).repartition(3)
    out = cube_mixing.mix(frame, chunk=chunk).collect()
    assert len(out) == 1500
    sizes = {d[0]: len((d[1] or "").split()) for d in data}
    by = {}
    for r in out:
        assert r.size == sizes[r.doc_id] and r.taken == r.copies * r.size <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    names = sorted(s for s in by if s) + [None]
    totals = [sum(r.size for r in by[s]) for s in names]
    for s, size, goal in zip(names, totals, brute_targets(totals, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))]), strict=True):
        assert {r.source_size for r in by[s]} == {size} and by[s][0].target == pytest.approx(goal)
        assert abs(sum(r.taken for r in by[s]) - goal) < 5
        rate = goal / size
        assert {r.copies for r in by[s] if r.size} <= {int(rate), int(rate) + 1}
    again = cube_mixing.mix(spark.createDataFrame(data, DOCS).repartition(5), chunk=chunk).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)


def test_mix_awkward(spark):
    out = cube_mixing.mix(awkward(spark)).collect()
    assert len(out) == len(AWKWARD) and sum(r.size for r in out) == sum(len((d[1] or "").split()) for d in AWKWARD)
    assert all(r.taken == 0 for r in out if r.size == 0)
    kept = cube_mixing.taken(awkward(spark))
    assert kept.columns == [c for c in awkward(spark).columns if c != "copies"] + ["copies"]
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted((r.doc_id or 0) for r in out if r.copies)
    assert cube_mixing.mix(empty(spark)).count() == 0 and cube_mixing.taken(empty(spark)).count() == 0
