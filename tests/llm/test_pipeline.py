"""The pipeline, stage by stage, against what each stage must do by hand."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.helpers import AWKWARD, DOCS, awkward, empty
from tests.llm.test_archives import brute_targets
from tests.llm.test_learned import SYLLABLES, prose
from tests.llm.test_matching import brute_classes, plain
from tidemark.llm import language_mixture
from tidemark.llm.common import shared_dir, stored

SECRET = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(1)
    items = [(i, prose(draw, lang, 20)) for i, lang in enumerate(sorted(SYLLABLES))]
    data = []
    for i in range(160):
        lang = sorted(SYLLABLES)[i % 3]
        text = prose(draw, lang, draw.randint(30, 90))
        if i % 10 == 1:
            text = data[-1][1] if i % 20 == 1 else " ".join([*data[-1][1].split()[:-1], "zz"])
        if i % 16 == 3:
            text += ". " + items[i % 3][1].upper()
        if i % 8 == 5:
            text += f'\ntoken = "{SECRET}"'
        data.append((i, text, lang, draw.choice(["s1", "s2", None]), len(text)))
    data += [(900, None, None, "s1", None), (901, "", "aa", "s1", 0), (902, "12 34 !!", "aa", "s1", 8)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(data, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {d[0]: d for d in data}, items


def test_stages(spark, folder):
    path, data, items = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), dict(data)
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "source_mix"] and pipeline.ORACLE_SQL is None
    for name, stage in pipeline.STAGES:
        columns = docs.columns
        docs = stored(stage(spark, docs, path), name)
        out = {r.doc_id: tuple(r) for r in docs.collect()}
        assert docs.count() == len(out)
        if name == "language_id":
            kept = {i: d for i, d in kept.items() if re.search(r"[^\W\d_]", d[1] or "")}
        elif name == "near_dedup":
            classes = brute_classes(list(kept.values()))
            kept = {i: d for i, d in kept.items() if classes[i] == i}
            assert len(kept) < len(classes)
        elif name == "decontamination":
            kept = {i: d for i, d in kept.items() if not any(plain(t) in plain(d[1]) for _, t in items)}
        elif name == "secret_scan":
            clean = {i: d[1].replace(SECRET, "[secret]") for i, d in kept.items()}
            assert clean != {i: d[1] for i, d in kept.items()}
            kept = {i: (d[0], clean[i], d[2], d[3], len(clean[i])) for i, d in kept.items()}
        if name != "source_mix":
            assert docs.columns == columns and out == kept
    assert docs.columns == [*columns, "copies"] and {i: r[:-1] for i, r in out.items()} == {i: kept[i] for i in out}
    sizes, taken = {}, {}
    for i, d in kept.items():
        n = len(d[1].split())
        sizes[d[3]] = sizes.get(d[3], 0) + n
        if i in out:
            assert 1 <= out[i][-1] <= 3
            taken[d[3]] = taken.get(d[3], 0) + n * out[i][-1]
    names = ["s1", "s2", None]
    for s, goal in zip(names, brute_targets([sizes[s] for s in names], [5.0, 2.0, 1.0]), strict=True):
        assert abs(taken[s] - goal) < 5
    again = pipeline.run(spark, path)
    assert {r.doc_id: tuple(r) for r in again.collect()} == out


@pytest.mark.parametrize("at", range(5))
def test_stages_awkward(spark, folder, at):
    name, stage = pipeline.STAGES[at]
    out = stage(spark, awkward(spark), folder[0])
    if at < 4:
        assert out.columns == awkward(spark).columns
    n = out.count()
    assert n == len(AWKWARD) if name in ("decontamination", "secret_scan") else 0 <= n <= len(AWKWARD)
    assert stage(spark, empty(spark), folder[0]).count() == 0


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert {"op2_license_index", "op4_warc", "op6_url_sweep"} <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["op2_license_index", "op4_warc", "op6_url_sweep"])
def test_sql(spark, name):
    import duckdb

    from tidemark.llm.registry import QUERIES, SQL

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    expected = con.execute(SQL[name]).fetchall()
    columns = [c[0] for c in con.description]
    assert sorted(map(tuple, QUERIES[name](spark, data).select(*columns).collect()), key=repr) == sorted(expected, key=repr)


def test_native_queries_run_no_python(spark):
    from tidemark.llm.registry import QUERIES

    for n in ("op1_", "op2_", "op10_"):
        name = next(q for q in QUERIES if q.startswith(n))
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|MapInArrow|InArrow", plan)


def test_held_out_is_crc32(spark):
    from tests.llm.helpers import held
    from tidemark.llm.common import held_out

    rows = spark.createDataFrame([(i,) for i in [*range(50), None]], "i long").select("i", held_out(F.col("i")).alias("h")).collect()
    assert all(r.h == held(r.i) for r in rows)


def test_documents_in_three_languages_stay(spark, folder):
    draw = random.Random(8)
    mixed = " ".join(prose(draw, lang, 60) for lang in sorted(SYLLABLES)[:3])
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(9001, mixed, None, "s1", len(mixed)), (9002, "12 34", None, "s1", 5)], DOCS))
    found = language_mixture.detect(docs, language_mixture.fit(docs)).where("doc_id = 9001").first().language
    assert found.score < 0.5 and len(found.languages) == 3
    assert {r.doc_id for r in pipeline.language_id(spark, docs, "").where("doc_id > 9000").collect()} == {9001}


def test_near_dedup_keeps_no_words_on_disk(spark, folder):
    """Of the tables of the duplicate search, what holds words or sketches is deleted when the stage is planned."""
    path, _, _ = folder
    shared = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    kept = pipeline.near_dedup(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - before}
    assert "omh-classes" in left and not left & {"omh-prints", "omh-nodes", "omh-words", "omh-buckets"}, left
    assert kept.count() > 0
