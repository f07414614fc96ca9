"""Language mixtures and nearest-neighbour quality."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, DOCS, awkward, empty, held
from tidemark.llm import knn_quality, language_mixture
from tidemark.llm.common import held_out

SYLLABLES = {"aa": "ba da ka ma na".split(), "bb": "sti ren gel wus tok".split(), "cc": "éou iça ùle ôna vîr".split()}


def prose(draw, lang, words=60):
    return " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(5)
    return [(i, prose(draw, lang), lang, "s", 0) for i in range(240) for lang in [sorted(SYLLABLES)[i % 3]]]


def test_languages_held_out(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS)
    model = language_mixture.fit(docs.where(~held_out(F.col("doc_id"))))
    assert model.languages == ["aa", "bb", "cc"]
    out = {r.doc_id: r.language for r in language_mixture.detect(docs, model, keep=["doc_id"]).collect()}
    tested = [d for d in corpus if held(d[0])]
    assert len(tested) > 20 and all(out[d[0]].lang == d[2] for d in tested)
    assert all(len(x.languages) == 1 and x.score == 1 for x in out.values())


def test_model_is_counts_of_all_texts(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS)
    model = language_mixture.fit(docs)
    counts = np.full((language_mixture.BINS, 3), language_mixture.SMOOTHING)
    for _, text, lang, *_ in corpus:
        code = np.concatenate([c for _, c in language_mixture.trigrams(pa.array([text], pa.large_string()), language_mixture.BINS)])
        np.add.at(counts[:, model.languages.index(lang)], code, 1)
    assert np.allclose(model.table, np.log(counts / counts.sum(0)), atol=1e-5)


def test_mixtures(spark, corpus):
    draw = random.Random(6)
    model = language_mixture.fit(spark.createDataFrame(corpus, DOCS))
    data = [(1, prose(draw, "aa", 90) + " " + prose(draw, "bb", 30), None, None, 0), (2, prose(draw, "cc", 40) + ". " + prose(draw, "aa", 40) + prose(draw, "bb", 40), None, None, 0), (3, "BA! DA? ka-ma", None, None, 0)]
    out = {r.doc_id: r.language for r in language_mixture.detect(spark.createDataFrame(data, DOCS), model).collect()}
    assert out[1].lang == "aa" and {x.lang for x in out[1].languages} == {"aa", "bb"} and 0.4 < out[1].score < 0.9
    assert {x.lang for x in out[2].languages} == {"aa", "bb", "cc"}
    assert out[3].lang == "aa"


def test_em_equals_plain_em():
    """The batch of sparse documents against one document at a time."""
    draw = np.random.default_rng(7)
    table = np.log(draw.dirichlet(np.full(40, 0.3), 3).T + 1e-6).astype(np.float32)
    docs, bins, counts = [], [], []
    for d in (0, 1, 3):
        own = np.sort(draw.choice(40, 15, replace=False))
        docs += [d] * 15
        bins += own.tolist()
        counts += draw.integers(1, 9, 15).tolist()
    docs, bins, counts = np.array(docs), np.array(bins), np.array(counts, np.float32)
    out = language_mixture.mixtures(docs, bins, counts, 4, table, -1e9, 8)  # the largest set wins
    for d in (0, 1, 3):
        p, c, share = np.exp(table[bins[docs == d]].astype(float)), counts[docs == d], np.full(3, 1 / 3)
        for _ in range(8):
            r = p * share
            share = (r / r.sum(1, keepdims=True) * c[:, None]).sum(0) / c.sum()
        assert np.allclose(out[d], share, atol=1e-3)
    assert not out[2].any()


def test_languages_awkward(spark, corpus):
    model = language_mixture.fit(spark.createDataFrame(corpus, DOCS))
    rows = language_mixture.detect(awkward(spark), model).collect()
    assert len(rows) == len(AWKWARD) and rows[0].score == "own score"
    und = [r for r in rows if r.language.lang == "und"]
    assert {r.doc_id for r in und} == {1, 2, 3, 4} and all(r.language.score == 0 and r.language.languages == [] for r in und)
    assert language_mixture.detect(empty(spark), model).count() == 0
    none = language_mixture.fit(empty(spark))
    assert {r.language.lang for r in language_mixture.detect(awkward(spark), none).collect()} == {"und"}


def labelled(n=200):
    draw = random.Random(8)
    good = lambda: " ".join("".join(draw.choices("aeioulmnr", k=draw.randint(2, 8))) for _ in range(50)).capitalize() + "."
    bad = lambda: " ".join("".join(draw.choices("aeioulmnr", k=draw.randint(2, 8))) + draw.choice(["###", "$$$"]) for _ in range(50))
    return [(i, bad() if i % 4 == 0 else good(), "x", "s", 0) for i in range(n)], [(i, int(i % 4 != 0)) for i in range(n)]


def test_quality_held_out_and_brute_force(spark):
    data, labels = labelled()
    docs, marks = spark.createDataFrame(data, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    voters = knn_quality.fit(docs, marks.where(~held_out(F.col("doc_id"))))
    assert len(voters.labels) == sum(not held(i) for i, _ in labels)
    out = {r.doc_id: r.quality.score for r in knn_quality.score(docs, voters, keep=["doc_id"]).collect()}
    assert all((out[i] >= 0.3) == (y == 1) for i, y in labels if held(i))
    # every cosine, sorted, by hand
    counts = knn_quality.terms(pa.array([d[1] for d in data], pa.large_string()), knn_quality.DIMS)
    v = (np.log1p(counts) * voters.idf) @ voters.axes
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for i in (0, 1, 7, 50):
        cosine = voters.vectors @ v[i]
        near = np.argsort(-cosine)[: knn_quality.NEIGHBOURS]
        w = np.maximum(cosine[near], 0) ** knn_quality.POWER
        assert abs(out[i] - (w * voters.labels[near]).sum() / w.sum()) < 0.02
    seen = (counts > 0).sum(0)
    assert np.allclose(voters.idf, np.log((1 + len(data)) / (1 + seen)), atol=1e-5)


def test_sample_bound_and_odd_labels(spark):
    data, labels = labelled(60)
    odd = [*labels, (None, 1), (5, None), (7, 1), (7, 1), (9999, 0)]
    voters = knn_quality.fit(spark.createDataFrame([*data, data[3]], DOCS), spark.createDataFrame(odd, "doc_id long, quality int"), most_labelled=40)
    assert len(voters.labels) == 40


def test_quality_awkward(spark):
    data, labels = labelled(60)
    voters = knn_quality.fit(spark.createDataFrame(data, DOCS), spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = knn_quality.score(awkward(spark), voters).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.quality.score <= 1 for r in rows)
    assert all(abs(r.quality.score - voters.prior) < 1e-6 for r in rows if r.doc_id in (1, 2))
    assert knn_quality.score(empty(spark), voters).count() == 0
    none = knn_quality.fit(empty(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.quality.score for r in knn_quality.score(awkward(spark), none).collect()} == {0.5}


def test_ties_and_too_many_languages(spark):
    """Two languages of equal texts tie: the first by code point is named. More languages than allowed are refused."""
    text = "some words that both languages have alike and again some words"
    docs = spark.createDataFrame([(i, text, lang, "s", 0) for i, lang in enumerate(["zz", "bb", "aa"])], DOCS)
    model = language_mixture.fit(docs)
    assert {r.language.lang for r in language_mixture.detect(docs, model).collect()} == {"aa"}
    with pytest.raises(ValueError, match="more than 2 languages"):
        language_mixture.fit(docs, most_languages=2)
