"""Quality scores by votes of the nearest labelled documents.

Terms of a text are its byte trigrams, hashed to `dims` bins, and a few layout terms: how much of it
repeats words, how long it is, and its shares of capitals and of symbols, each in steps. A term's weight is
ln(1 + count) * ln((1 + documents) / (1 + documents with it)), counted over all documents. A singular value
decomposition of at most `most_labelled` labelled documents (those with the least hash of their id; the sample
is the only one here) gives `rank` latent directions; every document is projected on them and scaled to
length 1. For each block of documents the cosines with all labelled vectors are computed exactly, and the
`neighbours` nearest vote with their label, weighted by cosine ** `power`.

Defined cases: a very long text is read whole, by chunks; a text without terms (null, empty) and one without a neighbour of positive cosine get the share
of label 1 in the sample; without any labelled document that share is 0.5; null labels and labelled ids
without a document teach nothing; repeated rows are scored alike (repeated labels of an id count once,
the largest); of neighbours that tie for the last places any may vote, the same ones in each run; a column with
the result's name is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, chunks, slices, text_bytes, tidy, with_struct, word_hashes

DIMS, RANK, MOST_LABELLED, NEIGHBOURS, POWER, ROWS = 2048, 48, 3000, 25, 4.0, 128
STEPS, LAYOUTS, LAYOUT_COUNT = 8, 4, 400
_SYMBOL = np.ones(256, bool)
_SYMBOL[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 32, *range(9, 14), *b".,;:!?'\"()-"]] = False


def terms(texts: pa.Array, dims: int) -> np.ndarray:
    """Counts of the terms of each text: len(texts) x (dims + layout terms)."""
    n, width = len(texts), dims + LAYOUTS * STEPS
    raw, offsets = text_bytes(texts)
    out = np.zeros((n, width), np.float32)
    size = np.diff(offsets)
    capitals, symbols = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a, b in chunks(len(raw)):
        # with the two bytes before, whose trigrams end here
        part = raw[max(a - 2, 0) : b]
        at = np.arange(len(part)) + max(a - 2, 0)
        doc = np.searchsorted(offsets, at, "right") - 1
        wide = part.astype(np.uint32)
        code = (wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]) * np.uint32(2654435761)
        inside = doc[:-2] == doc[2:]
        cell = doc[:-2][inside] * dims + (code[inside] >> np.uint32(32 - int(dims).bit_length() + 1)).astype(np.int64)
        out[:, :dims] += np.bincount(cell, minlength=n * dims).reshape(n, dims)
        own = slice(len(part) - (b - a), None)
        capitals += np.bincount(doc[own][(part[own] >= 65) & (part[own] <= 90)], minlength=n)
        symbols += np.bincount(doc[own][_SYMBOL[part[own]]], minlength=n)
    words, first = word_hashes(texts)
    many = np.diff(first)
    fresh = np.array([len(np.unique(words[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)])
    shares = (
        1 - fresh / np.maximum(many, 1),
        np.log2(1 + many) / 16,
        capitals / np.maximum(size, 1) * 2,
        symbols / np.maximum(size, 1) * 2,
    )
    rows = np.flatnonzero(size > 0)
    for i, share in enumerate(shares):
        step = np.clip((share * STEPS).astype(int), 0, STEPS - 1)
        out[rows, dims + i * STEPS + step[rows]] = LAYOUT_COUNT
    return out


@dataclass
class Voters:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def latent(counts: np.ndarray, idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    v = (np.log1p(counts) * idf) @ axes
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", dims: int = DIMS, rank: int = RANK, most_labelled: int = MOST_LABELLED) -> Voters:
    """Term statistics from all of docs; labels only from the rows of `labels` that the caller passes."""
    width = dims + LAYOUTS * STEPS

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(width, np.int64), 0
        for batch in batches:
            whole = as_text(batch.column(0))
            for start, stop in slices(whole, rows=ROWS):
                found += (terms(whole.slice(start, stop - start), dims) > 0).sum(0)
                rows += stop - start
        yield pa.record_batch([pa.array(range(-1, width), pa.int32()), pa.array([rows, *found], pa.int64())], names=["term", "n"])

    seen = np.zeros(width + 1)
    for row in docs.select(F.col(text_col).cast("string")).mapInArrow(tidy(frequency), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        seen[row.term + 1] = row.n
    idf = np.log((1 + seen[0]) / (1 + seen[1:])).astype(np.float32)

    picked = labels.select(F.col(label_id).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label")).where("label_id is not null and label is not null")
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # an id without a document must not take a place of the sample
    picked = picked.groupBy("label_id").agg(F.max("label").alias("label")).join(named.select("id").distinct(), F.col("id") == F.col("label_id"), "left_semi").orderBy(F.xxhash64("label_id"), "label_id").limit(most_labelled)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = as_text(batch.column(2))
            for start, stop in slices(whole, rows=ROWS):
                packed = [r.astype(np.float16).tobytes() for r in np.log1p(terms(whole.slice(start, stop - start), dims))]
                yield pa.record_batch([batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start), pa.array(packed, pa.binary())], names=["id", "label", "terms"])

    # at most `most_labelled` rows of two numbers are broadcast
    sample = named.join(F.broadcast(picked), F.col("id") == F.col("label_id")).select("id", "label", "text").mapInArrow(tidy(vectors), "id long, label int, terms binary").toArrow().sort_by("id")
    ids = sample.column("id").to_numpy()
    once = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, int)
    y = sample.column("label").to_numpy()[once].astype(np.float32)
    if not len(once):
        return Voters(idf, np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    packed = sample.column("terms").to_pylist()
    x = np.stack([np.frombuffer(packed[i], np.float16) for i in once]).astype(np.float32) * idf
    _, basis = np.linalg.eigh(x.T @ x if len(x) >= width else x @ x.T)
    top = basis[:, ::-1][:, :rank]
    axes = top if len(x) >= width else x.T @ top
    axes = (axes / np.maximum(np.linalg.norm(axes, axis=0), 1e-12)).astype(np.float32)
    v = x @ axes
    return Voters(idf, axes, (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32), y, float(y.mean()))


def votes(vectors: np.ndarray, voters: Voters, neighbours: int, power: float) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, weighted by cosine, for a block of documents."""
    if not len(voters.labels):
        return np.full(len(vectors), voters.prior)
    cosine = vectors @ voters.vectors.T
    k = min(neighbours, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** power
    total = weight.sum(1)
    return np.where(total > 1e-12, (weight * voters.labels[near]).sum(1) / np.maximum(total, 1e-12), voters.prior)


def score(docs: DataFrame, voters: Voters, *, text_col: str = "text", out: str = "quality", keep: list[str] | None = None, neighbours: int = NEIGHBOURS, power: float = POWER, dims: int = DIMS) -> DataFrame:
    """docs (or its columns `keep`) with a struct: score, from 0 to 1."""
    # most_labelled x rank numbers and dims x rank numbers, whatever the input
    sent = docs.sparkSession.sparkContext.broadcast((voters.idf, voters.axes, voters.vectors, voters.labels, voters.prior))

    def kernel(texts: pa.Array) -> list[pa.Array]:
        own = Voters(*sent.value)
        return [pa.array(np.clip(votes(latent(terms(texts, dims), own.idf, own.axes), own, neighbours, power), 0, 1), pa.float64())]

    return with_struct(docs, text_col, out, "score double", kernel, keep=keep, rows=ROWS)
