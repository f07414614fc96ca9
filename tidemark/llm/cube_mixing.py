"""Mixing sources to target weights by balanced sampling with the cube method.

Sources in order of code points, null last, have the weights 5, 2, 1, repeating. They share all words by
weight; a source's target stops at `most` times its size, and what is over is shared by weight among the
others until none is above. A source whose target is r times its size takes every document floor(r)
times, and once more with probability r - floor(r). Which, the cube method decides: the vector of
probabilities moves through the null-space of the constraints (documents and words of the source), in a
direction and by a step chosen at random but fair, until a coordinate is 0 or 1. Three documents are
moved at a time, so that a step has a closed form.

This flight runs in chunks of about `chunk` documents, whose fractional rests (three at most each) fly again
together, until a source's rests fit one chunk. There, the last few fractions are the landing problem: of all
their roundings, that with the least error in words, then documents, is taken. Chunks and draws
come from hashes of the documents, so reruns agree.

Defined cases: a null or empty text has 0 words; very long texts are counted whole, by chunks; of mixes that tie at the landing the first in order of the
units' hashes is taken; documents of 0 words take 0; sources without words have target 0;
rows with equal id, source and text are one unit and are taken alike; a null source is a source;
an empty table gives an empty result. Sources and their totals are gathered on the driver, as the
weights are given for each: more than `most_sources` are refused.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, edges, stored, text_bytes, with_struct

WEIGHTS, MOST, CHUNK, LANDING, MOST_SOURCES = (5.0, 2.0, 1.0), 3.0, 2048, 12, 100_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
UNIT = ["source", "doc_id", "text_key"]


def word_counts(texts: pa.Array) -> list[pa.Array]:
    """Runs of other bytes than space, tab, line feed, vertical tab, form feed and carriage return."""
    raw, offsets = text_bytes(texts)
    out = np.zeros(len(texts), np.int64)
    within = lambda i: 0 <= i < len(raw) and not _SPACE[raw[i]]
    for a, b in chunks(len(raw)):
        start, _ = edges(~_SPACE[raw[a:b]], within, a, b, offsets)
        out += np.bincount(np.searchsorted(offsets, start, "right") - 1, minlength=len(texts))
    return [pa.array(out, pa.int64())]


def targets(sizes: list[float], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of sum(sizes) by weight, none above most * its size: filled like vessels, the narrowest first."""
    left, weight, out = float(sum(sizes)), float(sum(weights)), [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i]):
        out[i] = min(most * sizes[i], left * weights[i] / weight)
        left, weight = left - out[i], weight - weights[i]
    return out


def flight(share: list[float], rows: list[float], words: list[float], draw: np.random.Generator) -> list[float]:
    """Moves the probabilities of all units until at most three are fractions; sums of rows and words stay."""
    p, active, n = list(share), [], len(share)
    draws = iter(draw.random(2 * n + 8).tolist())
    nxt = 0
    while True:
        while len(active) < 3 and nxt < n:
            active.append(nxt)
            nxt += 1
        if len(active) < 3:
            return p
        i, j, k = active
        u = (rows[j] * words[k] - rows[k] * words[j], rows[k] * words[i] - rows[i] * words[k], rows[i] * words[j] - rows[j] * words[i])
        if not any(u):
            u = (rows[j], -rows[i], 0.0)
        up = min((1 - p[a]) / d if d > 0 else p[a] / -d for a, d in zip(active, u, strict=True) if d)
        down = min(p[a] / d if d > 0 else (1 - p[a]) / -d for a, d in zip(active, u, strict=True) if d)
        by = up if next(draws) * (up + down) < down else -down
        for a, d in zip(active, u, strict=True):
            p[a] += by * d
            if p[a] < 1e-9:
                p[a] = 0.0
            elif p[a] > 1 - 1e-9:
                p[a] = 1.0
        active = [a for a in active if 0 < p[a] < 1]


def heavy_first(p: np.ndarray, rows: np.ndarray, words: np.ndarray, draw: np.random.Generator, over: float = 4.0) -> np.ndarray:
    """Settles units of more than `over` times the mean words, largest first, all others giving way a little.

    The direction is 1 for the unit and a + b * words for each other open one, so that both sums stay.
    A large document left to the end would make the landing problem large.
    """
    p = p.copy()
    for i in np.argsort(-words, kind="stable")[: int((words > over * words.mean()).sum())]:
        while 0 < p[i] < 1:
            open_ = np.flatnonzero((p > 0) & (p < 1))
            open_ = open_[open_ != i]
            if len(open_) < 3:
                break
            r, w = rows[open_], words[open_]
            # others move by (a + b * words / rows): sums of rows and words must be -rows[i] and -words[i]
            grid = np.array([[r.sum(), w.sum()], [w.sum(), (w * w / r).sum()]])
            if abs(np.linalg.det(grid)) < 1e-9 * grid[0, 0] * grid[1, 1]:
                break
            u = np.zeros(len(p))
            u[i] = 1
            coef = np.linalg.solve(grid, [-rows[i], -words[i]])
            u[open_] = coef[0] + coef[1] * w / r
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.nanmin(np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)))
                down = np.nanmin(np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)))
            p = p + (up if draw.random() * (up + down) < down else -down) * u
            p[p < 1e-9], p[p > 1 - 1e-9] = 0.0, 1.0
    return p


def landing(p: list[float], rows: list[float], words: list[float]) -> list[float]:
    """Rounds the fractions so that words, then rows, come nearest to their expectation."""
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    if not open_:
        return p
    bits = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = np.abs((bits - np.array([p[i] for i in open_])) @ np.array([[words[i], rows[i]] for i in open_]))
    best = np.lexsort((off[:, 1], off[:, 0]))[0]
    for i, b in zip(open_, bits[best], strict=True):
        p[i] = float(b)
    return p


def _fly(seed: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("text_key", "ascending"), ("doc_id", "ascending")])
        share, rows, words = (table.column(c).to_numpy().astype(float) for c in ("share", "n", "words"))
        draw = np.random.default_rng([seed, len(words), int(np.bitwise_xor.reduce(table.column("text_key").to_numpy())) & 0x7FFFFFFF])
        fly = np.arange(len(share))
        if last and len(share) > LANDING:
            # the landing keeps documents of usual size, which can make up for what is left open
            usual = np.flatnonzero(words <= 4 * words.mean())[:LANDING]
            fly = np.setdiff1d(fly, usual)
        elif last:
            fly = fly[:0]
        p = share.copy()
        p[fly] = heavy_first(p[fly], rows[fly], words[fly], draw) if len(fly) else p[fly]
        open_ = fly[(p[fly] > 0) & (p[fly] < 1)]
        p[open_] = flight(p[open_].tolist(), rows[open_].tolist(), words[open_].tolist(), draw)
        if last:
            p = np.array(landing(p.tolist(), rows.tolist(), words.tolist()))
        return table.set_column(table.column_names.index("share"), "share", pa.array(p, pa.float64()))

    return run


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, chunk: int = CHUNK, seed: int = 0, most_sources: int = MOST_SOURCES) -> DataFrame:
    """A row for each row of docs: doc_id, source, text_key (xxhash64 of the text), size, source_size, target, copies and taken (copies * size)."""
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    sized = with_struct(named, "text", "s", "size long", word_counts, keep=["doc_id", "source", "text_key"]).select("doc_id", "source", "text_key", "s.size")
    sized = stored(sized, "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(most_sources + 1).collect()
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    totals = sorted(totals, key=lambda r: (r.source is None, r.source or ""))
    goal = targets([r.size for r in totals], [weights[i % len(weights)] for i in range(len(totals))], most)
    plan = spark.createDataFrame([(r.source, r.size, g, g / r.size if r.size else 0.0) for r, g in zip(totals, goal, strict=True)], "plan_source string, source_size long, target double, rate double")
    units = sized.groupBy(*UNIT).agg(F.first("size").alias("size"), F.count("*").alias("n"))
    units = units.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("share", F.col("rate") - F.floor("rate"))
    # a rate that is whole but for rounding needs no draw
    units = units.withColumn("share", F.when(F.col("share") < 1e-9, 0.0).when(F.col("share") > 1 - 1e-9, 1.0).otherwise(F.col("share")))
    fields = "source string, doc_id long, text_key long, n double, words double, share double"
    now = units.where("share > 0 and share < 1 and size > 0").select(*UNIT, F.col("n").cast("double").alias("n"), (F.col("n") * F.col("size")).cast("double").alias("words"), "share")
    decided = None
    level, sure = 0, False
    while True:
        now = stored(now, f"mix-open{level}")
        counts = now.groupBy("source").agg(F.count("*").alias("m"))
        sure = (counts.agg(F.max("m")).first()[0] or 0) <= chunk
        chunks = counts.select(F.col("source").alias("chunk_source"), F.ceil(F.col("m") / chunk).cast("long").alias("chunks"))
        dealt = now.join(chunks, F.col("source").eqNullSafe(F.col("chunk_source"))).withColumn("part", F.pmod(F.xxhash64("doc_id", "text_key", F.lit(level)), "chunks"))
        flown = dealt.groupBy("source", "part").applyInArrow(_narrow(_fly(seed + level, sure)), fields)
        flown = stored(flown, f"mix-flown{level}")
        discard(now)
        part = flown.where("share = 0 or share = 1").select(*UNIT, "share")
        decided = part if decided is None else decided.unionAll(part)
        if sure:
            break
        now, level = flown.where("share > 0 and share < 1"), level + 1
    picked = decided.select(*(F.col(c).alias(f"p_{c}") for c in UNIT), F.col("share").alias("more"))
    units = units.join(picked, F.col("source").eqNullSafe(F.col("p_source")) & F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("text_key") == F.col("p_text_key")), "left")
    copies = (F.floor("rate") + F.coalesce("more", F.when(F.col("share") == 1, 1.0).otherwise(0.0))).cast("long")
    done = units.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long"))).withColumn("row", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
    return done.select("doc_id", "source", "text_key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _narrow(fly):
    names = ["source", "doc_id", "text_key", "n", "words", "share"]
    return lambda table: fly(table.select(names))


def taken(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, with a column copies: how often each stands in the mix. A column of docs with that name is replaced, others stay."""
    chosen = mix(docs, **options).where("copies > 0").select(F.col("source").alias("m_source"), F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"), F.col("copies").alias("m_copies")).distinct()
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    id_col, text_col, source_col = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("source_col", "source")
    # the caller's columns in a struct, so that none clashes with ours
    own = F.struct(*(quoted(c) for c in docs.columns if c.lower() != "copies")).alias("own")
    keyed = docs.select(own, quoted(id_col).cast("long").alias("k_id"), quoted(source_col).cast("string").alias("k_source"), F.xxhash64(quoted(text_col).cast("string")).alias("k_key"))
    met = keyed.join(chosen, F.col("k_id").eqNullSafe(F.col("m_id")) & F.col("k_source").eqNullSafe(F.col("m_source")) & (F.col("k_key") == F.col("m_key")))
    return met.select("own.*", F.col("m_copies").alias("copies"))
