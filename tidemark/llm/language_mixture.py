"""Language identification by mixtures.

A document's letters (lower-cased; everything else is a space, runs of spaces are one) give byte trigrams,
hashed to `bins` bins. Each language has a distribution over the bins, learned from all labelled texts.
A document is a mixture: expectation-maximisation estimates the proportion of each language from the
trigrams' likelihoods. The set of languages is chosen by penalised likelihood: starting from all, the
language with the least proportion is dropped and the rest fitted again; that set wins whose
log-likelihood minus `penalty` * size * ln(1 + trigrams) is largest.

Defined cases: null texts and texts without a letter are `und` with score 0 and no languages; a model
learned from no labelled text gives `und` everywhere; rows with a null label teach nothing; ties go to
the language that comes first by code point; very long texts are read whole, by chunks; more labels than `most_languages` are refused, none is dropped; repeated rows are judged alike; a column with the name of
the result is replaced, other columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, chunks, slices, text_bytes, tidy, with_struct

BINS, PENALTY, STEPS, SMOOTHING, ROWS = 1 << 15, 4.0, 8, 0.5, 128
#: Languages that a model may have by default; more are refused, since the table has 4 * BINS bytes for each.
MOST_LANGUAGES = 512
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


@dataclass
class LanguageModel:
    languages: list[str]
    #: log-probability of each bin in each language: bins x languages
    table: np.ndarray


def trigrams(texts: pa.Array, bins: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of texts and bins of all trigrams, by chunks. Each text stands between two spaces."""
    padded = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.utf8_lower(texts), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    raw, offsets = text_bytes(padded)
    last, owner = np.zeros(0, np.uint8), np.zeros(0, np.int64)
    for a, b in chunks(len(raw)):
        letter = _LETTER[raw[a:b]]
        keep = letter.copy()
        # a space stays after a letter and where a text begins
        keep[1:] |= letter[:-1]
        keep[0] |= a > 0 and _LETTER[raw[a - 1]]
        begins = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)]
        keep[begins[begins < len(raw)] - a] = True
        at = np.flatnonzero(keep)
        kept = np.concatenate((last, np.where(letter, raw[a:b], np.uint8(32))[at]))
        doc = np.concatenate((owner, np.searchsorted(offsets, at + a, "right") - 1))
        wide = kept.astype(np.uint32)
        code = (wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]) * np.uint32(2654435761)
        inside = doc[:-2] == doc[2:]
        yield doc[:-2][inside], (code[inside] >> np.uint32(32 - int(bins).bit_length() + 1)).astype(np.int64)
        last, owner = kept[-2:], doc[-2:]


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", bins: int = BINS, most_languages: int = MOST_LANGUAGES) -> LanguageModel:
    """Counts over every row of docs that has a label; what reaches the driver is a count per language and bin."""
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, whole = np.asarray(batch.column(0).to_pylist(), object), as_text(batch.column(1))
            for start, stop in slices(whole):
                own = langs[start:stop]
                for doc, code in trigrams(whole.slice(start, stop - start), bins):
                    for lang in set(own):
                        total[lang] = total.get(lang, 0) + np.bincount(code[(own == lang)[doc]], minlength=bins)
        for lang, counts in total.items():
            full = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([lang] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(counts[full], pa.int64())], names=["lang", "bin", "n"])

    counted = labelled.mapInArrow(tidy(count), "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("counts"))
    rows = sorted(counted.limit(most_languages + 1).collect(), key=lambda r: r.lang.encode())
    if len(rows) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    table = np.full((bins, len(rows)), SMOOTHING)
    for j, row in enumerate(rows):
        table[[c.bin for c in row.counts], j] += [c.n for c in row.counts]
    return LanguageModel([r.lang for r in rows], np.log(table / table.sum(0)).astype(np.float32))


def mixtures(docs: np.ndarray, bins: np.ndarray, counts: np.ndarray, size: int, table: np.ndarray, penalty: float, steps: int) -> np.ndarray:
    """Proportions of each language in each of `size` documents, from their (document, bin, count) entries in order of documents."""
    n_lang = table.shape[1]
    logs = table[bins]
    top = logs.max(1)
    like = np.exp(logs - top[:, None])
    starts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    present = docs[starts]
    total = np.add.reduceat(counts, starts)
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(docs))))
    cost = penalty * np.log1p(total)

    def climb(rows: np.ndarray, at: np.ndarray, begin: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, c, n = like[rows], counts[rows], total[np.unique(row[rows])] if len(rows) < len(row) else total
        for _ in range(steps):
            joint = p * share[at]
            share = np.add.reduceat(joint * (c / np.maximum(joint.sum(1), 1e-30))[:, None], begin, axis=0) / n[:, None]
        value = np.add.reduceat(c * (np.log(np.maximum((p * share[at]).sum(1), 1e-30)) + top[rows]), begin)
        return share, value

    alone = np.add.reduceat(logs * counts[:, None], starts, axis=0)
    best = np.zeros((len(starts), n_lang), np.float32)
    first = alone.argmax(1)
    best[np.arange(len(starts)), first] = 1
    value = alone[np.arange(len(starts)), first] - cost
    active = np.arange(len(starts))
    share = np.full((len(starts), n_lang), 1 / n_lang, np.float32)
    for left in range(n_lang, 1, -1):
        rows = np.flatnonzero(np.isin(row, active)) if len(active) < len(starts) else np.arange(len(row))
        at = np.searchsorted(active, row[rows])
        begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        share, fitted = climb(rows, at, begin, share)
        # no smaller set is likelier than this one: done where even at the cost of two languages it loses to one
        won = fitted - left * cost[active] > value[active]
        best[active[won]] = share[won]
        value[active[won]] = (fitted - left * cost[active])[won]
        go = fitted - 2 * cost[active] > alone[active, first[active]] - cost[active]
        active, share = active[go], share[go]
        if not len(active):
            break
        weak = np.where(share > 0, share, np.inf).argmin(1)
        share[np.arange(len(active)), weak] = 0
        share = np.maximum(share / np.maximum(share.sum(1), 1e-30)[:, None], 0)
    out = np.zeros((size, n_lang), np.float32)
    out[present] = best
    return out


def _kernel(model: LanguageModel, penalty: float, steps: int):
    languages, table, width = model.languages, model.table, len(model.table)

    def run(texts: pa.Array) -> list[pa.Array]:
        n = len(texts)
        lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        share = np.zeros((n, len(languages)), np.float32)
        dense = np.zeros(n * width, np.int64)
        for doc, code in trigrams(texts, width) if languages else ():
            dense += np.bincount(doc * width + code, minlength=n * width)
        full = np.flatnonzero(dense)
        if len(full):
            share = mixtures(full // width, full % width, dense[full].astype(np.float32), n, table, penalty, steps)
        share[~lettered] = 0
        top = share.argmax(1) if languages else np.zeros(n, int)
        score = share.max(1) if languages else np.zeros(n)
        sets = [[(languages[j], float(row[j])) for j in np.argsort(-row, kind="stable") if row[j] > 0] for row in share]
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        return [pa.array([languages[j] if s > 0 else "und" for j, s in zip(top, score, strict=True)], pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array([[{"lang": a, "share": b} for a, b in s] for s in sets], kind)]

    return run


def detect(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", out: str = "language", keep: list[str] | None = None, penalty: float = PENALTY, steps: int = STEPS) -> DataFrame:
    """docs (or its columns `keep`) with a struct: lang, score (its proportion) and languages (all that were selected, with proportions)."""
    return with_struct(docs, text_col, out, "lang string, score double, languages array<struct<lang:string,share:double>>", _kernel(model, penalty, steps), keep=keep, rows=ROWS)
