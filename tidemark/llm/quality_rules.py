"""Quality rules with adaptive thresholds.

Each document's measures (`MEASURES`), and how many words and lines it has, go into quantile sketches for each language
and source. A sketch is a log-linear histogram: a value, in units of 2 ** -16, is counted under its `bits` leading binary digits. So
a quantile is found from below within a relative error of 2 ** (1 - bits), a sketch has at most 64 * 2 ** (bits - 1) counts whatever it has seen,
and sketches merge by adding counts: exactly, in any order, with the same result in every run. Sketches of sources merge
to one for each language and one for all.

A document is judged by the sketch of its language and source if that has seen `least_rows` documents, else by that of its language,
else by that of all. Word length passes from Q1 - `spread` * (Q3 - Q1) to Q3 + `spread` * (Q3 - Q1). A share passes up to

    T + chance / min(own size, median size).

T is the larger of two: Q2 + (2 * `spread` + 1) * (Q2 - Q1), which for even halves is the same fence, at most the larger 0.95 quantile
of the language and of all; and the least 0.8 quantile of the group, its language and all. So junk in less than half of a group does
not widen its fence, nor does more where the wider groups are clean. The second term is a few single things that any text may have (`CHANCE`: two symbols, two repeated lines, the eighteen words of three windows
that stand twice), as a share of the document or of the group's median document, whichever is smaller. So no share is cut at a fixed value: a fence is made of
quantiles, `spread` and these counts.
Documents meet their thresholds in a join.

Only DataFrame functions are used. Measures are written once to the shared folder, narrow, and both the
sketches and the join read them from there; texts are read once and never shuffled.

Defined cases: null, empty and blank texts have 0 words and fail the base rule; very long texts are measured whole; a value on its fence
passes, so documents that tie there are all kept; null language or source is a group of
its own; repeated rows are judged alike, and each counts in the sketches; columns of other names are neither read nor returned; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .native import BLANKS, blank_words, let, total

#: Measure: its numerator and denominator.
MEASURES = {"symbol_share": ("n_symbols", "n_words"), "repeat_share": ("n_repeat_words", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "word_length": ("word_chars", "n_words")}
#: Measures of which only much is bad, with what any text may have of them.
CHANCE = {"symbol_share": 2, "repeat_share": 18, "dup_line_share": 2}
SIZES = ("n_words", "n_lines")
#: Per cent. Shares: tails of the group, its language and all; and the bound of a group by the wider ones.
TAIL, WIDE = 80, 95
QUANTILES = (25, 50, 75, TAIL, WIDE)
LEAST_ROWS, SPREAD, BITS, SCALE = 200, 3.0, 9, 1 << 16
MIN_WORDS, MOST_REPEATED = 50, 50


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that stand twice or more in the text, the first included."""

    def covered(starts: Column) -> Column:
        # starts in order: each adds the words that the one before it has not covered
        return total(F.transform(starts, lambda p, j: F.when(j == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(starts, j - 1))).cast("long")))

    def starts(pairs: Column) -> Column:
        same = lambda j, k: F.get(pairs, j)["h"] == F.get(pairs, k)["h"]
        alike = F.filter(pairs, lambda x, j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
        return F.sort_array(F.transform(alike, lambda x: x["i"]))

    def windows(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(pairs, lambda p: let(starts(p), covered))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(found)

    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(hashed, windows))


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counted = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        let(blank_words(text), of).alias("w"),
        let(lines, counted).alias("l"),
        (F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
    )
    return base.select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def shares(measured: DataFrame) -> DataFrame:
    return measured.withColumns({m: F.col(n) / F.greatest(F.col(d), F.lit(1)) for m, (n, d) in MEASURES.items()})


def sketch_bin(value: Column, bits: int) -> Column:
    """The least whole number with the same `bits` leading binary digits and length."""
    cut = F.greatest(F.length(F.bin(value)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def sketches(measured: DataFrame, *, bits: int = BITS) -> DataFrame:
    """lang, source, measure, bin and n: the counts of every sketch. Counting starts before the shuffle, so a hot source is a few rows of each task."""
    scaled = {m: F.floor(F.col(n) * SCALE / F.greatest(F.col(d), F.lit(1))) for m, (n, d) in MEASURES.items()} | {s: F.col(s) * SCALE for s in SIZES}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), sketch_bin(v.cast("long"), bits).alias("bin")) for m, v in scaled.items())))
    return measured.select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.measure", "x.bin").agg(F.count("*").alias("n"))


def merged(counts: DataFrame, *keys: str) -> DataFrame:
    """Sketches of wider groups."""
    return counts.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def quantiles(counts: DataFrame, *keys: str, rows: str, prefix: str) -> DataFrame:
    """A row for each group with its number of documents and <prefix>_<measure>_<per cent>: the value of that rank, from below."""
    group = Window.partitionBy(*keys, "measure")
    ranked = counts.withColumns({"upto": F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(group)})
    wanted = lambda m: ((50,) if m in SIZES else QUANTILES)
    found = [F.min(F.when((F.col("measure") == m) & (F.col("upto") * 100 >= F.col("all") * p), F.col("bin") / SCALE)).alias(f"{prefix}_{m}_{p}") for m in (*MEASURES, *SIZES) for p in wanted(m)]
    return ranked.groupBy(*keys).agg(F.max("all").alias(rows), *found)


def thresholds(measured: DataFrame, *, least_rows: int = LEAST_ROWS, spread: float = SPREAD, bits: int = BITS) -> DataFrame:
    """For each lang and source of the documents: which level judges it, low and high of each measure (for shares, their T), and the median sizes."""
    counts = stored(sketches(measured, bits=bits), "rules-sketches")
    lang_counts = stored(merged(counts, "lang"), "rules-langs")
    own = quantiles(counts, "lang", "source", rows="n", prefix="s")
    lang = quantiles(lang_counts, "lang", rows="l_n", prefix="l").withColumnRenamed("lang", "l_lang")
    every = quantiles(merged(lang_counts), rows="e_n", prefix="e")
    met = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang"))).join(F.broadcast(every))  # one row
    level = F.when(F.col("n") >= least_rows, "source").when(F.col("l_n") >= least_rows, "lang").otherwise("all")
    out = met.withColumn("level", level)

    def q(m: str, p: int) -> Column:
        return F.when(F.col("level") == "source", F.col(f"s_{m}_{p}")).when(F.col("level") == "lang", F.col(f"l_{m}_{p}")).otherwise(F.col(f"e_{m}_{p}"))

    def fences(m: str) -> list[Column]:
        if m not in CHANCE:
            step = spread * (q(m, 75) - q(m, 25))
            return [(q(m, 25) - step).alias(f"{m}_low"), (q(m, 75) + step).alias(f"{m}_high")]
        wider = lambda p: F.when(F.col("l_n") >= least_rows, F.col(f"l_{m}_{p}")).otherwise(F.col(f"e_{m}_{p}"))
        # the lower half's spread: less than half of junk in a group moves neither
        body = F.least(q(m, 50) + (2 * spread + 1) * (q(m, 50) - q(m, 25)), F.greatest(wider(WIDE), F.col(f"e_{m}_{WIDE}")))
        tail = F.least(q(m, TAIL), wider(TAIL), F.col(f"e_{m}_{TAIL}"))
        return [F.greatest(body, tail).alias(f"{m}_high")]

    return out.select("lang", "source", "level", *(c for m in MEASURES for c in fences(m)), *(q(s, 50).alias(f"{s}_median") for s in SIZES))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_rows: int = LEAST_ROWS, spread: float = SPREAD, bits: int = BITS) -> DataFrame:
    """Measures of each row of docs with base_failed, kept, failed (the measures that broke a fence) and level."""
    measured = stored(measure(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col), "rules-measures")
    fences = thresholds(measured, least_rows=least_rows, spread=spread, bits=bits)
    fences = fences.withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    met = shares(measured).join(fences, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")))

    def high(m: str) -> Column:
        size = MEASURES[m][1]
        return F.col(f"{m}_high") + (CHANCE[m] / F.greatest(F.least(F.col(size), F.col(f"{size}_median")), F.lit(1.0)) if m in CHANCE else 0.0)

    broken = [F.when(F.col(m) > high(m), m) for m in MEASURES] + [F.when(F.col("word_length") < F.col("word_length_low"), "word_length_low")]
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    failed = F.array_compact(F.array(*broken))
    return met.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), failed.alias("failed"), "level")
