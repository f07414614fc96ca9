"""A corpus cleaned from end to end: each stage calls one operator and works on all that the stage before it kept.

Each stage's result is written to the shared folder and read again, so a lost executor costs that stage's tasks only; a
stage's table is deleted once the next one is written.

Defined cases, by stage. Null and empty texts, and texts without a letter, go in language_id; a null lang teaches nothing there, a null
doc_id counts as learned from or not by the empty text. near_dedup keeps the row with the least doc_id of a class (nulls last); of repeated rows one stays, of
texts that tie the least hash. decontamination drops every document with a place of any item; an empty or missing text of an item matches nothing, and an empty
benchmark drops nothing. secret_scan keeps all rows; n_chars follows where something was masked and is otherwise left as it was, null too. source_mix returns the rows that are
taken, with copies; a null source is a source. Very long texts are read whole by every stage. An empty table gives an empty result with the same
columns. Other columns of documents, whatever their names, stay as they are, but for one named copies, which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import cube_mixing, language_mixture, order_minhash, qgram_decontamination, secret_forest
from tidemark.llm.common import discard, free_name, held_out, stored

#: A document goes if its languages together have less than this of it.
LEAST_SHARE = 0.5


def _named(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*("`" + c.replace("`", "``") + "`" for c in columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of which the known languages have less than half together, go."""
    model = language_mixture.fit(docs.where(~held_out(F.col("doc_id"))))
    name = free_name(docs, "language")
    found = language_mixture.detect(docs, model, out=name)
    share = F.aggregate(f"{name}.languages", F.lit(0.0), lambda a, x: a + x["share"])
    return _named(found.where((F.col(f"{name}.lang") != "und") & (share >= LEAST_SHARE)), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return order_minhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    name = free_name(docs, "leaks")
    found = qgram_decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=name)
    return _named(found.where(F.size(name) == 0), docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets are masked in the text, and n_chars follows; all documents stay. A source is a name, not a path."""
    name = free_name(docs, "findings")
    found = secret_forest.find(docs, secret_forest.train(spark), path_col=None, out=name)
    clean = found.withColumn("text", secret_forest.redact(F.col("text"), F.col(name)))
    masked = F.exists(name, lambda f: f["secret"])
    return _named(clean.withColumn("n_chars", F.when(masked, F.length("text").cast("long")).otherwise(F.col("n_chars"))), docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with copies: how often each stands in it."""
    return cube_mixing.taken(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]

#: SQL cannot express sketches, alignments, learned models or balanced sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        old, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            discard(old)
    return STAGES[-1][1](spark, docs, sf_dir)
