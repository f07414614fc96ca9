"""The queries opN_<name> of this subpackage over the tables of a folder, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cube_mixing, knn_quality, language_mixture, license_index, qgram_decontamination, quality_rules, secret_forest, url_sweep, warc
from .common import held_out
from .license_sql import license_sql
from .order_minhash import near_duplicates
from .quality_sql import quality_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"), "level")


def op2_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.summary(license_index.scan(_table(spark, sf_dir, "documents")))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    voters = knn_quality.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    found = knn_quality.score(docs, voters, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "quality.score", (F.col("quality.score") >= 0.3).cast("int").alias("predicted"))


#: host, path, verdict
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op6_url_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_sweep.judge(_table(spark, sf_dir, "pages"), rules, keep=["page_id"])
    return judged.select("page_id", "rule_match.*")


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_mixture.fit(docs.where(~held_out(F.col("doc_id"))))
    found = language_mixture.detect(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.languages")


def op8_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = cube_mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each place of a benchmark item in a document."""
    found = qgram_decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each candidate, with the forest's verdict."""
    found = secret_forest.find(_table(spark, sf_dir, "documents"), secret_forest.train(spark), path_col=None, keep=["doc_id"])
    return found.select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.start", "f.value", "f.probability", "f.secret")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_index": op2_license_index,
    "op3_order_minhash": op3_order_minhash,
    "op4_warc": op4_warc,
    "op5_knn_quality": op5_knn_quality,
    "op6_url_sweep": op6_url_sweep,
    "op7_language_mixture": op7_language_mixture,
    "op8_cube_mixing": op8_cube_mixing,
    "op9_qgram_decontamination": op9_qgram_decontamination,
    "op10_secret_forest": op10_secret_forest,
}

SQL: dict[str, str] = {
    "op1_quality_rules": quality_sql(),
    "op2_license_index": license_sql(),
    "op4_warc": """
        WITH p AS (
          SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
        ), q AS (
          SELECT *, n >= 100 AND row_number() OVER (PARTITION BY d, n ORDER BY page_id NULLS LAST) > 1 AS again, min(page_id) OVER (PARTITION BY d, n) AS first_id FROM p
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN first_id END AS refers_to FROM q
    """,
    "op6_url_sweep": """
        WITH r(h, t, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
          ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        a AS (
          SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
          FROM pages
        ), b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
        c AS (
          SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
          FROM b
        ), m AS (
          SELECT c.page_id, c.host, c.path, r.h || r.t AS rule, r.v,
                 row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.h || r.t) DESC NULLS LAST, length(r.h) DESC) AS k
          FROM c LEFT JOIN r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.t)
        )
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
    """,
}
