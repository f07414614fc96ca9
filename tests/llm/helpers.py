"""Small inputs with every awkward case."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (None, "one two three four five six seven", "en", "a", 33),
    (3, " \t\n ", "en", None, 4),
    (4, "!!! ???", None, "b", 7),
    (5, "same text here for all to see and read again", "en", "b", 44),
    (5, "same text here for all to see and read again", "en", "b", 44),
    (6, "same text here for all to see and read again", "de", "a", 44),
    (7, "é" * 50 + " \U0001f600 ünïcode", "fr", "a", 60),
    (8, "word " * 30_000, "en", "a", 150_000),
]


def awkward(spark):
    """With extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, DOCS)
    extra = ["score", "class_id", "language", "quality", "leaks", "findings", "copies", "size", "target", "hits", "words", "node", "root", "__text", "kept", "n_words", "share", "level"]
    return df.withColumns({c: F.lit(f"own {c}") for c in extra})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def held(doc_id):
    import zlib

    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0
