"""The user's own repairs (word, replacement), kept as JSON lines, and what is left to be reviewed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "word string, replacement string"
#: Entries of a user's dictionary; it is written by hand.
MAX_WORDS = 200_000


def read(spark: SparkSession, path: str) -> dict[str, str]:
    """Lines that are no entries are passed over. A larger dictionary than ``MAX_WORDS`` is an error."""
    rows = spark.read.schema(SCHEMA).json(path).dropna().limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} entries in {path}")
    return {r.word: r.replacement for r in rows}


def write(spark: SparkSession, words: dict[str, str], path: str) -> None:
    """Made whole beside the old one's readers: read it fully before, as this replaces it."""
    spark.createDataFrame(sorted(words.items()), SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def review(spark: SparkSession, path: str, decided: DataFrame) -> dict[str, str]:
    """decided: (word, replacement) as somebody reviewed them; a null or empty replacement passes a
    word over. The dictionary with them, written back."""
    fresh = decided.filter(F.coalesce("replacement", F.lit("")) != "").limit(MAX_WORDS).collect()
    try:
        words = read(spark, path)
    except Exception as e:  # no dictionary yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        words = {}
    words |= {r.word: r.replacement for r in fresh}
    write(spark, words, path)
    return words


def unresolved(repaired: DataFrame) -> DataFrame:
    """repaired: (doc_id, seq, text, unresolved array<string>). (doc_id, word, context): each word of a
    document once, with the beginning of the first text that has it."""
    each = repaired.select("doc_id", "seq", F.substring("text", 1, 80).alias("context"), F.explode("unresolved").alias("word"))
    return each.groupBy("doc_id", "word").agg(F.min_by("context", "seq").alias("context"))
