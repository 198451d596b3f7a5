"""Reviewed extracts: highlights as JSON lines, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, seq long, color string, text string, raw_text string, is_image boolean, page_no int, bbox array<double>, context_before string, context_after string"
COLUMNS = ("seq", "color", "text", "raw_text", "is_image", "page_no", "bbox", "context_before", "context_after")
REQUIRED = ("color", "page_no", "bbox")


def encode(highlights: DataFrame) -> DataFrame:
    return highlights.select(F.to_json(F.struct(*[c for c in highlights.columns])).alias("value"))


def decode(lines: DataFrame) -> DataFrame:
    """Missing texts are empty and flags false; a missing required field is an error."""
    h = lines.select(F.from_json("value", SCHEMA).alias("h")).select("h.*")
    for c in REQUIRED:
        h = h.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"highlight without {c}")).cast(h.schema[c].dataType)))
    texts = {c: F.coalesce(c, F.lit("")) for c in ("text", "raw_text", "context_before", "context_after")}
    return h.withColumns(texts | {"is_image": F.coalesce("is_image", F.lit(False))})


def write(highlights: DataFrame, path: str) -> None:
    encode(highlights).write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.text(path))
