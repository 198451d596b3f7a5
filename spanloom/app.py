"""The whole way as a Spark application: ``spark-submit spanloom/app.py --words ... --rects ... --out ...``.

Reads Parquet tables: the marked copies' words and rects, the originals' words and pages. Writes the
extract, annotations, unmatched, unresolved words, stats, notes and review bundles as folders."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import annotate, marks, outputs
from spanloom.operators.place import repair
from spanloom.sources import dictionaries, highlights


def folder(out: str, name: str) -> str:
    return f"{out.rstrip('/')}/{name}"


def extracted(words: DataFrame, rects: DataFrame, lexicon: DataFrame, custom: dict[str, str]) -> DataFrame:
    """``marks.extract`` with texts and contexts repaired: (..., text, unresolved)."""
    found = marks.extract(words, rects)
    both = found.select("doc_id", "seq", F.explode(F.create_map(*[x for c in ("raw_text", "context_before", "context_after") for x in (F.lit(c), F.col(c))])).alias("part", "t"))
    both = both.withColumn("k", F.concat_ws(":", "doc_id", "seq", "part"))
    fixed = repair(both, lexicon, custom, key="k", text="t").join(both.select("k", "doc_id", "seq", "part"), "k")
    wide = fixed.groupBy("doc_id", "seq").agg(
        *[F.max(F.when(F.col("part") == c, F.col("repaired"))).alias(n) for c, n in (("raw_text", "text"), ("context_before", "before"), ("context_after", "after"))],
        F.array_distinct(F.flatten(F.collect_list("unresolved"))).alias("unresolved"),
    )
    out = found.join(wide, ["doc_id", "seq"]).withColumn("context_before", F.col("before")).withColumn("context_after", F.col("after"))
    return out.drop("before", "after")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name, what in (("words", "words of the marked copies"), ("rects", "coloured rects of the marked copies"), ("original-words", "words of the originals"), ("original-pages", "pages of the originals"), ("lexicon", "known words (word)"), ("out", "folder for the results")):
        parser.add_argument(f"--{name}", required=name == "out", help=what)
    parser.add_argument("--extract-only", action="store_true", help="write the extract and stop, so that it can be reviewed")
    parser.add_argument("--extract-in", help="a reviewed extract to go on from")
    parser.add_argument("--custom-dict", help="the user's own repairs, JSON lines")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    read = spark.read.parquet
    if args.extract_in:
        found = highlights.read(spark, args.extract_in)
    else:
        custom = dictionaries.read(spark, args.custom_dict) if args.custom_dict else {}
        found = extracted(read(args.words), read(args.rects), read(args.lexicon), custom)
        dictionaries.unresolved(found).write.mode("overwrite").json(folder(args.out, "unresolved"))
        found = found.withColumn("bbox", F.array("x0", "y0", "x1", "y1")).drop("unresolved")
    highlights.write(found.select("doc_id", *highlights.COLUMNS), folder(args.out, "extract"))
    if args.extract_only:
        return
    found = highlights.read(spark, folder(args.out, "extract"))
    found = found.select("*", *[F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]).drop("bbox")
    annotate.annotate(found, read(args.original_words), read(args.original_pages)).write.mode("overwrite").parquet(folder(args.out, "annotations"))
    done = read(folder(args.out, "annotations"))
    unmatched = done.filter("entry IS NOT NULL").select("doc_id", "seq", "entry")
    outputs.write_rows(unmatched, folder(args.out, "unmatched"))
    annotate.stats(done).write.mode("overwrite").json(folder(args.out, "stats"))
    outputs.write_rows(outputs.page_notes(found), folder(args.out, "notes"))
    none = spark.createDataFrame([], "doc_id long, word string, context string")
    words = none if args.extract_in else spark.read.schema(none.schema).json(folder(args.out, "unresolved"))
    text = lambda x: F.lit(x).cast("string")
    names = found.select("doc_id").distinct().select(
        "doc_id", text(args.original_words).alias("original"), text(args.words).alias("marked"), text(args.out).alias("output"), text("parquet").alias("output_format"),
        text(folder(args.out, "notes")).alias("notes_out"), text(folder(args.out, "unmatched")).alias("unmatched_out"),
    )
    outputs.write_rows(outputs.review_bundle(names, unmatched, words), folder(args.out, "review"))


if __name__ == "__main__":
    main()
