"""Exact deduplication by progressive refinement.

Texts are equal when identical after all white space of U+0020, U+0009..U+000D is deleted. Rows
are grouped by the length of that normal form; where a length comes twice, by the hash of a
prefix too; where both come twice, by the SHA-256 of the whole normal form. Only rows that are
left in the last step have their content hashed.

The lengths and prefixes that come twice are sent to the rows while they are few (``MAX_BROADCAST``,
counted first); beyond that, narrow rows are joined with them. Groups' sizes and winners are
aggregates with partial results; no group is ever gathered in one task. Texts are not shuffled
unless more rows are dropped than may be named to every worker; then once.

Edge cases: a null text counts as empty, so all null, empty and blank texts are one group. Of a
group, the row with the most code points in its original text stays, then the smallest id; of
rows that repeat the same id as well, exactly one. Ids are of any type that has an order; null ids
come last, and a group whose winner has a null id has a null keep_id. Repeated ids with other texts
are rows of their own. An empty table gives an empty result. Columns other than id and text are
ignored, or kept by ``drop_exact_duplicates``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.shared import WS, drop_table, quoted, read, sent, tune, with_uid, without, write_table

PREFIX_CHARS = 64


def normal(col):
    return F.translate(F.coalesce(col, F.lit("")), WS, "")


def _marks(text_col: str) -> list:
    """Code points of the text and of its normal form, and a hash of the normal form's beginning."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    norm = normal(text)
    return [F.length(text).cast("long").alias("n_raw"), F.length(norm).alias("n_norm"), F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("prefix_hash")]


def _survivors(seen: DataFrame, table: str) -> DataFrame:
    """(n_norm, prefix_hash) that several rows of ``seen`` share, among lengths that several share."""
    lengths = write_table(seen.groupBy("n_norm").count().filter("count > 1").select("n_norm"), "exact-lengths")
    rows = seen.select("n_norm", "prefix_hash").join(sent(lengths), "n_norm", "left_semi")
    pairs = write_table(rows.groupBy("n_norm", "prefix_hash").count().filter("count > 1").drop("count"), table)
    drop_table(lengths)
    return pairs


def _groups(rows: DataFrame) -> DataFrame:
    """rows: (uid, id, n_raw, sha). (sha, group_size, keep_id, keep_uid) of texts that come twice."""
    best = F.min(F.struct((-F.col("n_raw")).alias("n"), F.col("id").isNull().alias("none"), "id", "uid"))
    groups = rows.groupBy("sha").agg(F.count("*").alias("group_size"), best.alias("best")).filter("group_size > 1")
    return groups.select("sha", "group_size", F.col("best.id").alias("keep_id"), F.col("best.uid").alias("keep_uid"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: (id, keep_id, group_size, kept, text_sha256). As the digest is
    wanted of every row, it is worked out in the first scan."""
    sha = F.sha2(normal(F.col(quoted(text_col))), 256).alias("sha")
    seen = write_table(df.select(F.monotonically_increasing_id().alias("uid"), F.col(quoted(id_col)).alias("id"), *_marks(text_col), sha), "exact-marks")
    pairs = _survivors(seen, "exact-pairs")
    groups = _groups(seen.join(sent(pairs), ["n_norm", "prefix_hash"], "left_semi").select("uid", "id", "n_raw", "sha"))
    out = seen.select("uid", "id", "sha").join(groups, "sha", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_uid") == F.col("uid"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows that ``exact_duplicates`` drops; same columns. Content is hashed only
    where length and prefix come twice."""
    docs, uid = with_uid(df, "exact-docs")
    rows = docs.select(F.col(uid).alias("uid"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    seen = write_table(rows.select("uid", *_marks("text")), "exact-marks")
    pairs = _survivors(seen, "exact-pairs")
    few = sent(pairs)
    sha = F.sha2(normal(F.col("text")), 256).alias("sha")
    if few is not pairs:  # the keys go to the rows, before any content is hashed
        left = rows.select("uid", "id", "text", *_marks("text")).join(few, ["n_norm", "prefix_hash"], "left_semi").select("uid", "id", "n_raw", sha)
    else:  # an inner join: a semi-join would be pushed below the digest and move the texts
        left = rows.select("uid", "id", *_marks("text"), sha).join(pairs, ["n_norm", "prefix_hash"]).select("uid", "id", "n_raw", "sha")
    left = write_table(left, "exact-digests")
    gone = write_table(left.join(_groups(left), "sha").filter("uid <> keep_uid").select("uid"), "exact-gone")
    drop_table(seen, pairs, left)
    return without(docs, uid, gone)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return exact_duplicates(read(spark, sf_dir, "documents"))


SQL = {
    "op4_exact_dedup": """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_raw,
         sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_raw DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
}
