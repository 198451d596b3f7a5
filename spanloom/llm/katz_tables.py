"""Katz backoff of any order, fitted once into kept tables and applied to any texts.

    P(w | a b) = d(c) c / c(a b)         if a b w was seen in training
               = alpha(a b) P(w | b)     if not; P(w | b) alone where a b was never seen

Discounts, cut and exactly normalised weights are those of ``katz``, with counts of counts for each
order, and at order 2 so are the scores. ``katz`` scores the texts it learns from in a few dense
passes; here a model outlives its run, and words are kept as they are, so nothing goes by a hash.

``fit`` writes under ``path``: grams/n=1.. (ctx, word, p), contexts/n=2.. (ctx, alpha), meta (ord,
tokens, unknown). ctx holds the words before, joined by spaces; every text is led by end tokens.
``score`` evaluates the distinct n-grams of the texts, an order at a time from the highest down, and
joins what was found back to the texts.

Scale: n-grams are summed up in each task before they are shuffled. Where a key of a join has more
than HOT_ROWS rows and more than 1 / HOT_SHARE of all, which fewer than HOT_SHARE keys can, its one
partner is broadcast; all others are shuffled.

Edge cases: a null, empty or blank text is one end token. Repeated rows count and are scored each,
null ids too. An empty training table leaves a model that gives every token probability 1. Without
texts to score the result is empty. Other columns are ignored, whatever their names."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.katz import K, Unigrams, discounts
from spanloom.llm.shared import drop_table, quoted, trimmed, write_table

END = b"\n"
HOT_ROWS, HOT_SHARE = 200_000, 100_000
#: Distinct n-grams that a task sums up before it passes them on.
HELD = 200_000


def grams(df: DataFrame, orders: list[int], by_row: bool) -> DataFrame:
    """df: (uid, text). (uid, n, ctx, word, c): n-grams of each text; of many texts under one uid
    unless ``by_row``. A key may come more than once."""
    most = max(orders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out(uid: int) -> pa.RecordBatch:
            keys = list(held)
            columns = [
                pa.array([uid] * len(keys), pa.int64()), pa.array([len(k) for k in keys], pa.int32()),
                pa.array([b" ".join(k[:-1]) for k in keys], pa.binary()).cast(pa.string()), pa.array([k[-1] for k in keys], pa.binary()).cast(pa.string()),
                pa.array(held.values(), pa.int64()),
            ]
            held.clear()
            return pa.record_batch(columns, names=["uid", "n", "ctx", "word", "c"])

        for b in batches:
            for uid, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = [END] * (most - 1) + (text or b"").lower().split() + [END]
                for lo in range(most - 1, len(words), HELD):
                    hi = min(lo + HELD, len(words))
                    for n in orders:
                        held.update(zip(*(words[lo - n + 1 + j : hi - n + 1 + j] for j in range(n)), strict=True))
                    if len(held) >= HELD:
                        yield out(uid if by_row else 0)
                if by_row and held:
                    yield out(uid)
        if held:
            yield out(0)

    return df.mapInArrow(trimmed(run), "uid long, n int, ctx string, word string, c long")


def shorter(n: int) -> Column:
    """The context of order n - 1: without its first word."""
    return F.lit("") if n == 2 else F.expr("substring(ctx, instr(ctx, ' ') + 1)")


def meet(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Left join of a written table with the one row for each key, whatever the key's share of rows."""
    sizes = left.groupBy(*keys).agg(F.count("*").alias("rows"))
    hot = write_table(sizes.filter(F.col("rows") > max(hot_rows, left.count() // HOT_SHARE)).select(*keys), "katz-hot")
    if hot.isEmpty():
        return left.join(right, keys, "left")
    few = F.broadcast(hot)
    partners = F.broadcast(right.join(few, keys, "left_semi"))
    return left.join(few, keys, "left_semi").join(partners, keys, "left").unionByName(left.join(few, keys, "left_anti").join(right, keys, "left"))


def fit(df: DataFrame, path: str, order: int = 3, text_col: str = "text", hot_rows: int = HOT_ROWS) -> None:
    """Learn from all texts of ``df`` and write the model to ``path``, a folder all executors share."""
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = df.sparkSession
    texts = df.select(F.lit(0).cast("long").alias("uid"), F.col(quoted(text_col)).alias("text"))
    counts = write_table(grams(texts, list(range(1, order + 1)), False).groupBy("n", "ctx", "word").agg(F.sum("c").alias("c")), "katz-counts")
    sums = counts.groupBy("n", F.least("c", F.lit(K + 2)).alias("r")).agg(F.count("*").alias("v"), F.sum("c").alias("c")).collect()  # K + 2 rows an order
    nr = {n: [sum(s.v for s in sums if (s.n, s.r) == (n, r)) for r in range(1, K + 2)] for n in range(1, order + 1)}
    uni = Unigrams([sum(s.c for s in sums if s.n == 1), sum(s.v for s in sums if s.n == 1), *nr[1]])
    for n in range(1, order + 1):
        d = uni.d if n == 1 else discounts(nr[n])
        left = F.col("c") * F.element_at(F.array(*[F.lit(float(x)) for x in d]), (F.least("c", F.lit(K + 1)) + 1).cast("int"))
        g = counts.filter(F.col("n") == n).select("ctx", "word", "c", left.alias("left"))
        if n == 1:
            probs = g.select("ctx", "word", (F.col("left") / max(uni.total, 1)).alias("p"))
        else:
            below = spark.read.parquet(f"{path}/grams/n={n - 1}").withColumnsRenamed({"ctx": "short", "p": "low"})
            seen = write_table(g.withColumn("short", shorter(n)), "katz-seen")
            sums = meet(seen, below, ["short", "word"], hot_rows).groupBy("ctx").agg(F.sum("c").alias("c1"), F.sum("left").alias("used"), F.sum("low").alias("mass"))
            spare = F.col("c1") - F.col("used")
            raised = spare < 1e-9 * F.col("c1")  # nothing left: one more in the total leaves mass
            total = F.col("c1") + raised.cast("int")
            alpha = F.when(raised, 1.0).otherwise(spare) / total / F.greatest(1 - F.col("mass"), F.lit(1e-12))
            contexts = write_table(sums.select("ctx", alpha.alias("alpha"), total.alias("total")), "katz-contexts")
            contexts.select("ctx", "alpha").write.mode("overwrite").parquet(f"{path}/contexts/n={n}")
            probs = meet(seen, contexts, ["ctx"], hot_rows).select("ctx", "word", (F.col("left") / F.col("total")).alias("p"))
        probs.write.mode("overwrite").parquet(f"{path}/grams/n={n}")
        if n > 1:
            drop_table(seen, contexts)
    drop_table(counts)
    spark.createDataFrame([(order, int(uni.n), float(uni.unknown))], "ord int, tokens long, unknown double").write.mode("overwrite").parquet(f"{path}/meta")


def probabilities(asked: DataFrame, path: str, n: int, unknown: float, hot_rows: int) -> DataFrame:
    """(ctx, word, p) of a written table of distinct (ctx, word) of order n."""
    spark = asked.sparkSession
    known = spark.read.parquet(f"{path}/grams/n={n}")
    if n == 1:
        return asked.join(known, ["ctx", "word"], "left").fillna(unknown, ["p"])
    asked = write_table(asked.withColumn("short", shorter(n)), "katz-asked")
    below = write_table(asked.select(F.col("short").alias("ctx"), "word").distinct(), "katz-below")
    below = write_table(probabilities(below, path, n - 1, unknown, hot_rows), "katz-low").withColumnsRenamed({"ctx": "short", "p": "low"})
    found = write_table(meet(asked, below, ["short", "word"], hot_rows).join(known, ["ctx", "word"], "left"), "katz-found")
    weights = spark.read.parquet(f"{path}/contexts/n={n}")
    backed = F.coalesce("alpha", F.lit(1.0)) * F.col("low")
    return meet(found, weights, ["ctx"], hot_rows).select("ctx", "word", F.coalesce("p", backed).alias("p"))


def score(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, n_tokens, score) for each row: its tokens, with the end, and the text's log10 probability
    under the model that ``fit`` left in ``path``."""
    order, _, unknown = df.sparkSession.read.parquet(f"{path}/meta").first()
    docs = write_table(df.select(F.monotonically_increasing_id().alias("uid"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")), "katz-docs")
    each = write_table(grams(docs.select("uid", "text"), [order], True).drop("n"), "katz-each")
    asked = write_table(each.select("ctx", "word").distinct(), "katz-distinct")
    probs = write_table(probabilities(asked, path, order, unknown, hot_rows), "katz-probs")
    sums = meet(each, probs, ["ctx", "word"], hot_rows).groupBy("uid").agg(F.sum("c").alias("n_tokens"), F.sum(F.col("c") * F.log10("p")).alias("score"))
    return docs.select("uid", F.col("id").alias(id_col)).join(sums, "uid").drop("uid")
