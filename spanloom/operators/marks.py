"""From words and coloured rects to passages and highlights.

words: (doc_id, page_no, word_idx, text, x0, y0, x1, y1); rects: (doc_id, page_no, rect_id, color,
x0, y0, x1, y1). All joins are on (doc_id, page_no), so a page's words and rects meet in one
partition and no page ever meets another."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.config import DEFAULT, SUBSTITUTIONS, Config
from spanloom.functions.geometry import area, overlap_ratio
from spanloom.functions.text import clean_display, control_characters, is_line_break, merges_hyphen, normalize_text

PAGE = ["doc_id", "page_no"]


def word_rect_hits(words: DataFrame, rects: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """(doc_id, page_no, rect_id, word_idx, overlap) where the rect covers enough of the word."""
    r = rects.select(*PAGE, "rect_id", *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    share = overlap_ratio(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), tuple(F.col(f"r{c}") for c in ("x0", "y0", "x1", "y1")))
    near = (F.col("x0") < F.col("rx1")) & (F.col("x1") > F.col("rx0")) & (F.col("y0") < F.col("ry1")) & (F.col("y1") > F.col("ry0"))
    hits = words.select(*PAGE, "word_idx", "x0", "y0", "x1", "y1").join(r, PAGE).filter(near).withColumn("overlap", share)
    return hits.filter(F.col("overlap") >= conf.hit_overlap).select(*PAGE, "rect_id", "word_idx", "overlap")


def image_rects(rects: DataFrame, hits: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """Rects that mark no word and are large enough to be a picture."""
    return rects.join(hits.select(*PAGE, "rect_id").distinct(), [*PAGE, "rect_id"], "left_anti").filter(area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) >= conf.min_image_area)


def vertical_islands(rects: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """``rects`` with ``island``: a gap of line_gap below everything so far starts a new one."""
    w = Window.partitionBy(*PAGE, "color").orderBy("y0", "x0", "rect_id")
    top = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rects.withColumn("starts", F.when(top.isNull() | (F.col("y0") - top >= conf.line_gap), 1).otherwise(0))
    return flagged.withColumn("island", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def passages(words: DataFrame, rects: DataFrame, hits: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """(doc_id, page_no, color, passage, rect_ids, word_idx): rects of one colour joined while the
    words they mark go on. The state is reset at each break, so it is a fold over the sorted rects
    of a page and colour; such a group is bounded by what fits on a page."""
    per = hits.groupBy(*PAGE, "rect_id").agg(F.array_sort(F.collect_set("word_idx")).alias("hit"))
    marked = rects.join(per, [*PAGE, "rect_id"])
    page_words = words.groupBy(*PAGE).agg(F.collect_list(F.struct("word_idx", "x1", "y0")).alias("ws"))
    r = F.struct("y0", "x0", "rect_id", "x1", "y1", "hit")
    groups = marked.groupBy(*PAGE, "color").agg(F.array_sort(F.collect_list(r)).alias("rs")).join(page_words, PAGE)
    kind = "struct<groups:array<struct<rect_ids:array<bigint>,word_idx:array<bigint>>>,ids:array<bigint>,idx:array<bigint>,max_idx:bigint,max_y:double,last:struct<x0:double,y0:double,x1:double,y1:double>>"
    start = F.from_json(F.lit('{"groups":[],"ids":[],"idx":[]}'), kind)

    def step(acc, x):
        height = F.greatest(acc["last"]["y1"] - acc["last"]["y0"], x["y1"] - x["y0"])
        same_line = F.abs(x["y0"] - acc["last"]["y0"]) <= height * 0.5
        vgap, hgap = x["y0"] - acc["max_y"], x["x0"] - acc["last"]["x1"]
        first = F.array_min(x["hit"])
        prefix = F.exists("ws", lambda v: (v["word_idx"] > acc["max_idx"]) & (v["word_idx"] < first) & (F.abs(v["y0"] - x["y0"]) <= F.greatest(F.lit(4.0), height * 0.75)) & (v["x1"] <= x["x0"]))
        cut = (first - acc["max_idx"] > conf.word_gap) | (vgap >= conf.line_gap) | (~same_line & (vgap < conf.line_gap) & prefix) | (same_line & (hgap > F.greatest(F.lit(8.0), height * 1.2)))
        cut = F.coalesce((F.size(acc["ids"]) > 0) & cut, F.lit(False))
        done = F.concat(acc["groups"], F.array(F.struct(acc["ids"].alias("rect_ids"), acc["idx"].alias("word_idx"))))
        none = F.array().cast("array<bigint>")
        return F.struct(
            F.when(cut, done).otherwise(acc["groups"]).alias("groups"),
            F.concat(F.when(cut, none).otherwise(acc["ids"]), F.array(x["rect_id"].cast("bigint"))).alias("ids"),
            F.array_union(F.when(cut, none).otherwise(acc["idx"]), F.transform(x["hit"], lambda h: h.cast("bigint"))).alias("idx"),
            F.when(cut, F.array_max(x["hit"]).cast("bigint")).otherwise(F.greatest(acc["max_idx"], F.array_max(x["hit"]).cast("bigint"))).alias("max_idx"),
            F.when(cut, x["y1"]).otherwise(F.greatest(acc["max_y"], x["y1"])).alias("max_y"),
            F.struct(x["x0"].alias("x0"), x["y0"].alias("y0"), x["x1"].alias("x1"), x["y1"].alias("y1")).alias("last"),
        ).cast(kind)

    def finish(acc):
        return F.concat(acc["groups"], F.array(F.struct(acc["ids"].alias("rect_ids"), acc["idx"].alias("word_idx"))))

    folded = groups.select(*PAGE, "color", F.posexplode(F.aggregate("rs", start.cast(kind), step, finish)).alias("passage", "p"))
    return folded.select(*PAGE, "color", "passage", "p.rect_ids", F.array_sort("p.word_idx").alias("word_idx"))


def joined_text(ws):
    """One string of sorted word structs (word_idx, text, x0, y0): cleaned, hyphenated halves merged.
    Words that are empty once cleaned count as not there."""
    kind = "struct<head:string,last:string,x0:double,y0:double>"

    def step(acc, w):
        text = clean_display(w["text"])
        merge = is_line_break(acc["x0"], acc["y0"], w["x0"], w["y0"]) & merges_hyphen(acc["last"], text)
        head = F.when(merge | (acc["last"] == ""), acc["head"]).otherwise(F.concat(acc["head"], acc["last"], F.lit(" ")))
        last = F.when(merge, F.concat(F.substring(acc["last"], F.lit(1), F.length(acc["last"]) - 1), text)).otherwise(text)
        return F.when(text == "", acc).otherwise(F.struct(head.alias("head"), last.alias("last"), w["x0"].alias("x0"), w["y0"].alias("y0")).cast(kind))

    return F.aggregate(ws, F.from_json(F.lit('{"head":"","last":""}'), kind), step, lambda a: F.concat(a["head"], a["last"]))


WORD, RECT = ["page_no", "word_idx", "text", "x0", "y0", "x1", "y1"], ["page_no", "rect_id", "color", "x0", "y0", "x1", "y1"]


def units(words: DataFrame, rects: DataFrame, *keys: str) -> DataFrame:
    """One row per page or document that has rects: the keys, and words and rects as parallel lists
    (w_page_no, w_word_idx, ..., r_y1), words in order. Words and rects are dealt out once."""
    ws = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*WORD))).alias("ws"))
    rs = rects.groupBy(*keys).agg(F.collect_list(F.struct(*RECT)).alias("rs"))
    return rs.join(ws, [*keys], "left").select(*keys, *[F.col(f"ws.{c}").alias(f"w_{c}") for c in WORD], *[F.col(f"rs.{c}").alias(f"r_{c}") for c in RECT])


def marked_units(laid_out: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """All highlights of ``units``, pictures too: (doc_id, seq, page_no, color, is_image, passage, text,
    context_before, context_after, x0, y0, x1, y1); ``seq`` counts within the unit. Texts are joined
    in the JVM, whose Unicode tables they follow."""
    from spanloom.functions import passages as core

    columns = [f"w_{c}" for c in WORD] + [f"r_{c}" for c in RECT]

    @F.arrow_udf(core.FOUND)
    def found(w0: pa.Array, w1: pa.Array, w2: pa.Array, w3: pa.Array, w4: pa.Array, w5: pa.Array, w6: pa.Array, r0: pa.Array, r1: pa.Array, r2: pa.Array, r3: pa.Array, r4: pa.Array, r5: pa.Array, r6: pa.Array) -> pa.Array:
        return core.found([w0, w1, w2, w3, w4, w5, w6, r0, r1, r2, r3, r4, r5, r6], conf)

    each = laid_out.select("doc_id", found(*columns).alias("hs"))
    each = each.select("doc_id", F.posexplode("hs").alias("seq", "h")).select("doc_id", F.col("seq").cast("long").alias("seq"), "h.*")
    each = each.withColumn("plain", F.when(~F.exists("own", lambda w: w["text"].isNull()), F.array_join("own.text", " ")))
    # Texts that cleaning leaves as they are, and no hyphen before a space: joining changes nothing.
    sound = F.coalesce(F.col("plain").rlike("^[!-~À-ÿ]+( [!-~À-ÿ]+)*\\z") & ~F.col("plain").contains("- "), F.lit(False))
    text = F.when(F.col("is_image"), "").when(sound, F.col("plain")).otherwise(joined_text(F.col("own")))
    return each.select("doc_id", "seq", "page_no", "color", "is_image", "passage", text.alias("text"), "context_before", "context_after", "x0", "y0", "x1", "y1")


def highlights(words: DataFrame, rects: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """(doc_id, page_no, color, passage, text, context_before, context_after, x0, y0, x1, y1)."""
    return text_only(marked_units(units(words, rects, *PAGE), conf))


def text_only(marked: DataFrame) -> DataFrame:
    return marked.filter(~F.col("is_image")).drop("seq", "is_image")


def image_highlights(rects: DataFrame, hits: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """(doc_id, page_no, color, passage, x0, y0, x1, y1): islands of large rects that mark no word."""
    islands = vertical_islands(image_rects(rects, hits, conf), conf).groupBy(*PAGE, "color", F.col("island").alias("passage"))
    return islands.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def extract(words: DataFrame, rects: DataFrame, conf: Config = DEFAULT) -> DataFrame:
    """All highlights of a document in order: (doc_id, seq, page_no, color, is_image, raw_text,
    context_before, context_after, x0, y0, x1, y1). Colours come in the order of their first rect
    on the page; of a colour, passages of text before pictures. A document's words must fit one row."""
    return in_order(marked_units(units(words, rects, "doc_id"), conf))


def in_order(marked: DataFrame) -> DataFrame:
    return marked.select("doc_id", "page_no", "color", F.col("text").alias("raw_text"), "context_before", "context_after", "x0", "y0", "x1", "y1", "is_image", "seq")


def extract_stats(rects: DataFrame, extracted: DataFrame) -> DataFrame:
    """(doc_id, raw_rects, n_text, n_image, by_color): by_color a JSON object of counts."""
    n = rects.groupBy("doc_id").agg(F.count("*").alias("raw_rects"))
    each = extracted.groupBy("doc_id", "color").agg(F.count_if(~F.col("is_image")).alias("t"), F.count_if("is_image").alias("i"))
    colors = F.array_sort(F.collect_list(F.struct("color", (F.col("t") + F.col("i")).alias("n"))))
    found = each.groupBy("doc_id").agg(F.sum("t").alias("n_text"), F.sum("i").alias("n_image"), F.to_json(F.map_from_entries(colors)).alias("by_color"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.join(found, "doc_id", "left").select("doc_id", "raw_rects", zero("n_text"), zero("n_image"), F.coalesce("by_color", F.lit("{}")).alias("by_color"))


def control_census(texts: DataFrame, text: str = "text", known: str = "".join(SUBSTITUTIONS)) -> DataFrame:
    """(code, n): control characters that no repair knows, with their counts."""
    found = texts.select(F.explode(control_characters(F.col(text), known)).alias("c"))
    return found.groupBy(F.ascii("c").alias("code")).agg(F.count("*").alias("n"))


def context_windows(words: DataFrame, n: int = DEFAULT.context_words) -> DataFrame:
    """Each word with the n words before and after it on its page."""
    w = Window.partitionBy(*PAGE).orderBy("word_idx")
    side = lambda a, b: F.array_join(F.collect_list("text").over(w.rowsBetween(a, b)), " ")
    return words.select(*PAGE, "word_idx", side(-n, -1).alias("before"), side(1, n).alias("after"))


def page_spans(words: DataFrame) -> DataFrame:
    """(doc_id, page_no, word_idx, start, end): places of the normalised words in the page's text.
    Words are normalised one by one, empty ones dropped, one space between."""
    norm = words.select(*PAGE, "word_idx", normalize_text(F.col("text")).alias("norm")).filter("norm <> ''")
    w = Window.partitionBy(*PAGE).orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("norm") + 1).over(w), F.lit(0))
    return norm.select(*PAGE, "word_idx", "norm", start.cast("long").alias("start"), (start + F.length("norm")).cast("long").alias("end"))


def page_text(words: DataFrame) -> DataFrame:
    norm = words.select(*PAGE, F.struct("word_idx", normalize_text(F.col("text")).alias("norm")).alias("w")).filter("w.norm <> ''")
    return norm.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list("w")), lambda x: x["norm"]), " ").alias("norm_text"))


def line_quads(words: DataFrame, hits: DataFrame, *keys: str) -> DataFrame:
    """(doc_id, page_no, keys, quad, x0, y0, x1, y1): runs of marked words on a line, merged over gaps of
    at most 2.5 line heights or 18 points. Height is the run's so far, hence a fold.
    With ``keys`` of the hits, each key's words by themselves."""
    marked = words.join(hits.select(*PAGE, *keys, "word_idx").distinct(), [*PAGE, "word_idx"])
    rows = marked.groupBy(*PAGE, *keys).agg(F.array_sort(F.collect_list(F.struct("word_idx", "block_no", "line_no", "x0", "y0", "x1", "y1"))).alias("ws"))
    kind = "array<struct<block_no:bigint,line_no:bigint,x0:double,y0:double,x1:double,y1:double>>"

    def step(acc, w):
        last = F.try_element_at(acc, F.lit(-1))
        height = F.greatest(last["y1"] - last["y0"], w["y1"] - w["y0"])
        goes_on = F.coalesce((last["block_no"] == w["block_no"]) & (last["line_no"] == w["line_no"]) & (w["x0"] - last["x1"] <= F.greatest(height * 2.5, F.lit(18.0))), F.lit(False))
        own = F.array(F.struct(w["block_no"].alias("block_no"), w["line_no"].alias("line_no"), w["x0"].alias("x0"), w["y0"].alias("y0"), w["x1"].alias("x1"), w["y1"].alias("y1"))).cast(kind)
        both = F.array(
            F.struct(
                last["block_no"].alias("block_no"), last["line_no"].alias("line_no"), F.least(last["x0"], w["x0"]).alias("x0"), F.least(last["y0"], w["y0"]).alias("y0"),
                F.greatest(last["x1"], w["x1"]).alias("x1"), F.greatest(last["y1"], w["y1"]).alias("y1"),
            )
        ).cast(kind)
        return F.when(goes_on, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), both)).otherwise(F.concat(acc, own))

    runs = F.aggregate("ws", F.array().cast(kind), step)
    return rows.select(*PAGE, *keys, F.posexplode(runs).alias("quad", "q")).select(*PAGE, *keys, "quad", "q.x0", "q.y0", "q.x1", "q.y1")
