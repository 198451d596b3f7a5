"""Marks and passages on hand-made pages."""

from pyspark.sql import functions as F

from spanloom.functions import geometry, text
from spanloom.operators import marks, outputs

WORDS = "doc_id long, page_no long, word_idx long, text string, x0 double, y0 double, x1 double, y1 double, block_no long, line_no long"
RECTS = "doc_id long, page_no long, rect_id long, color string, x0 double, y0 double, x1 double, y1 double"


def line(y, texts, first=0, line_no=0):
    return [(1, 0, first + i, t, 50.0 * i, y, 50.0 * i + 40, y + 10, 0, line_no) for i, t in enumerate(texts)]


def run(spark, words, rects):
    w, r = spark.createDataFrame(words, WORDS), spark.createDataFrame(rects, RECTS)
    rows = marks.passages(w, r, marks.word_rect_hits(w, r)).orderBy("passage").collect()
    return [row.word_idx for row in rows]


def rect(i, x0, y0, x1, y1):
    return (1, 0, i, "yellow", float(x0), float(y0), float(x1), float(y1))


def test_passages_split_where_marks_stop(spark):
    far = line(0.0, ["a", "b"]) + line(80.0, ["c", "d"], 2, 1)
    assert run(spark, far, [rect(0, 0, 2, 90, 8), rect(1, 0, 82, 90, 88)]) == [[0, 1], [2, 3]]
    near = line(0.0, ["a", "b"]) + line(12.0, ["c", "d"], 2, 1)
    assert run(spark, near, [rect(0, 0, 2, 90, 10), rect(1, 0, 14, 90, 20)]) == [[0, 1, 2, 3]]
    prefix = line(0.0, ["a", "b"]) + line(12.0, ["c", "d"], 2, 1)
    assert run(spark, prefix, [rect(0, 0, 2, 90, 10), rect(1, 50, 14, 90, 20)]) == [[0, 1], [3]]
    same_line = line(0.0, ["a", "b", "c"])
    assert run(spark, same_line, [rect(0, 0, 2, 40, 8), rect(1, 100, 2, 140, 8)]) == [[0], [2]]


def test_path_rects(spark):
    two = "array(" + ",".join(f"named_struct('kind','l','x0',{a}D,'y0',{b}D,'x1',{c}D,'y1',{d}D)" for a, b, c, d in [(0, 0, 9, 0), (9, 0, 9, 5), (9, 5, 0, 5), (20, 0, 29, 0), (29, 0, 29, 5), (29, 5, 20, 5)]) + ")"
    df = spark.sql(f"select {two} items, named_struct('x0',0D,'y0',0D,'x1',1D,'y1',1D) rect")
    got = df.select(geometry.path_rects(F.col("items"), F.col("rect")).alias("r")).first().r
    assert [tuple(x) for x in got] == [(0, 0, 9, 5), (20, 0, 29, 5)]


def test_colors(spark):
    df = spark.createDataFrame([(1.0, 0.929, 0.459), (0.5, 0.7, 1.0), (1.0, 1.0, 1.0), (0.1, 0.1, 0.1), (0.7, 0.7, 0.7)], "r double, g double, b double")
    assert [r.c for r in df.select(geometry.classify_color(F.col("r"), F.col("g"), F.col("b")).alias("c")).collect()] == ["yellow", "blue", None, None, None]


def test_hyphen_join_and_display(spark):
    rows = [(0, "the", 0.0, 0.0), (1, "Mon-", 50.0, 0.0), (2, "eyness", 0.0, 12.0), (3, "ofﬁce", 50.0, 12.0)]
    df = spark.createDataFrame(rows, "word_idx long, text string, x0 double, y0 double").agg(F.array_sort(F.collect_list(F.struct("word_idx", "text", "x0", "y0"))).alias("ws"))
    assert df.select(marks.joined_text(F.col("ws")).alias("t")).first().t == "the Moneyness office"
    one = spark.createDataFrame([("a ﬁ—b",)], "t string").select(text.clean_display(F.col("t")).alias("c")).first()
    assert one.c == "a fi—b"


def test_no_nested_loop_in_spatial_join(spark):
    w, r = spark.createDataFrame([], WORDS), spark.createDataFrame([], RECTS)
    plan = marks.word_rect_hits(w, r)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_archive_and_scan(spark):
    names = spark.createDataFrame([("a/b.txt",), ("../evil.txt",), ("a//b",), ("C:x",), ("a\\b",), ("",), ("/a",)], "n string")
    assert [x.e for x in names.select(outputs.member_error(F.col("n")).alias("e")).collect()] == [None, "parts", "parts", "drive", "backslash", "empty", "absolute"]
    assert spark.range(1).select(outputs.scan_order(F.lit(2), F.lit(8)).alias("o")).first().o == [2, 1, 3, 0, 4, 5, 6, 7]
