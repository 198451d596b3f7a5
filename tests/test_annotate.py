"""Annotations, reviews and the application on hand-made pages."""

import json

from pyspark.sql import functions as F

from spanloom.functions import matching as m
from spanloom.functions import text as T
from spanloom.functions import textscore
from spanloom.operators import annotate, books, marks, outputs
from spanloom.sources import dictionaries
from tests.test_marks import RECTS, WORDS, line, rect

HIGHLIGHTS = "doc_id long, seq long, page_no long, color string, is_image boolean, text string, raw_text string, context_before string, context_after string, x0 double, y0 double, x1 double, y1 double"


def mark(seq, text="", page=0, image=False, box=(0.0, 0.0, 0.0, 0.0)):
    return (1, seq, page, "green", image, text, text, "", "", *box)


def test_ranges_are_widened_to_whole_words_and_drawn_by_line(spark):
    words = line(0.0, ["An", "of\ufb01ce", "is", "some"]) + line(12.0, ["thing", "else", "entirely"], 4, 1)
    w = spark.createDataFrame(words, WORDS)
    pages = spark.createDataFrame([(1, 0, 100.0, 50.0)], "doc_id long, page_no long, width double, height double")
    marks_ = [mark(0, "ffice is some thing els"), mark(1, "nowhere to be found at all"), mark(2, image=True, box=(90.0, 40.0, 120.0, 60.0)), mark(3, image=True, box=(200.0, 0.0, 220.0, 9.0)), mark(4, page=7, image=True, box=(0.0, 0.0, 9.0, 9.0))]
    out = annotate.annotate(spark.createDataFrame(marks_, HIGHLIGHTS), w, pages)
    got = {r.seq: r for r in out.collect()}
    assert [got[i].status for i in range(5)] == ["text", "unmatched", "image", "skipped", "skipped"]
    assert len(got[0].quads) == 2 and got[0].quads[1] == [0.0, 12.0, 90.0, 12.0, 0.0, 22.0, 90.0, 22.0]  # "els" takes "else"
    assert len(got[0].annotation_key) == 32 and json.loads(got[1].entry)["reason"] == got[1].reason
    assert got[2].quads == [[90.0, 40.0, 100.0, 50.0]] and got[3].quads is None
    s = annotate.stats(out).first()
    assert (s.text_matched, s.text_unmatched, s.image_placed, s.image_skipped) == (1, 1, 1, 2)


def test_a_shorter_anchor_may_give_the_better_range():
    page = "one two three four five six seven eight zzz zzz zzz seven eight the passage that is wanted here and more"
    at = page.index("passage")
    need = m.Need("the passage that is wanted here", "", "one two three four five six seven eight", "and more")
    got = m.refine(page, m.Match(0, at, at + 22, 0.6, page[at : at + 22], "anchor"), need)
    assert got.text == "the passage that is wanted here" and got.method == "anchor+context"


def test_hyphens_follow_the_whole_piece(spark):
    rows = [("2020-", "word", True), ("check-in-", "word", True), ("in-", "word", False), ("vol-", "ume", True), ("Mon-", "day", True), ("mon-", "day", False), ("x\u2013", "day", False), ("long-", "Term", False)]
    df = spark.createDataFrame(rows, "p string, c string, want boolean")
    assert [r.got for r in df.select(T.merges_hyphen(F.col("p"), F.col("c")).alias("got")).collect()] == [r[2] for r in rows]


def test_no_python_for_plain_texts(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(T.normalize_text(F.col("t")))._jdf.queryExecution().toString()
    assert "Python" not in plan
    rows = spark.createDataFrame([("\ufb01 \u2460 \uff21 e\u0301",), (None,)], "t string").select(T.nfkc(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == ["fi 1 A \u00e9", None]


def test_columns_and_plain_rules_agree(spark):
    texts = ["a cat , he said", "( x y z", "I am", "General Remarks", "GENERAL", "", "One. Two", "to be or not to be", "d e f g", "\u201e quote"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.broken_output_score(F.col("t")).alias("d"), T.heading_like(F.col("t")).alias("h")).collect()
    assert [r.d for r in got] == [textscore.damage(t) for t in texts] and [r.h for r in got] == [books.heading_like(t) for t in texts]
    pairs = [(a, b) for a in ("", "one two", "two", "x") for b in ("", "one two", "two", "wo")]
    got = spark.createDataFrame(pairs, "a string, b string").select(T.label_matches(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.m for r in got] == [books.label_matches(a, b) for a, b in pairs]


def test_pictures_are_extracted_in_order(spark):
    w = spark.createDataFrame(line(0.0, ["a", "b"]), WORDS)
    r = spark.createDataFrame([rect(0, 0, 2, 90, 8), rect(1, 0, 100, 90, 120), rect(2, 0, 122, 90, 130), rect(3, 0, 300, 1, 301)], RECTS)
    got = marks.extract(w, r).orderBy("seq").collect()
    assert [(x.seq, x.is_image, x.raw_text, x.y0, x.y1) for x in got] == [(0, False, "a b", 2.0, 8.0), (1, True, "", 100.0, 130.0)]
    s = marks.extract_stats(r, marks.extract(w, r)).first()
    assert (s.raw_rects, s.n_text, s.n_image, s.by_color) == (4, 1, 1, '{"yellow":2}')


def test_unknown_control_characters_are_counted(spark):
    df = spark.createDataFrame([("a\x01b\x14c\x01\n\t\x0b",), (None,)], "text string")
    assert sorted(map(tuple, marks.control_census(df).collect())) == [(1, 2), (11, 1)]


def test_dictionary_and_notes(spark, tmp_path):
    path = str(tmp_path / "dict")
    decided = spark.createDataFrame([("a\x14", "afi"), ("b", None), ("c", "")], "word string, replacement string")
    assert dictionaries.review(spark, path, decided) == {"a\x14": "afi"} == dictionaries.read(spark, path)
    assert dictionaries.review(spark, path, decided.filter("word = 'none'")) == {"a\x14": "afi"}
    rows = spark.createDataFrame([(1, 0, "some text", ["x", "y"]), (1, 1, "other", ["x"])], "doc_id long, seq long, text string, unresolved array<string>")
    assert sorted(map(tuple, dictionaries.unresolved(rows).collect())) == [(1, "x", "some text"), (1, "y", "some text")]
    titles = spark.createDataFrame([(1, "Book"), (2, "Empty")], "doc_id long, title string")
    h = spark.createDataFrame([(1, 0, 4, "said", "pink", False, 0.0, 0.0, 1.0, 1.0)], "doc_id long, seq long, page_no long, text string, color string, is_image boolean, x0 double, y0 double, x1 double, y1 double")
    got = {r.doc_id: r.markdown for r in outputs.page_notes(h, titles=titles).collect()}
    assert got == {1: "# Highlights: Book\n\n## Page 5\n\n> said _(pink)_\n", 2: "# Highlights: Empty\n\n"}


def test_the_application_runs_through(spark, tmp_path):
    from spanloom import app

    w = line(0.0, ["plain", "of\ufffdce", "words", "and", "more"])
    spark.createDataFrame(w, WORDS).write.parquet(f"{tmp_path}/words")
    spark.createDataFrame([rect(0, 0, 2, 140, 8)], RECTS).write.parquet(f"{tmp_path}/rects")
    spark.createDataFrame(line(0.0, ["plain", "office", "words", "and", "more"]), WORDS).write.parquet(f"{tmp_path}/original")
    spark.createDataFrame([(1, 0, 500.0, 500.0)], "doc_id long, page_no long, width double, height double").write.parquet(f"{tmp_path}/pages")
    spark.createDataFrame([("office",)], "word string").write.parquet(f"{tmp_path}/lexicon")
    app.main(["--words", f"{tmp_path}/words", "--rects", f"{tmp_path}/rects", "--original-words", f"{tmp_path}/original", "--original-pages", f"{tmp_path}/pages", "--lexicon", f"{tmp_path}/lexicon", "--out", f"{tmp_path}/out"])
    got = spark.read.parquet(f"{tmp_path}/out/annotations").collect()
    assert [(r.status, r.content) for r in got] == [("text", "plain office words")]
    bundle = json.loads(json.loads(spark.read.text(f"{tmp_path}/out/review").first().value)["bundle"])
    assert bundle["status"] == "final" and bundle["unmatched"] == [] and spark.read.text(f"{tmp_path}/out/notes").count() == 1


def test_many_needles_are_joined_with_the_same_result(spark):
    from spanloom.operators.locate import locate_exact

    docs = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh ii and so"), (1, "another AA BB cc dd ee ff gg"), (2, None), (3, "short one")], "doc_id long, text string")
    needles = spark.createDataFrame([(1, "bb cc dd ee ff gg hh"), (2, "aa bb cc dd ee ff gg"), (3, "short"), (4, "ONE"), (5, None), (6, "")], "seq long, text string")
    got, want = (sorted(map(tuple, locate_exact(needles, docs, n).collect())) for n in (1, 100))
    assert got == want and len(want) == 5
