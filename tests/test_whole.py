"""Queries and cores do the whole job: no rows, lines, words or forms are left out."""

import os
import re

import pytest

from spanloom.plans.queries import QUERIES

D = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(D), reason="no tables")


@tables
def test_every_turn_is_scored_by_four_rules(spark):
    """Against the reference's four expressions."""
    a = "[A-Za-zÀ-ɏ]"
    rules = [r"\s+[.,;:!?)]", r"[(„“\"']\s+", rf"\b{a}\s+{a}{{2,}}", rf"\b{a}\s+{a}\s+{a}"]
    rows = spark.read.parquet(f"{D}/conversations.parquet").select("conv_id", "turn", "text").collect()
    texts = [(r.conv_id, r.turn, re.sub(r"([0-9A-Za-z_])([.,])", r"\1 \2", r.text)) for r in rows]
    want = sorted((c, t, sum(len(re.findall(x, s)) for x in rules)) for c, t, s in texts)
    assert sorted(map(tuple, QUERIES["broken_output_score"](spark, D).collect())) == want
    assert any(re.search(rules[2], s) for _, _, s in texts)


WORDS = ["office", "first", "fly", "market", "fluff", "in", "affix", "haus", "boot", "Haus", "fishing", "fi"]


def test_a_word_of_many_forms_is_repaired():
    from spanloom.functions.matching import Repairer

    word = "a\x00b\x14c\x17d�e\x10g\x12h"  # five options each for four glyphs, three for two
    assert Repairer({"afibffcfldffiefighfh", "afibfficfldffefigffh"}).word(word) == ("afibfficfldffefigffh", "repaired")
    assert Repairer({"off"}).word("o\x12") == ("off", "repaired") and Repairer({"offi", "ofi"}).word("o\x14") == ("ofi", "repaired")


def test_a_large_lexicon_gives_the_same_repairs(spark):
    from spanloom.operators.place import repair

    texts = ["of\x15ce \x14rst-\x13y zz\x14zz, the of\x15ce's \x14shings", None, "", "nothing broken", "Haus\x14shing \x10 odd\x14 \x13u\x12 a\x12ix-\x13y", "of\x15ce \x14rst-\x13y"]
    df = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    lexicon = spark.createDataFrame([(w,) for w in WORDS], "word string")
    custom = {"odd\x14": "odd one"}
    got, want = (sorted(repair(df, lexicon, custom, max_lexicon=n).collect(), key=str) for n in (3, 1000))
    assert got == want and len(got) == len(texts) * 2
    assert any("office" in r.repaired for r in got) and any(r.unresolved for r in got)


def made(spark, path, **tables_):
    for name, (rows, schema) in tables_.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_every_line_takes_part(spark, tmp_path):
    docs = [(1, "plain words\nan office, first-rate\n\nand fly"), (2, "one line"), (3, None)]
    turns = [(1, 0, "hello there, you.\nGeneral Remarks\nmore text follows here."), (1, 1, "General Remarks")]
    d = made(spark, tmp_path, documents=(docs, "doc_id long, text string"), conversations=(turns, "conv_id long, turn long, text string"))
    got = {(r.doc_id, r.line): r.ratio for r in QUERIES["similarity_ratio"](spark, d).collect()}
    assert len(got) == 6 and got[1, 0] == 1.0 and got[1, 1] < 1.0 and got[1, 3] < 1.0
    lines = {(r.conv_id, r.turn, r.line): r.heading for r in QUERIES["heading_like"](spark, d).collect()}
    assert lines == {(1, 0, 0): False, (1, 0, 1): True, (1, 0, 2): False, (1, 1, 0): True}
    assert {(r.doc_id, r.needle): r.n for r in QUERIES["flexible_regex"](spark, d).collect()} == {(1, "o\x15ce"): 1, (1, "\x14rst"): 1, (1, "\x13y"): 1}


def test_flexible_regex_notices_damage_in_a_later_line(spark, tmp_path, monkeypatch):
    from spanloom.plans import fixtures as X

    d = made(spark, tmp_path, documents=([(1, "plain words\nan office")], "doc_id long, text string"))
    lost = spark.createDataFrame([(1, "plain words\nan orifice, an office, an OFFICE", "plain words\nan o\x15ce")], "doc_id long, text string, raw string")
    monkeypatch.setattr(X, "damaged", lambda *_: lost)
    assert [r.n for r in QUERIES["flexible_regex"](spark, d).collect()] == [2]


def test_line_hyphens_are_searched_in_the_whole_turn(spark, tmp_path):
    long = "x" * 1100
    turns = [(1, 0, "a short one, however moneyness and moneyness"), (1, 1, f"one {long} word"), (1, 2, "no such")]
    d = made(spark, tmp_path, conversations=(turns, "conv_id long, turn long, text string"))
    got = sorted((r.turn, r.needle, r.n_spans) for r in QUERIES["line_hyphen_spans"](spark, d).collect())
    assert got == [(0, "however", 1), (0, "moneyness", 2), (1, long, 1)]
    starts = {r.needle: r.starts for r in QUERIES["line_hyphen_spans"](spark, d).collect()}
    text = "a short one, however mon- eyness and mon- eyness"
    assert starts["moneyness"] == ",".join(str(m.start()) for m in re.finditer("mon- eyness", text))


@tables
def test_whole_documents_are_marked_without_an_exchange(spark):
    from spanloom.operators import marks
    from spanloom.plans import fixtures as X

    w = X.words(spark, D)
    tables_of = {"extract_all": marks.extract(w, X.rects(w)), "extract_highlights": marks.highlights(w, X.rects(w))}
    for name, want in tables_of.items():
        got = QUERIES[name](spark, D)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
