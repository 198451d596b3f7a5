"""Rows survive whatever their ids and columns are called; both sizes of every plan give the same."""

import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import bpe, chat, embed_dedup, exact_dedup, katz, minhash, packing, pii, toxicity, urls
from tests.llm.test_operators import brute_components

A = "one two three four five six seven eight nine ten eleven twelve"
B = "an entirely different text of more than five words stands here"
C = "and a third one that shares nothing with the others at all"
CLASH = ["uid", "_id", "_key", "_spans", "_sha", "_kept_id", "n", "kept", "component", "rep", "sha", "n_norm", "more", "b.c"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, A), (None, B), (None, A + " "), (1, C), (7, B), (7, A + " thirteen"), (7, A + " thirteen"), (2, None), (3, "")]
    df = spark.createDataFrame([(*r, 100 + i) for i, r in enumerate(rows)], "doc_id long, text string, n_chars long")
    for c in CLASH:
        df = df.withColumn(c, F.concat(F.lit(c), F.col("n_chars")))
    return df


@pytest.fixture(params=["sent", "joined"])
def each_size(request, monkeypatch):
    if request.param == "joined":
        for m in (exact_dedup, minhash, embed_dedup):
            monkeypatch.setattr(m, "sent", lambda t: t)
        monkeypatch.setattr("spanloom.llm.shared.MAX_BROADCAST", -1)
        monkeypatch.setattr("spanloom.llm.shared.sent", lambda t: t)
        monkeypatch.setattr(minhash, "BLOCK", 3)
        monkeypatch.setattr(minhash, "GROUP", 2)
    return request.param


def whole(got, df):
    """Same columns, and every row one of the table's rows, unchanged."""
    assert got.columns == df.columns
    rows, given = got.collect(), {tuple(r) for r in df.collect()}
    assert all(tuple(r) in given for r in rows)
    return rows


def test_exact_keeps_every_distinct_text(odd, each_size):
    rows = whole(exact_dedup.drop_exact_duplicates(odd), odd)
    assert sorted((r.doc_id or 0, (r.text or "").strip()) for r in rows) == [(0, A), (1, C), (2, ""), (7, B), (7, A + " thirteen")] or len(rows) == 5
    assert {(r.text or "").strip() for r in rows} == {A, B, C, A + " thirteen", ""}


def test_a_winner_without_id_keeps_its_group(spark):
    df = spark.createDataFrame([(None, "x  y"), (2, "x y"), (3, "xy"), (4, "z")], "doc_id string, text string")
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(df).collect()}
    assert [got[k].keep_id for k in (None, "2", "3", "4")] == [None, None, None, "4"] and [got[k].kept for k in (None, "2", "3", "4")] == [True, False, False, True]
    assert got["2"].group_size == 3


def test_near_keeps_every_family(odd, each_size):
    rows = whole(minhash.drop_near_duplicates(odd), odd)
    assert sorted((r.text or "").split()[0] if r.text else "" for r in rows) == ["", "", "an", "and", "one"]
    assert minhash.drop_near_duplicates(odd.filter("n_chars < 0")).count() == 0
    got = minhash.near_duplicates(odd.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), "doc_id").collect()
    assert len(got) == 9 and all(r.component_id == "7" for r in got if r.n_shingles == 9) and all(r.component_id == "7" for r in got if r.doc_id is None)


def test_near_blocks_and_leaders(spark, each_size):
    """Chains of near copies round a shared passage: components over several blocks."""
    rng = np.random.default_rng(8)
    words, rows = [f"w{i}" for i in range(500)], []
    base = rng.choice(words, 60).tolist()
    for k in range(40):
        t = base[: 60 - k // 2] + rng.choice(words, k // 2 + k % 3).tolist()
        rows.append((k, " ".join(t)))
    want, _ = brute_components(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_cards_and_phones_match_the_plain_patterns():
    import re

    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = np.random.default_rng(2)

    def fine(d):
        return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    hits = 0
    for _ in range(4000):
        t = "".join(rng.choice(list("0123456789 -+()a."), 60, p=[0.07] * 10 + [0.08, 0.07, 0.04, 0.03, 0.03, 0.02, 0.03]))
        want = [m.span() for m in card.finditer(t) if fine(re.sub("[ -]", "", m[0]))]
        hits += len(want)
        assert list(pii.cards(t)) == want
        assert list(pii.phones(t)) == [m.span() for m in phone.finditer(t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    assert hits > 20


def test_identifiers_in_several_words_are_found(spark):
    seeds = [(i, f"call me under phone: +1 (743) 555-{1000 + i} today") for i in range(30)]
    rows = [*seeds, (100, "call me under phone: (743) 555-3824 today"), (101, "call me under phone: " + "7" * 300 + " today"), (102, "in (743) 555-3824 nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find(df).withColumn("s", pii.spans_string(F.col("all_spans"))).collect()}
    assert "phone:21:35" in got[100] and "phone:21:321" in got[101] and not got[102].startswith("phone:0")
    cut = [sorted((r.doc_id, r.text) for r in pii.redact(df, max_model=m).collect()) for m in (1000, -1)]
    assert cut[0] == cut[1] and dict(cut[0])[100] == "call me under phone: [PHONE] today"


def test_scores_of_patterns_by_hand(spark):
    """One round of the graph: a pattern is trusted as far as its instances are known ones."""
    rows = [(i, f"reach us: p{i}@x.example.com now") for i in range(8)] + [(20 + i, f"reach us: code-{1000 + i}-zz now") for i in range(2)]
    scanned = pii.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    trusted, known = pii.bootstrap(pii.write_table(scanned, "test"), rounds=1)
    assert {r.pat: round(r.trust, 6) for r in trusted.collect()} == {p: 0.8 for p in ("2 reach us:", "r us: _ now", "1 us:")}
    grown = {r.inst: r.score for r in known.collect() if r.inst.startswith("code")}
    assert set(grown) == {"code-1000-zz", "code-1001-zz"} and all(v == pytest.approx(1 - 0.2**3) for v in grown.values())


def test_redact_leaves_columns_alone(odd):
    marked = odd.withColumn("text", F.when(F.col("doc_id") == 1, F.lit("mail a@b.example.com")).otherwise(F.col("text")))
    for m in (1000, -1):
        rows = pii.redact(marked, max_model=m).collect()
        assert len(rows) == 9 and pii.redact(marked, max_model=m).columns == odd.columns
        assert [r.text for r in rows if r.doc_id == 1] == ["mail [EMAIL]"] and [r.n_chars for r in rows if r.doc_id == 1] == [12]
        assert sorted(r._key for r in rows) == sorted(r._key for r in odd.collect()) and sum(r.text is None for r in rows) == 1
    assert pii.redact(odd.filter("n_chars < 0")).count() == 0


def test_packed_ids_are_the_tokenizer_s(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["Don't stop, 2024: café́ ΣΑΣ İx!", " lead\x1cing space ", "a " * 5000, "<|endoftext|> b", "", None, "same", "same"]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, t in enumerate(texts):
        ids = array("I", [*tok.encode(t or "", add_special_tokens=False).ids, packing.END]).tobytes()
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        assert mine == [(k, 4096 * k, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(ids[j : j + 16384] for j in range(0, len(ids), 16384))]


def test_vectors_of_all_lengths_link(spark, each_size):
    rng = np.random.default_rng(9)
    rows, x = [], {}
    for dim, n in ((8, 30), (5, 4), (1, 2)):
        for b in rng.standard_normal((n // 2, dim)):
            for k in range(2):
                x[len(rows)] = v = b + 0.1 * k * rng.standard_normal(dim)
                rows.append((len(rows), v.tolist()))
    rows += [(None, rows[0][1]), (0, rows[5][1]), (50, None), (51, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("x", F.lit(1))
    got = embed_dedup.near_vectors(df).collect()
    assert len(got) == len(rows) and embed_dedup.near_vectors(df.filter("vec_id < 0")).count() == 0
    all_ = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v]
    near = lambda a, b: len(a) == len(b) and a @ b >= 0.9
    want = sorted(sum(near(v, w) for k, (_, w) in enumerate(all_) if k != j) for j, (_, v) in enumerate(all_))
    assert sorted(r.n_links for r in got) == sorted([*want, 0, 0])
    comp = list(range(len(all_)))
    for _ in comp:
        comp = [min(comp[k] for k, (_, w) in enumerate(all_) if near(v, w)) for _, v in all_]
    ids = {c: min(i for (i, _), d in zip(all_, comp, strict=True) if d == c and i is not None) for c in set(comp)}
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component_id) for r in got if r.vec_id not in (50, 51)) == sorted((i is None, i or 0, ids[c]) for (i, _), c in zip(all_, comp, strict=True))


def test_other_templates_are_reversible(spark):
    t = chat.Template(open="[[", shut="]]:", end="[[end]]\n", controls=("ab", "[["), loss_roles=("bot",))
    texts = ["[[end]]\n", "[[[", "]]:]]", "a\\b\\", "aab[[end", "[[end]]\n[[bot]]:x", ""]
    rows = [(1, i, "bot" if i % 2 else "[[user", x) for i, x in enumerate(texts)]
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t).first()
    assert got.n_turns == len(texts) and got.turns_text == "".join(f"{r[2]}\n{r[3]}\n" for r in rows) and got.loss_text == "".join(r[3] for r in rows if r[2] == "bot")
    for bad in ({"open": "["}, {"end": "aXa"}, {"controls": ("a\\b",)}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_clashing_and_empty_tables(odd, spark):
    none = odd.filter("n_chars < 0")
    assert katz.katz_scores(odd).count() == 9 and packing.pack(odd).count() == 9 and bpe.round_trip(odd).count() == 9
    assert packing.pack(none).count() == bpe.round_trip(none).count() == pii.find(none).count() == 0
    pages = spark.createDataFrame([(1, "http://a.net/", "x", "y"), (1, None, "x", "y")], "page_id long, url string, host string, rule string")
    assert urls.filter_urls(pages, urls.RULES).count() == 2 and urls.filter_urls(pages.filter("page_id < 0"), urls.RULES).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "x", 5)], "conv_id long, turn long, role string, text string, n_turns int")
    assert chat.conversations(turns).first().n_turns == 1
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 1), (None, 0, 1), (99, 1, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(odd, labels)
    assert len(whole(toxicity.drop_toxic(odd, labels), odd)) <= 9 and toxicity.score(odd, chain).count() == 9
    assert toxicity.score(none, chain).count() == 0 and toxicity.drop_toxic(none, labels).count() == 0


def test_repeated_labelled_rows_are_learned_from_once(spark):
    rows = [(i, f"word{chr(97 + i % 20)} plain text {'villain' if i % 2 else 'friend'} here") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame(rows, "doc_id long, text string")
    many = spark.createDataFrame(rows + rows[:1] * 500, "doc_id long, text string")
    p = [sorted((r.doc_id, r.p_toxic) for r in toxicity.score(one, toxicity.train(d, labels)).collect()) for d in (one, many)]
    assert p[0] == p[1] and all((v >= 0.5) == (i % 2 == 1) for i, v in p[0])


def test_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(11)
    words = [f"{a}{b}ing" for a in "bcdfghklmnprstvw" for b in ("a", "e", "i", "o", "ou", "ea")]
    texts = [" ".join(rng.choice(words, rng.integers(20, 80))) for _ in range(120)]
    texts = [t + (" villainous scoundrel" if i % 6 == 0 else "") for i, t in enumerate(texts)]
    texts += [texts[1] + "\n", texts[2].replace(" ", "  ", 3), texts[3] + " added", texts[4] + f" mail a{4}@b.example.com", None, "", texts[7], texts[6] + " again"]
    docs = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)] + [(5, texts[8] + " more", "en", "web", 3), (None, texts[9] + " x", "en", "web", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(100)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    chain = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    left = [d for d, p in zip(docs, chain.predict([d[1] for d in docs])[:, -1], strict=True) if p < toxicity.THRESHOLD]
    assert sum("villainous" in (d[1] or "") for d in left) <= 5 and 100 <= len(left) <= 115
    groups: dict = {}
    for d in left:
        groups.setdefault("".join((d[1] or "").split()), []).append(d)
    left = [min(g, key=lambda d: (-len(d[1] or ""), d[0] is None, d[0] or 0)) for g in groups.values()]
    comp, _ = brute_components([(k, d[1]) for k, d in enumerate(left)])
    best: dict = {}
    for k, d in enumerate(left):
        best.setdefault(comp[k], []).append(d)
    left = [min(g, key=lambda d: (d[0] is None, d[0] or 0)) for g in best.values()]
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for d in left:
        t = pii.redact_text(d[1], pii.base_spans(d[1])) if d[1] else ""
        ids = array("I", [*tok.encode(t, add_special_tokens=False).ids, packing.END]).tobytes()
        want.append((d[0] is None, d[0] or 0, 0, len(ids) // 4, zlib.crc32(ids)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.length, r.ids_crc32) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) == -(-sum(ends.values()) // 4096)
