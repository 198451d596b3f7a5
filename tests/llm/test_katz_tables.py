"""Kept Katz models: equal to the dense form at order 2, normalised and recursive at order 3."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import katz, katz_tables
from tests.llm.test_edges import odd  # noqa: F401

TRAIN = "crc32(cast(doc_id as string)) % 10 != 0"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 12), p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.03, 0.02])) for _ in range(120)]
    return spark.createDataFrame([*enumerate(texts), (900, None), (901, "A  unheard b"), (901, "A  unheard b")], "doc_id long, text string")


def test_order_two_equals_the_dense_form(corpus, tmp_path):
    katz_tables.fit(corpus.filter(TRAIN), str(tmp_path), 2)
    got = sorted((r.doc_id, r.n_tokens, round(r.score, 9)) for r in katz_tables.score(corpus, str(tmp_path)).collect())
    assert got == sorted((r.doc_id, r.n_tokens, round(r.score, 9)) for r in katz.katz_scores(corpus).collect())


def brute(texts, order):
    """P(word | context of any length below order), by plain counting."""
    padded = [[katz_tables.END] * (order - 1) + t for t in texts]
    c = {n: Counter(tuple(t[i - n + 1 : i + 1]) for t in padded for i in range(order - 1, len(t))) for n in range(1, order + 1)}
    nr = {n: [sum(x == r for x in c[n].values()) for r in range(1, katz.K + 2)] for n in c}
    uni = katz.Unigrams([sum(c[1].values()), len(c[1]), *nr[1]])
    d = {n: katz.discounts(nr[n]) for n in c}

    def p(ctx, w):
        n = len(ctx) + 1
        if n == 1:
            return float(uni.p(np.array([c[1][(w,)]]))[0])
        seen = {g[-1]: k for g, k in c[n].items() if g[:-1] == ctx}
        if not seen:
            return p(ctx[1:], w)
        used = sum(d[n][min(k, katz.K + 1)] * k for k in seen.values())
        alpha = katz.alphas(np.array([sum(seen.values())]), np.array([used]), np.array([sum(p(ctx[1:], x) for x in seen)]))[0]
        if w in seen:
            return d[n][min(seen[w], katz.K + 1)] * seen[w] / (sum(seen.values()) + (alpha < 0))
        return abs(alpha) * p(ctx[1:], w)

    return p, [w for (w,) in c[1]]


def test_order_three_backs_off_twice(corpus, tmp_path):
    rows = [(r.doc_id, (r.text or "").lower().encode().split() + [katz_tables.END]) for r in corpus.collect()]
    p, words = brute([t for i, t in rows if zlib.crc32(str(i).encode()) % 10], 3)
    for ctx in [(b"a", b"b"), (b"h", b"h"), (katz_tables.END, katz_tables.END), (b"g", b"c"), (b"none", b"such")]:
        assert sum(p(ctx, w) for w in words) + p(ctx, b"unheard of") == pytest.approx(1)
    want = sorted((i, sum(np.log10(p(tuple(g[:2]), g[2])) for g in zip([katz_tables.END] * 2 + t, [katz_tables.END] + t, t))) for i, t in rows)
    for hot_rows in (katz_tables.HOT_ROWS, 3):
        katz_tables.fit(corpus.filter(TRAIN), str(tmp_path), 3, hot_rows=hot_rows)
        got = sorted((r.doc_id, r.score) for r in katz_tables.score(corpus, str(tmp_path), hot_rows=hot_rows).collect())
        assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])


def test_a_model_scores_new_texts_and_odd_tables(spark, corpus, odd, tmp_path):  # noqa: F811
    katz_tables.fit(odd, str(tmp_path), 3)
    rows = katz_tables.score(odd.withColumn("ctx", F.lit(1)), str(tmp_path)).collect()
    assert len(rows) == 9 and all(r.score < 0 for r in rows) and sum(r.doc_id is None for r in rows) == 3
    assert katz_tables.score(corpus, str(tmp_path)).count() == 123 and katz_tables.score(corpus.filter("false"), str(tmp_path)).count() == 0
    long = spark.createDataFrame([(1, "a " * 450_000 + "x" * 50_000)], "doc_id long, text string")
    assert katz_tables.score(long, str(tmp_path)).first().n_tokens == 450_002
    katz_tables.fit(corpus.filter("false"), str(tmp_path / "none"), 2)
    assert {r.score for r in katz_tables.score(corpus, str(tmp_path / "none")).collect()} == {0.0}
