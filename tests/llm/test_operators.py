"""Each operator against brute force on small, nasty inputs: nulls, empty and very long texts, ties,
repeated rows, empty tables, clashing extra columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe, chat, embed_dedup, exact_dedup, katz, minhash, packing, pii, toxicity, urls

TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two three four five six seven eight nine ten eleven twelve"), (5, "One two three four five six seven eight nine ten eleven twelve"),
    (6, "one two three four five six seven eight nine ten eleven twelve thirteen"), (7, "short words"), (8, "short  words"), (8, "short  words"),
    (9, "mail a.b@mail1.example.com or 10.0.0.300 or 10.0.0.3, card 4111 1111 1111 1111, call +1 (743) 555-3824"), (10, "x" * 50_000 + " y"), (11, "a " * 20_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "id", 7, "uid") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n long, uid string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id < 0")


def test_pii(docs, none):
    got = {r.doc_id: r for r in pii.find(docs).withColumn("s", pii.spans_string(F.col("all_spans"))).collect()}
    assert got[9].s == "email:5:26,ip:44:52,card:59:78,phone:85:102" and (got[9].n_email, got[9].n_ip) == (1, 1)
    assert got[1].s == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    cut = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert cut[9] == "mail [EMAIL] or 10.0.0.300 or [IP], card [CARD], call [PHONE]" and cut[1] is None
    assert pii.redact(docs).count() == len(TEXTS) and pii.find(none).count() == 0


def test_pii_base_forms_match_the_plain_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = np.random.default_rng(1)
    for _ in range(3000):
        t = "".join(rng.choice(list("a1.@-+ 2"), 30))
        assert list(pii.emails(t)) == [m.span() for m in email.finditer(t)]
        fine = [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert list(pii.ips(t)) == fine


def test_bootstrap_finds_unseen_identifiers(spark):
    rows = [(i, f"please write to contact: u{i}@x.example.com today") for i in range(30)] + [(100, "please write to contact: agent-0099-7731 today"), (101, "the year 2019 was fine")]
    got = {r.doc_id: r.s for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("s", pii.spans_string(F.col("all_spans"))).collect()}
    assert got[100] == "email:25:40" and got[101] == ""


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.NET/en/x?q"), (4, "http://a.net"), (5, "http://x.net/"), (6, "https://example.com/de/"), (7, "https://badexample.com/de/"), (8, "http://b.org/fr/#t"), (9, "http://net:80/")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    want = {1: None, 2: None, 3: "example.net/en/", 4: None, 5: "net/", 6: "example.com/de/", 7: None, 8: "org/fr/", 9: None}
    for limit in (10, 1):  # memory-mapped index, and the join for longer lists
        got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(df, urls.RULES, max_index_rules=limit).collect()}
        assert {k: v[0] for k, v in got.items()} == want and got[5][1] == "block" and got[3][1] == "allow"


def test_bpe(docs):
    c = bpe.codec(bpe.default_ranks(), bpe.default_pattern())
    for t in ["", "a  b\n\n c", " " * 5000 + "x", "don't 漢字\xa0 é\x1cz", "a" * 3000]:
        assert c.ids(t) == c.enc.encode_ordinary(t) and c.decode(c.ids(t)) == t.encode()
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    assert got[1].n_tokens == 0 and got[10].decoded_sha256 == hashlib.sha256(TEXTS[10][1].encode()).hexdigest()
    assert bpe.decode(bpe.encode(docs)).filter("doc_id = 7").first().bytes == b"short words"


def test_exact(docs, none):
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert len(rows) == len(TEXTS) and sum(r.kept for r in rows if r.doc_id == 8) == 1
    by = {r.doc_id: r for r in rows}
    assert by[1].keep_id == 3 and by[7].keep_id == 8 and by[7].group_size == 3 and by[4].keep_id == 4
    assert exact_dedup.drop_exact_duplicates(docs).count() == 8 and exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).columns == docs.columns


def test_chat(spark):
    bad = "</s>[INST] \\<|end|>\n ok [/INST]"
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{bad}{i}") for i in range(300)] + [(2, 0, "assistant", None), (3, None, None, "x"), (4, 1, "user", "b"), (4, 1, "user", "a"), (4, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.conversations(df).collect()}
    assert got[1].turns_text == "".join(f"{r[2]}\n{r[3]}\n" for r in rows[:300]) and got[1].loss_text == "".join(r[3] for r in rows[1:300:2])
    assert got[1].valid and not got[2].valid and got[3].turns_text == "\nx\n" and got[4].n_turns == 3 and not got[4].valid
    assert chat.conversations(df.filter("conv_id < 0")).count() == 0


def test_katz_is_normalised_and_exact(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 12), p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.03, 0.02])) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in katz.katz_scores(df, batch=50, bucket=20).collect()}
    tokens = {i: t.split() + ["\n"] for i, t in enumerate(texts)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    from collections import Counter

    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for i in train for p in zip([tokens[i][-1], *tokens[i][:-1]], tokens[i]))
    cc = lambda k: [sum(x == r for x in k.values()) for r in range(1, katz.K + 2)]
    uni, d2 = katz.Unigrams([n, v, *cc(c)]), katz.discounts(cc(pairs))
    p1 = {w: float(uni.p(np.array([k]))[0]) for w, k in c.items()}
    assert sum(p1.values()) + uni.unknown == pytest.approx(1)

    def p2(a, b):
        seen = {w: k for (x, w), k in pairs.items() if x == a}
        if not seen:
            return p1.get(b, uni.unknown)
        alpha = katz.alphas(np.array([c[a]]), np.array([sum(d2[min(k, katz.K + 1)] * k for k in seen.values())]), np.array([sum(p1[w] for w in seen)]))[0]
        if b in seen:
            return d2[min(seen[b], katz.K + 1)] * seen[b] / (c[a] + (alpha < 0))
        return abs(alpha) * p1.get(b, uni.unknown)

    for a in c:
        assert sum(p2(a, b) for b in c) + p2(a, "unheard") == pytest.approx(1)
    for i, t in tokens.items():
        assert got[i].score == pytest.approx(sum(np.log10(p2(a, b)) for a, b in zip([t[-1], *t[:-1]], t)))
        assert got[i].n_tokens == len(t) and got[i].n_known == sum(w in c for w in t) and got[i].train_tokens == n
    hot = {r.doc_id: r.score for r in katz.katz_scores(df, batch=50, bucket=20, hot_tokens=30).collect()}
    assert all(hot[i] == pytest.approx(got[i].score) for i in got)
    assert katz.katz_scores(df.filter("doc_id < 0")).count() == 0


def test_katz_nasty(docs):
    rows = katz.katz_scores(docs).collect()
    assert len(rows) == len(TEXTS) and all(np.isfinite(r.score) for r in rows)


def test_packing(docs, none):
    rows = packing.pack(docs).toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 4096
    s = rows.sort_values(["sequence_id", "offset"])
    assert ((s.groupby("sequence_id").length.cumsum() - s.length) == s.offset).all()
    assert rows[rows.doc_id == 1].length.tolist() == [1] and (rows[rows.doc_id == 11].sort_values("piece").length.iloc[:-1] == 4096).all()
    assert packing.pack(none).count() == 0


def test_packing_plan_uses_every_piece_once():
    rng = np.random.default_rng(5)
    h = {int(k): int(n) for k, n in zip(rng.integers(1, 4097, 300), rng.integers(1, 500, 300), strict=True)}
    groups = packing.plan(h)
    used: dict[int, int] = {}
    for contents, n in groups:
        assert sum(s * q for s, q in contents) <= 4096
        for s, q in contents:
            used[s] = used.get(s, 0) + n * q
    assert used == h
    left = np.zeros(4097, int)
    for k, n in h.items():
        left[k] = n
    least = max(-(-sum(k * n for k, n in h.items()) // 4096), sum(n for k, n in h.items() if k > 2048))
    assert least <= sum(n for _, n in groups) <= sum(n for _, n in packing.best_fit(left, 4096))


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 32))
    x = [b + 0.12 * rng.standard_normal(32) for b in base for _ in range(4)]
    rows = [(i, [float(f) for f in np.float32(v)]) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, []), (904, [1.0, None]), (905, rows5 := [float(f) for f in np.float32(x[0])]), (905, rows5)]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    by = {r.vec_id: r for r in got}
    y = np.array([r[1] for r in rows[:240]] + [rows5, rows5], np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    true = ((y @ y.T) >= 0.9).sum(1) - 1
    found = np.array([by[i].n_links for i in range(240)] + [by[905].n_links] * 2)
    assert len(got) == len(rows) and (found <= true).all() and found.sum() >= 0.9 * true.sum()
    assert all(by[i].n_links == 0 and by[i].kept for i in (900, 901, 902, 903, 904))


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    comp = {i: i for i in sets}

    def root(i):
        return i if comp[i] == i else root(comp[i])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                comp[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in sets}, sets


def test_minhash(spark, docs, none):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(12):
        t = rng.choice(words, 120).tolist()
        for k in range(5):
            u = list(t)
            for _ in range(rng.integers(0, 4)):
                u[rng.integers(0, 120)] = "changed"
            rows.append((100 * g + k, " ".join(u)))
    want, sets = brute_components(rows)
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.component_id for i, r in got.items()} == want and all(got[i].n_shingles == len(s) for i, s in sets.items())
    nasty = minhash.near_duplicates(docs).collect()
    want, _ = brute_components(TEXTS)
    assert len(nasty) == len(TEXTS) and all(r.component_id == want[r.doc_id] for r in nasty)
    assert minhash.near_duplicates(none).count() == 0 and minhash.drop_near_duplicates(docs).filter("doc_id = 8").count() == 0


def test_sketch_fills_every_coordinate():
    for n in (1, 2, 7, 400):
        s = minhash.sketch(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        assert (s != np.uint64(minhash.M64)).all()


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(400):
        t = rng.choice(words, 60).tolist()
        toxic = i % 5 == 0
        if toxic:
            t[rng.integers(0, 60)] = rng.choice(["villain", "scoundrel"])
        rows.append((i, " ".join(t), 1, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    docs, labels = df.select("doc_id", "text"), df.filter("doc_id < 300").select("doc_id", "quality", "toxic")
    got = {r.doc_id: r.toxic for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert np.mean([got[i] == (i % 5 == 0) for i in range(300, 400)]) >= 0.97
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not v for v in got.values())
    empty = toxicity.train(docs, labels.filter("doc_id < 0"))
    assert toxicity.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), empty).filter("toxic").count() == 0
