"""Bigram language model with Katz backoff, fitted and applied without a row per token.

    P(w2 | w1) = d(c12) c12 / c1            if the bigram was seen in training
               = alpha(w1) P(w2)            if not (P(w2) where w1 was never seen)
    P(w)       = d(c) c / N                 if seen; what is left is the unknown token's

The discounts d are Good-Turing's with Katz's cut at K, from counts of counts over all training
data. alpha(w1) is exact: what the discounts leave in context w1, over the unigram mass of the
words not seen there. So each context's probabilities over vocabulary and unknown token sum to 1.
A document's tokens are its words and one end token, which also is the context of its first word.

Documents are gathered in batches of about BATCH tokens, written once to the shared folder. A
batch asks for the counts of its distinct words, then of its distinct bigrams: requests are dealt
to buckets by hash, each bucket merges the batches' counts, and answers go back in the order of
the requests. Requests are distinct within a batch, so frequent words are no hot keys; a context
with very many tokens is cut over several buckets, and its sums are added. Bigram counts and
backoff weights are tables partitioned by bucket. Sizes: a bucket gets about BUCKET requests.

Words are known by 56-bit hashes: of a billion distinct ones about 14 are taken for another. Within
their bucket contexts and bigrams go by 48 bits. Neither is confirmed by texts. A bucket holds about BUCKET bigrams at any size of the corpus, so two
of them are taken for one with probability BUCKET^2 / 2^49 < 0.001 a bucket: of a billion bigrams
about one is merged with another.

Edge cases: a null, empty or blank text is one end token. A null id counts as the empty string
for the split, which makes it held out. Repeated rows are counted and scored each. Without
training tokens every score is that of the unknown token alone (log10 1 = 0). Where counts of
counts give a discount outside (0, 1) the cut is lowered; where they allow none, (r - 1/2) / r is
taken for r up to K. Where the discounts leave nothing, the total is raised by one to leave mass. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.minhash import mix, word_hashes
from spanloom.llm.shared import drop_table, read, trimmed, tune, write_table

BATCH, BUCKET, HOT_TOKENS, HOT_SHARE = 1_600_000, 600_000, 2_000_000, 100_000
#: Bytes by which words, and within their bucket contexts and bigrams, are known.
WORD_BYTES, PAIR_BYTES = 7, 6
K = 5
END = b"\n"
ROW = "batch long, bucket int, kind int, ids array<long>, a binary, b binary, c binary, d binary, e binary, f binary"
COLS = ("batch", "bucket", "kind", "ids", "a", "b", "c", "d", "e", "f")
SCHEMA = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in "abcdef")])
#: Kinds of rows: a batch, word answers, bigram answers; per bucket the model, a request, sums.
DOCS, WORD_ANSWER, PAIR_ANSWER, MODEL, REQUEST, STATS, HOT = range(7)


@lru_cache(maxsize=1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=9), zstandard.ZstdDecompressor()


def planes(x) -> bytes:
    """Integers as compressed planes of bytes: high bytes are mostly zero."""
    import numpy as np

    return _zstd()[0].compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def unplanes(b: bytes, kind):
    import numpy as np

    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_zstd()[1].decompress(b), np.uint8).reshape(size, -1).T).view(kind).ravel()


def low(x, size: int) -> bytes:
    """The low bytes of each integer."""
    import numpy as np

    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def wide(b: bytes, size: int):
    import numpy as np

    out = np.zeros((len(b) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(b, np.uint8).reshape(-1, size)
    return out.view(np.uint64).ravel()


def row(batch: int, bucket: int, kind: int, ids=None, **blobs) -> dict:
    return {"batch": batch, "bucket": bucket, "kind": kind, "ids": ids, **{c: blobs.get(c) for c in "abcdef"}}


def emit(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows with equal keys, which come one after the other."""
    group: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if group and group[0][key] != r[key]:
                yield group
                group = []
            group.append(r)
    if group:
        yield group


def staged(df: DataFrame, key: str, work: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """``work`` on each group of ``key``, rows ordered by kind, bucket and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, key):
            if out := work(group):
                yield emit(out)

    rest = [c for c in ("kind", "bucket", "batch") if c != key]
    dealt = df.select(*COLS).repartition(key).sortWithinPartitions(key, *rest)
    return dealt.mapInArrow(trimmed(run), ROW)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def gather(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Batches of documents: lengths (a), training flags (b), places of the tokens among the
    batch's distinct words, frequent ones first (c), those words' hashes (d), their training counts (e)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        known, mask = word_hashes(), np.uint64((1 << 8 * WORD_BYTES) - 1)
        base, nth = TaskContext.get().partitionId() << 24, 0
        ids: list = []
        arrays: list = []
        n = 0

        def close() -> pa.RecordBatch:
            lens = np.array([len(x) for x in arrays], np.uint32)
            train = np.array([not held_out(i) for i in ids], np.uint8)
            words, at = np.unique(np.concatenate(arrays), return_inverse=True)
            order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")  # small numbers for frequent words
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            words, at = words[order], rank[at]
            counts = np.bincount(at, weights=np.repeat(train, lens), minlength=len(words)).astype(np.uint32)
            tokens = planes(at)
            return emit([row(base + nth, 0, DOCS, ids, a=lens.tobytes(), b=train.tobytes(), c=tokens, d=low(words, WORD_BYTES), e=planes(counts))])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ws = (text or b"").lower().split()
                ws.append(END)
                ids.append(i)
                arrays.append(np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws)) & mask)
                n += len(ws)
                if n >= size:
                    yield close()
                    ids, arrays, n, nth = [], [], 0, nth + 1
        if ids:
            yield close()

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), ROW)


def ask_words(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for r in b.to_pylist():
                words, counts = wide(r["d"], WORD_BYTES), unplanes(r["e"], np.uint32)
                where = (words % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[order], np.arange(buckets + 1))
                out = [row(r["batch"], k, REQUEST, a=low(words[p], WORD_BYTES), b=planes(counts[p])) for k in range(buckets) if len(p := order[cuts[k] : cuts[k + 1]])]
                yield emit(out)

    return docs.mapInArrow(trimmed(run), ROW)


def counts_of_counts(c):
    import numpy as np

    return np.bincount(np.minimum(c, K + 2).astype(np.int64), minlength=K + 3)[1 : K + 2]


def answer_words(group: list[dict]) -> list[dict]:
    """A bucket: total counts for every request, in its order; and the bucket's statistics."""
    import numpy as np

    words = np.concatenate([wide(r["a"], WORD_BYTES) for r in group])
    counts = np.concatenate([unplanes(r["b"], np.uint32) for r in group])
    _, at = np.unique(words, return_inverse=True)
    total = np.bincount(at, weights=counts).astype(np.uint64)
    answers, lo = total[at], 0
    k = group[0]["bucket"]
    out = [row(-1, k, STATS, a=np.array([total.sum(), (total > 0).sum(), *counts_of_counts(total)], np.int64).tobytes())]
    for r in group:
        n = len(r["a"]) // WORD_BYTES
        out.append(row(r["batch"], k, WORD_ANSWER, a=planes(answers[lo : lo + n])))
        lo += n
    return out


def statistics(df: DataFrame) -> list[int]:
    """Sums of the buckets' statistics; the rows are as many as buckets, summed on the executors."""
    n = K + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = np.zeros(n, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        yield pa.record_batch([pa.array([v]) for v in total.tolist()], names=[f"s{i}" for i in range(n)])

    sums = df.filter(F.col("kind") == STATS).select("a").mapInArrow(trimmed(run), ", ".join(f"s{i} long" for i in range(n)))
    return [v or 0 for v in sums.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]).first()]


def discounts(nr: list[int]):
    """d(0..K+1): Good-Turing for counts up to a cut, the largest one up to K at which all
    discounts lie in (0, 1); (r - 1/2) / r where the counts allow none."""
    import numpy as np

    d = np.ones(K + 2)
    for k in range(K, 0, -1):
        if not all(nr[: k + 1]):
            continue
        cut = (k + 1) * nr[k] / nr[0]
        got = [((r + 1) * nr[r] / nr[r - 1] / r - cut) / (1 - cut) if cut != 1 else 0.0 for r in range(1, k + 1)]
        if all(0 < x < 1 for x in got):
            d[1 : k + 1] = got
            return d
    d[1 : K + 1] = [(r - 0.5) / r for r in range(1, K + 1)]
    return d


class Unigrams:
    """P(w) of a count, from N, V and the counts of counts."""

    def __init__(self, stats: list[int]):
        self.n, self.v, nr = stats[0], stats[1], stats[2:]
        self.d = discounts(nr)
        left = sum((1 - self.d[r]) * r * nr[r - 1] for r in range(1, K + 1))
        self.total = self.n if left > 0 else self.n + 1
        self.unknown = (left if left > 0 else 1) / self.total if self.total else 1.0

    def p(self, c):
        import numpy as np

        c = c.astype(np.float64)
        seen = self.d[np.minimum(c, K + 1).astype(int)] * c / max(self.total, 1)
        return np.where(c > 0, seen, self.unknown)


class Batch:
    """One batch's distinct bigrams and the parts of its requests, in a fixed order."""

    def __init__(self, group: list[dict], word_buckets: int, buckets: int, hot: int, split: int):
        import numpy as np

        docs, self.hot = group[0], hot
        self.ids, self.batch = docs["ids"], docs["batch"]
        self.lens = np.frombuffer(docs["a"], np.uint32).astype(np.int64)
        self.train = np.frombuffer(docs["b"], np.uint8)
        self.tokens = unplanes(docs["c"], np.uint32)
        words = wide(docs["d"], WORD_BYTES)
        where = (words % np.uint64(word_buckets)).astype(np.int64)
        counts = [unplanes(r["a"], np.uint64) for r in group if r["kind"] == WORD_ANSWER]
        self.count = np.empty(len(words), np.int64)
        self.count[np.argsort(where, kind="stable")] = np.concatenate(counts)
        starts = np.cumsum(self.lens) - self.lens
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[starts] = self.tokens[starts + self.lens - 1]  # every document ends in the end token
        self.before = before
        n = len(words)
        pairs, at = np.unique(before.astype(np.int64) * n + self.tokens, return_inverse=True)
        self.at = at.astype(np.int32)
        self.w1, self.w2 = (pairs // n).astype(np.int32), (pairs % n).astype(np.int32)
        del pairs, at
        h1, h2 = words[self.w1], words[self.w2]
        u = np.uint64
        with np.errstate(over="ignore"):
            splits = np.where(self.count[self.w1] > hot, -(-self.count[self.w1] // split), 1).astype(u)
            home = (mix(h1 + (mix(h2 + u(9)) % splits) * u(0x9E3779B97F4A7C15)) % u(buckets)).astype(np.int32)
            del splits
            o = self.order = np.argsort(home, kind="stable").astype(np.int32)  # by bucket, then context
            self.key = (mix(h1 * u(0x9E3779B97F4A7C15) + mix(h2)) >> u(16))[o]
            del h2
        home, self.h1, w1 = home[o], mix(h1)[o], self.w1[o]
        self.cuts = np.searchsorted(home, np.arange(buckets + 1))
        self.new = np.ones(len(o), bool)
        self.new[1:] = (home[1:] != home[:-1]) | (w1[1:] != w1[:-1])

    def requests(self) -> list[dict]:
        import numpy as np

        o = self.order
        seen = np.bincount(self.at, weights=np.repeat(self.train, self.lens), minlength=len(o)).astype(np.uint32)[o]
        big, c2 = (self.count[self.w1] > self.hot)[o], self.count[self.w2][o]
        out = []
        for k in range(len(self.cuts) - 1):
            s = slice(self.cuts[k], self.cuts[k + 1])
            if s.start == s.stop:
                continue
            starts = np.flatnonzero(self.new[s])
            runs = np.diff(np.append(starts, s.stop - s.start))
            out.append(row(self.batch, k, REQUEST, a=low(self.h1[s][starts], PAIR_BYTES), b=planes(runs.astype(np.uint32)), c=planes(big[s][starts].astype(np.uint8)), d=low(self.key[s], PAIR_BYTES), e=planes(seen[s]), f=planes(c2[s].astype(np.uint64))))
        return out


def count_pairs(group: list[dict]) -> list[dict]:
    """A bucket: merges the batches' bigram counts to a model row, which also keeps, for every
    request in its order, the counts and the places of its contexts. A context's own count is the
    sum of its bigrams', as every token has one before it."""
    import numpy as np

    k = group[0]["bucket"]
    h1 = [wide(r["a"], PAIR_BYTES) for r in group]
    runs = [unplanes(r["b"], np.uint32) for r in group]
    contexts, place = np.unique(np.concatenate(h1), return_inverse=True)
    _, first, at = np.unique(np.concatenate([wide(r["d"], PAIR_BYTES) for r in group]), return_index=True, return_inverse=True)
    at = at.astype(np.int32)
    total = np.bincount(at, weights=np.concatenate([unplanes(r["e"], np.uint32) for r in group])).astype(np.uint32)
    big = np.zeros(len(contexts), np.uint8)
    big[place] = np.concatenate([unplanes(r["c"], np.uint8) for r in group])
    owner = np.repeat(place.astype(np.uint32), np.concatenate(runs))[first]
    c2 = np.concatenate([unplanes(r["f"], np.uint64) for r in group])[first]
    seen = np.flatnonzero(total)
    seen = seen[np.argsort(owner[seen], kind="stable")]  # by context, so that only their numbers are kept
    size = np.bincount(owner[seen], minlength=len(contexts)).astype(np.uint32)
    asked, lo, hi = [], 0, 0
    for r, h, n in zip(group, h1, runs, strict=True):
        m = int(n.sum())
        asked.append((planes(total[at[lo : lo + m]]), planes(place[hi : hi + len(h)].astype(np.uint32)), r["b"]))
        lo, hi = lo + m, hi + len(h)
    return [
        row(-1, k, STATS, a=np.array([int(total.sum()), len(seen), *counts_of_counts(total)], np.int64).tobytes()),
        row(-1, k, MODEL, [r["batch"] for r in group], a=low(contexts, PAIR_BYTES), b=planes(big), c=planes(size), d=planes(total[seen]), e=planes(c2[seen]), f=pickle.dumps(asked)),
    ]


def alphas(c1, used, mass):
    """Backoff weights from a context's count, its discounted counts and the unigram mass of the
    words seen in it. Negative where the total had to be raised by one to leave mass."""
    import numpy as np

    c1 = c1.astype(np.float64)
    left = c1 - used
    raised = left < 1e-9 * np.maximum(c1, 1)
    total = c1 + raised
    alpha = np.where(raised, 1.0, left) / np.maximum(total, 1) / np.maximum(1 - mass, 1e-12)
    return np.where(raised, -alpha, alpha)


def weigh(model: DataFrame, discount, uni: Unigrams) -> DataFrame:
    """Answers to the batches: each bucket's backoff weights beside its counts, where the bucket
    lies. Hot contexts are spread over buckets and only their sums leave."""

    def work(m: dict) -> Iterator[dict]:
        import numpy as np

        h1, big = wide(m["a"], PAIR_BYTES), unplanes(m["b"], np.uint8) > 0
        owner, total = np.repeat(np.arange(len(h1)), unplanes(m["c"], np.uint32)), unplanes(m["d"], np.uint32)
        c1 = np.bincount(owner, weights=total, minlength=len(h1))
        used = np.bincount(owner, weights=discount[np.minimum(total, K + 1)] * total, minlength=len(h1))
        mass = np.bincount(owner, weights=uni.p(unplanes(m["e"], np.uint64)), minlength=len(h1))
        del owner, total
        alpha = alphas(c1, used, mass)
        alpha[big] = np.nan
        if big.any():
            yield row(-1, m["bucket"], HOT, a=h1[big].tobytes(), b=used[big].tobytes(), c=mass[big].tobytes(), d=c1[big].tobytes())
        for batch, (counts, places, runs) in zip(m["ids"], pickle.loads(m["f"]), strict=True):
            yield row(batch, m["bucket"], PAIR_ANSWER, a=counts, b=alpha[unplanes(places, np.uint32)].tobytes(), c=runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                yield emit(list(work(b.slice(i, 1).to_pylist()[0])))

    return model.filter(F.col("kind") == MODEL).select(*COLS).mapInArrow(trimmed(run), ROW)


def hot_alphas(df: DataFrame) -> dict[int, float]:
    """Backoff weights of the hot contexts: at most HOT_SHARE, as each has that share of all tokens."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                parts = [np.frombuffer(r["a"], np.int64), *(np.frombuffer(r[c], np.float64) for c in "bcd")]
                yield pa.record_batch([pa.array(p) for p in parts], names=["h", "used", "mass", "c1"])

    rows = df.filter(F.col("kind") == HOT).select("a", "b", "c", "d").mapInArrow(trimmed(run), "h long, used double, mass double, c1 double")
    got = rows.groupBy("h").agg(F.sum("used"), F.sum("mass"), F.sum("c1")).collect()
    if not got:
        return {}
    h, used, mass, c1 = (np.array(x) for x in zip(*got, strict=True))
    return dict(zip(h.tolist(), alphas(c1, used, mass).tolist(), strict=True))


OUT = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_docs(df: DataFrame, word_buckets: int, buckets: int, hot: int, split: int, uni: Unigrams, discount, hot_alpha: dict[int, float]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((uni, discount, hot_alpha))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        uni, discount, hot_alpha = shared.value
        for group in grouped(batches, "batch"):
            b = Batch(group, word_buckets, buckets, hot, split)
            answers = [r for r in group if r["kind"] == PAIR_ANSWER]
            group.clear()
            logs, lo = np.empty(len(b.order)), 0
            for r in answers:  # a bucket's part of the batch's bigrams at a time
                c12 = unplanes(r["a"], np.uint32)
                o = b.order[lo : lo + len(c12)]
                alpha = np.repeat(np.frombuffer(r["b"]), unplanes(r["c"], np.uint32))
                for i in np.flatnonzero(np.isnan(alpha)):
                    alpha[i] = hot_alpha[int(b.h1[lo + i] & np.uint64((1 << 48) - 1))]
                c1, p2 = b.count[b.w1[o]], uni.p(b.count[b.w2[o]])
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = np.where(c12 > 0, discount[np.minimum(c12, K + 1)] * c12 / (c1 + (alpha < 0)), np.where(c1 > 0, np.abs(alpha) * p2, p2))
                logs[o] = np.log10(p)
                lo += len(c12)
            starts = np.cumsum(b.lens) - b.lens
            score = np.add.reduceat(logs[b.at], starts)
            count = b.count[b.tokens]
            base = np.log10((b.count + 0.1) / (uni.n + 0.1 * (uni.v + 1)))
            yield pa.record_batch(
                [
                    pa.array(b.ids, pa.int64()), pa.array(b.train == 0), pa.array(b.lens), pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)),
                    pa.array([uni.n] * len(b.ids), pa.int64()), pa.array(np.add.reduceat(base[b.tokens], starts)), pa.array(score),
                ],
                names=[c.split()[0] for c in OUT.split(", ")],
            )

    dealt = df.select(*COLS).repartition("batch").sortWithinPartitions("batch", "kind", "bucket")
    return dealt.mapInArrow(trimmed(run), OUT)


def katz_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH, bucket: int = BUCKET, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """One row per row of ``df``: (id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    docs = write_table(gather(df, id_col, text_col, batch), "katz-batches")
    sizes = docs.select(F.sum(F.length("d") / WORD_BYTES).cast("long"), F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda s, _: s + 1))).first()
    if not sizes[1]:
        return df.sparkSession.createDataFrame([], OUT).withColumnRenamed("id", id_col)
    word_buckets = -(-sizes[0] // bucket)
    words = write_table(staged(ask_words(docs, word_buckets), "bucket", answer_words), "katz-words")
    stats = statistics(words)
    uni = Unigrams(stats)
    hot = max(hot_tokens, stats[0] // HOT_SHARE)
    # Distinct bigrams of a batch are about two thirds of its tokens; held-out ones add a tenth.
    buckets = max(1, round(0.75 * max(stats[0], 1) / bucket))
    answers = words.filter(F.col("kind") == WORD_ANSWER)
    asked = staged(docs.unionByName(answers), "batch", lambda g: Batch(g, word_buckets, buckets, hot, hot_tokens).requests())
    model = write_table(staged(asked, "bucket", count_pairs), "katz-pairs")
    discount = discounts(statistics(model)[2:])
    found = write_table(weigh(model, discount, uni), "katz-answers")
    hot_alpha = hot_alphas(found)
    drop_table(model)
    whole = docs.unionByName(answers).unionByName(found.filter(F.col("kind") == PAIR_ANSWER))
    return score_docs(whole, word_buckets, buckets, hot, hot_tokens, uni, discount, hot_alpha).withColumnRenamed("id", id_col)


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return katz_scores(read(spark, sf_dir, "documents"))
