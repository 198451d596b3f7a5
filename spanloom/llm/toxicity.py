"""Toxicity by a classifier chain.

The categories are predicted in a fixed order; each linear model gets, beside the words of the
text, the probabilities that the models before it give. In training those probabilities are
out-of-fold: each row's come from models fitted without that row, so later models learn from
inputs as uncertain as the ones they meet at prediction.

The chain is fitted on a bounded sample of the labelled rows (``MAX_LABELLED``, those with the
smallest hash of the id). Each text is turned on the executors into its set of hashed words, word beginnings and symbol runs; of
these the ``FEATURES`` buckets that differ most between the classes are kept. The chain is fitted
in one task from at most ``MAX_LABELLED`` sets of integers; the driver sees the models alone. They
are a few thousand numbers, so they go to every worker.

Edge cases: a null or empty text has no words and gets the models' intercepts. Labels that are
null or without a document are ignored; ids labelled more than once count as the maximum of their
labels, and of documents that repeat a labelled id one, the least text, is learned from. With fewer than ``MIN_CLASS`` rows of a class a category's model is constant at the rate
observed (0 if there are no labels). Repeated rows are scored each; other columns are ignored by
``score`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.shared import Recent, map_rows, quoted, read, remembered, trimmed, tune

MAX_LABELLED = 8_000
BUCKETS = 1 << 20
MASK = BUCKETS - 1
FEATURES = 1024
FOLDS = 5
MIN_CLASS = 4
THRESHOLD = 0.5
#: The categories in the chain's order: name and expression over the labels table.
CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"))
L2 = 0.05
WORD = re.compile(r"[^\W\d_]+|[^\w\s]{2,}")
#: Beside a whole word, its beginnings of these lengths are features: inflected forms share them.
BEGINNINGS = (4, 5, 6)


def _buckets(token: str) -> list[int]:
    out = []
    for word in (token,) if token.isalpha() else WORD.findall(token):
        low = word.lower()
        out.append(crc32(low.encode()) & MASK)
        if low[0].isalpha():
            out += [crc32(low[:n].encode()) & MASK ^ 1 for n in BEGINNINGS if n <= len(low)]
            if len(word) > 2 and word.isupper():
                out.append(0)
    return out


def words(text: str | None) -> set[int]:
    """Hashed buckets of the distinct words, their beginnings and runs of symbols."""
    known = remembered("toxicity training", lambda: Recent(50_000))
    known.turn()
    tokens = set((text or "").split())
    for w in known.missing(tokens):
        known.young[w] = _buckets(w)
    return {i for w in tokens for i in known.young[w]}


def _top(x):
    """Bound on the largest eigenvalue of x'x by power iteration, with a margin."""
    import numpy as np

    v = np.ones(x.shape[1], np.float32) / np.float32(np.sqrt(x.shape[1]))
    for _ in range(20):
        v = (x @ v) @ x
        size = np.linalg.norm(v)
        if not size:
            return 1.0
        v = (v / size).astype(np.float32)
    return 1.05 * size


def _fit_logistic(x, y, l2: float = L2, steps: int = 250):
    """Weights and intercept by accelerated gradient descent on the regularised log loss."""
    import numpy as np

    n, d = x.shape
    rate = y.mean() if n else 0.0
    if min(y.sum(), n - y.sum()) < MIN_CLASS:
        p = float(np.clip(rate, 1e-6, 1 - 1e-6)) if n else 1e-6
        return np.zeros(d), float(np.log(p / (1 - p)))
    f32 = np.float32
    w, b, y = np.zeros(d, f32), float(np.log(rate / (1 - rate))), y.astype(f32)
    v, vb, mom = w.copy(), b, 1.0
    step = 1.0 / (0.25 * _top(x) + 0.25 * n + l2) if d else 1.0 / (0.25 * n)
    for _ in range(steps):
        g = (1 / (1 + np.exp(-np.clip(x @ v + f32(vb), -30, 30))) - y).astype(f32)
        nw, nb = (v - step * (g @ x + l2 * v)).astype(f32), vb - step * float(g.sum())
        nm = (1 + np.sqrt(1 + 4 * mom**2)) / 2
        v, vb = (nw + (mom - 1) / nm * (nw - w)).astype(f32), nb + (mom - 1) / nm * (nb - b)
        moved = float(np.abs(nw - w).max(initial=0.0))
        w, b, mom = nw, nb, nm
        if moved < 1e-4:
            break
    return w, b


class Chain:
    """Fitted models: for each category its buckets, weights (then one per earlier category)."""

    def __init__(self, names: list[str]):
        self.names, self.models, self.key = names, [], uuid.uuid4().hex

    @staticmethod
    def choose(rows, indptr, y, features: int):
        """The buckets whose document frequency differs most between the classes."""
        import numpy as np

        if not len(rows):
            return np.empty(0, np.int64)
        toxic = np.repeat(y == 1, np.diff(indptr))
        pos, tot = counted(rows[toxic]), counted(rows)
        n, n1 = len(y), max((y == 1).sum(), 1e-9)
        expect = tot * n1 / max(n, 1)
        chi = np.where(tot >= 3, (pos - expect) ** 2 / np.maximum(expect, 0.5), 0)
        top = np.argsort(-chi, kind="stable")[:features]
        return np.sort(top[chi[top] > 0])

    @staticmethod
    def dense(rows, indptr, chosen, before):
        """Presence of the chosen buckets, then the columns of ``before``, as 4-byte floats."""
        import numpy as np

        x = np.zeros((len(indptr) - 1, len(chosen) + before.shape[1]), np.float32)
        x[:, len(chosen) :] = before
        if len(chosen) and len(rows):
            place = np.full(BUCKETS, -1, np.int16)
            place[chosen] = np.arange(len(chosen))
            at = place[rows]
            hit = np.flatnonzero(at >= 0)
            x[np.searchsorted(indptr, hit, side="right") - 1, at[hit]] = 1
        return x

    def _one(self, rows, indptr, y, before, features):
        chosen = self.choose(rows, indptr, y, features)
        return chosen, *_fit_logistic(self.dense(rows, indptr, chosen, before), y)

    def fit(self, docs: list, labels, folds: int = FOLDS, features: int = FEATURES) -> Chain:
        import numpy as np

        n = len(docs)
        fold = np.arange(n) % folds
        labels = np.zeros((0, len(self.names))) if labels is None else labels
        before = np.zeros((n, 0))
        rows, indptr = flat(docs)
        for c in range(len(self.names)):
            y = labels[:, c].astype(float)
            self.models.append(self._one(rows, indptr, y, before, features))
            if c + 1 < len(self.names):
                out = np.zeros(n)
                for f in range(folds):
                    keep, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                    if not len(rest):
                        continue
                    a, ap = flat([docs[i] for i in keep])
                    r, rp = flat([docs[i] for i in rest])
                    model = self._one(a, ap, y[keep], before[keep], features) if len(keep) else (np.empty(0, np.int64), np.zeros(before.shape[1]), -13.8)
                    out[rest] = self.apply(model, r, rp, before[rest])
                before = np.hstack([before, out[:, None]])
        return self

    def apply(self, model, rows, indptr, before):
        import numpy as np

        chosen, w, b = model
        z = self.dense(rows, indptr, chosen, before) @ w + b
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def features(self, text: str | None) -> set[int]:
        """Places, among all buckets that any model uses, of those the text has."""
        import numpy as np

        if not hasattr(self, "used"):
            self.used = np.unique(np.concatenate([m[0] for m in self.models]))
            self.place = {int(b): i for i, b in enumerate(self.used)}
        known, place = remembered(f"toxicity {self.key}", lambda: Recent(150_000)), self.place.get
        known.turn()
        tokens = set((text or "").split())
        for w in known.missing(tokens):
            known.young[w] = tuple(i for i in map(place, _buckets(w)) if i is not None)
        return {i for w in tokens for i in known.young[w]}

    def __getstate__(self):
        return {"names": self.names, "models": self.models, "key": self.key}

    def predict(self, texts: list):
        """Probabilities, one column per category, in the chain's order."""
        import numpy as np

        found = [self.features(t) for t in texts]
        at = np.fromiter((i for f in found for i in f), np.int64)
        owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
        before = np.zeros((len(found), 0))
        for chosen, w, b in self.models:
            weight = np.zeros(len(self.used) if found else 0)
            if found:
                weight[np.searchsorted(self.used, chosen)] = w[: len(chosen)]
            z = np.bincount(owner, weights=weight[at], minlength=len(found)) + before @ w[len(chosen) :] + b
            before = np.hstack([before, (1 / (1 + np.exp(-np.clip(z, -30, 30))))[:, None]])
        return before


def counted(rows):
    """How often each bucket occurs, counted a part at a time: the count works on 8-byte copies."""
    import numpy as np

    out = np.zeros(BUCKETS, np.int32)
    for i in range(0, len(rows), 1 << 20):
        out += np.bincount(rows[i : i + (1 << 20)], minlength=BUCKETS).astype(np.int32)
    return out


def flat(docs: list):
    import numpy as np

    indptr = np.zeros(len(docs) + 1, np.int64)
    indptr[1:] = np.cumsum([len(d) for d in docs])
    return (np.concatenate([np.asarray(d, np.int32) for d in docs]) if docs else np.empty(0, np.int32)), indptr


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Chain:
    """Fit the chain on at most ``max_labelled`` labelled ids of ``docs``, in one task of an executor."""
    ys = [f"y{i}" for i in range(len(chain))]
    marks = labels.select(F.col(quoted(id_col)).alias("label_id"), *[F.expr(f"double({e})").alias(y) for y, (_, e) in zip(ys, chain, strict=True)]).dropna()
    marks = marks.groupBy("label_id").agg(*[F.max(y).alias(y) for y in ys])
    # The choice is made among ids alone; at most max_labelled rows, so they may be broadcast.
    chosen = marks.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [sorted(words(t)) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(sets, pa.list_(pa.int32())), *b.columns[2:]], names=["id", "found", *ys])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        got = pa.Table.from_batches(list(batches)).sort_by("id")
        sets = got["found"].combine_chunks()
        values, off = sets.values.to_numpy(zero_copy_only=False), sets.offsets.to_numpy()
        listed = [values[off[i] : off[i + 1]] for i in range(len(sets))]  # views, no copies
        y = np.column_stack([got[c].to_numpy() for c in ys])
        yield pa.record_batch([pa.array([pickle.dumps(Chain([n for n, _ in chain]).fit(listed, y))], pa.binary())], names=["chain"])

    def fit_if_any(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if some:
            yield from fit(iter(some))

    # One text per id: of rows that repeat it, the least text.
    kind = docs.schema[id_col].dataType.simpleString()
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), *[F.first(y).alias(y) for y in ys])
    sets = rows.mapInArrow(trimmed(found), f"id {kind}, found array<int>, " + ", ".join(f"{y} double" for y in ys))
    got = sets.repartition(1).mapInArrow(trimmed(fit_if_any), "chain binary").collect()  # a row of some 20 KB
    return pickle.loads(got[0].chain) if got else Chain([n for n, _ in chain]).fit([], None)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, p_<category>..., toxic): probabilities per row; toxic: the last category's reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{n}" for n in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            p = c.predict(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), *[pa.array(p[:, i]) for i in range(p.shape[1])], pa.array(p[:, -1] >= threshold)], names=["id", *names, "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(trimmed(run), f"id {kind}, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows found toxic; same columns. Each row is judged where it lies."""
    chain = train(docs, labels, id_col=id_col, text_col=text_col, **how)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.predict(b.column(at).to_pylist())
            yield b.filter(pa.array(p[:, -1] < THRESHOLD))

    return map_rows(docs, run)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels"))).withColumn("kept", ~F.col("toxic"))
