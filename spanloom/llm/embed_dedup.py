"""Near-duplicate embeddings by spherical-cap filters.

The filters are caps around the points of a structured random product code: after a random
rotation a vector is cut into ``PARTS`` parts, each part has its own list of random unit vectors,
and a filter is one choice from each list. A vector's inner product with a filter is the sum of
the parts', so all filters above a threshold are list-decoded from the sorted part products
without visiting the rest. Vectors meet where they share a filter, and are verified there with
double-precision cosines. The lists grow with the number of vectors (their product is about
``FILTERS_PER_VECTOR`` times it), the threshold is set so that a random vector passes ``LIST``
filters on average. ``CODES`` such codes are laid independently, and a vector that passes fewer
than ``LEAST`` filters of a code joins its best ones. Simulated on random pairs of cosine exactly
0.9 in 64 dimensions, 99 of 100 pairs share a filter; closer ones are surer.

Equal vectors are collapsed first and count by their number. Where vectors meet, they are first
compared by ``BITS`` signs of random projections, sent along with the filters; only rows with a
partner within ``NEAR`` bits are met again with their vectors (a pair at 0.9 differs in 18 bits on
average, with a deviation of 4). A pair that meets in several filters is counted only in the
smallest one they share, so counts add up without a table of pairs: from a filter come the number
of links per vector and a spanning forest of the links. Filters with many vectors are split into
blocks of ``BLOCK``, met pair by pair in different tasks.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing (n_links 0, their own component); vectors of other lengths only with their like. Each row is
a vertex of its own, so rows that repeat an id are told apart by their vectors. A component's id is
the smallest id in it, null if all are null; a row with a null id counts as kept if it is its
component's first. Empty tables give empty results. Other columns, as labels, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.graph import connected_components
from spanloom.llm.shared import drop_table, quoted, read, sent, trimmed, tune, write_table

THRESHOLD = 0.9
#: Independent codes, parts of each, filters a random vector passes in each code on average, and
#: the least number of (best) filters of each code that any vector joins.
CODES, PARTS, LIST, LEAST, FILTERS_PER_VECTOR = 3, 2, 12, 4, 1.0
BLOCK = 512
BITS, NEAR = 128, 36
SEED = 20240229


@lru_cache(maxsize=64)
def code(dim: int, words: int, nth: int):
    """Rotation, part borders, code books and threshold, the same in every process."""
    import numpy as np

    rng = np.random.default_rng([SEED, dim, words, nth])
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    parts = min(PARTS, dim)
    cuts = np.linspace(0, dim, parts + 1).astype(int)
    books = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        w = rng.standard_normal((words, b - a))
        books.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(parts))
    sample = rng.standard_normal((400, dim))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    keep, values = LIST * 40, []
    for v in sample:  # only large sums can pass: the best of each part are enough
        sums = np.zeros(1)
        for (a, b), w in zip(zip(cuts[:-1], cuts[1:], strict=True), books, strict=True):
            sums = -np.sort(-(sums[:, None] + np.sort(w @ v[a:b])[::-1][None, :keep]).ravel())[:keep]
        values.append(sums)
    values = np.sort(np.concatenate(values))[::-1]
    return rotation, cuts, books, float(values[min(LIST * len(sample), len(values)) - 1])


def decode(v, dim: int, words: int, nth: int):
    """Ids of all filters of the nth code whose inner product with the unit vector v reaches the
    threshold; if they are fewer than LEAST, the LEAST best."""
    import numpy as np

    rotation, cuts, books, least = code(dim, words, nth)
    r = rotation @ v
    products = [w @ r[a:b] for (a, b), w in zip(zip(cuts[:-1], cuts[1:], strict=True), books, strict=True)]
    best_after = np.append(np.cumsum([p.max() for p in products][::-1])[::-1][1:], 0.0)
    sums, ids = np.zeros(1), np.zeros(1, np.int64)
    for p, rest in zip(products, best_after, strict=True):
        s = sums[:, None] + p[None, :]
        a, b = np.nonzero(s + rest >= least)
        sums, ids = s[a, b], ids[a] * words + b
    if len(ids) < LEAST:
        sums, ids = np.zeros(1), np.zeros(1, np.int64)
        for p in products:
            top = np.argsort(-p, kind="stable")[:LEAST]
            s, i = (sums[:, None] + p[top][None, :]).ravel(), (ids[:, None] * words + top[None, :]).ravel()
            best = np.argsort(-s, kind="stable")[:LEAST]
            sums, ids = s[best], i[best]
    return ids + nth * words ** len(products)


@lru_cache(maxsize=16)
def directions(dim: int):
    import numpy as np

    return np.random.default_rng([SEED, dim]).standard_normal((BITS, dim))


def unit(x):
    """Rows of finite numbers, not all zero, at length one, in double precision."""
    import numpy as np

    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _clean(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(uid, id, x): x null where the vector can link with nothing."""
    x = F.col(quoted(vec_col))
    kind = df.schema[vec_col].dataType.elementType.simpleString()  # type: ignore[attr-defined]
    x = x if kind == "float" else x.cast("array<double>")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists(x, lambda v: v != 0)
    return df.select(F.monotonically_increasing_id().alias("uid"), F.col(quoted(id_col)).alias("id"), F.when(F.coalesce(fine, F.lit(False)), x).alias("x"))


def _filters(reps: DataFrame, words: dict[int, int]) -> DataFrame:
    """(rep, weight, dim, x, filters, signs, each): x as given, filters sorted, both as bytes, and as
    an array. words: size of the code books for each length of vectors."""
    double = reps.schema["x"].dataType.elementType.simpleString() == "double"  # type: ignore[attr-defined]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            xs, lists, dims, signs = [], [], [], []
            for v in b.column("x").to_pylist():
                v = np.array(v, np.float64 if double else np.float32)
                u, dim = unit(v[None])[0], len(v)
                dims.append(dim)
                xs.append(v.tobytes())
                lists.append(np.sort(np.concatenate([decode(u, dim, words[dim], k) for k in range(CODES)])))
                signs.append(np.packbits(directions(dim) @ u > 0).tobytes())
            made = [pa.array(dims, pa.int32()), pa.array(xs, pa.binary()), pa.array([f.tobytes() for f in lists], pa.binary()), pa.array(signs, pa.binary()), pa.array([f.tolist() for f in lists], pa.list_(pa.int64()))]
            yield pa.record_batch([b.column(0), b.column(1), *made], names=["rep", "weight", "dim", "x", "filters", "signs", "each"])

    return reps.mapInArrow(trimmed(run), "rep long, weight long, dim int, x binary, filters binary, signs binary, each array<long>")


PLACE = ["dim", "filter", "b1", "b2", "block", "rep"]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows that agree in (dim, filter, b1, b2), which come one after the other."""
    g: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if g and g[0][:4] != row[:4]:
                yield g
                g = []
            g.append(row)
    if g:
        yield g


def _called(listed: DataFrame) -> DataFrame:
    """Of all places where vectors meet, those at which one has a partner that its signs allow."""
    rows = listed.select("dim", F.explode("each").alias("filter"), "rep", "signs")
    load = rows.groupBy("dim", "filter").agg(F.count("*").alias("m")).filter("m > 1").withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int"))
    dealt = rows.join(load.drop("m"), ["dim", "filter"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("dim", "filter", F.least("block", "o").alias("b1"), F.greatest("block", "o").alias("b2"), "block", "rep", "signs")
    dealt = dealt.repartition(*PLACE[:4]).sortWithinPartitions(*PLACE[:4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        i32, i64 = pa.int32(), pa.int64()
        kinds = (i32, i64, i32, i32, i32, i64)
        out: list[tuple] = []
        for g in _grouped(batches):
            if len(g) > 1:
                bits = np.unpackbits(np.frombuffer(b"".join(r[6] for r in g), np.uint8).reshape(len(g), -1), axis=1).astype(np.float32) * 2 - 1
                side = np.array([r[4] for r in g])
                near = bits @ bits.T >= BITS - 2 * NEAR
                np.fill_diagonal(near, False)
                if g[0][2] != g[0][3]:
                    near &= side[:, None] != side[None, :]
                out += [g[i][:6] for i in np.flatnonzero(near.any(1))]
            if len(out) >= 10_000:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=PLACE)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=PLACE)

    return dealt.mapInArrow(trimmed(run), "dim int, filter long, b1 int, b2 int, block int, rep long")


def _meet(listed: DataFrame, called: DataFrame, threshold: float) -> DataFrame:
    """(id, links) and forest edges (id, other) from the called places."""
    dealt = listed.drop("dim").join(sent(called), "rep").select(*PLACE, "weight", "x", "filters").repartition(*PLACE[:4]).sortWithinPartitions(*PLACE[:4])

    def group(g: list[tuple], links: dict, edges: list) -> None:
        import numpy as np

        dim, f, b1, b2 = g[0][:4]
        ids, weight, side = np.array([r[5] for r in g]), np.array([r[6] for r in g]), np.array([r[4] for r in g])
        x = unit(np.frombuffer(b"".join(r[7] for r in g), np.float32 if len(g[0][7]) == 4 * dim else np.float64).reshape(len(g), dim))
        left = np.flatnonzero(side == b1)
        right = left if b1 == b2 else np.flatnonzero(side == b2)
        i, j = np.nonzero(x[left] @ x[right].T >= threshold)
        i, j = left[i], right[j]
        if b1 == b2:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return
        # Of the filters two rows share, the smallest one counts the pair.
        lists = np.frombuffer(b"".join(r[8] for r in g), np.int64)
        owner = np.repeat(np.arange(len(g)), [len(r[8]) // 8 for r in g])
        owner, lists = owner[lists < f], lists[lists < f]
        if len(lists):
            seen, place = np.unique(lists, return_inverse=True)
            has = np.zeros((len(g), len(seen)), np.float32)
            has[owner, place] = 1
            both = has[left] @ has[right].T > 0
            pos_l, pos_r = np.zeros(len(g), int), np.zeros(len(g), int)
            pos_l[left], pos_r[right] = np.arange(len(left)), np.arange(len(right))
            new = ~both[pos_l[i], pos_r[j]]
            i, j = i[new], j[new]
        count = np.bincount(i, weights=weight[j], minlength=len(g)) + np.bincount(j, weights=weight[i], minlength=len(g))
        for k in np.flatnonzero(count):
            links[int(ids[k])] = links.get(int(ids[k]), 0) + int(count[k])
        up = list(range(len(g)))
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            while up[a] != a:
                up[a] = up[up[a]]
                a = up[a]
            while up[b] != b:
                up[b] = up[up[b]]
                b = up[b]
            if a != b:
                up[b] = a
                edges.append((int(ids[a]), int(ids[b])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links: dict, edges: list) -> pa.RecordBatch:
            i64 = pa.int64()
            n, e = len(links), len(edges)
            return pa.record_batch(
                [pa.array([*links, *[x[0] for x in edges]], i64), pa.array([None] * n + [x[1] for x in edges], i64), pa.array([*links.values(), *[0] * e], i64)],
                names=["id", "other", "links"],
            )

        links: dict = {}
        edges: list = []
        for g in _grouped(batches):
            if len(g) > 1:
                group(g, links, edges)
            if len(links) + len(edges) >= 10_000:
                yield out(links, edges)
                links, edges = {}, []
        yield out(links, edges)

    return dealt.mapInArrow(trimmed(run), "id long, other long, links long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: (id, n_links, component_id, kept)."""
    rows = write_table(_clean(df, id_col, vec_col), "caps-vectors")
    good = rows.filter("x is not null")
    reps = write_table(good.groupBy("x").agg(F.min("uid").alias("rep"), F.count("*").alias("weight")).select("rep", "weight", "x"), "caps-reps")
    # One number for each length of vectors.
    words = {r.d: max(4, round((FILTERS_PER_VECTOR * r.n) ** (1 / min(PARTS, r.d)))) for r in reps.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).collect()}
    listed = write_table(_filters(reps.repartition("rep"), words), "caps-filters")
    called = write_table(_called(listed), "caps-called")
    met = write_table(_meet(listed, called, threshold), "caps-met")
    drop_table(listed, called)
    counts = met.filter("other is null").groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    parts = connected_components(met.filter("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v"))).withColumnRenamed("id", "rep")
    named = reps.join(counts, "rep", "left").join(parts, "rep", "left")
    named = named.select(F.col("x").alias("y"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(named, rows["x"] == named["y"], "left").select("uid", "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "uid").alias("component"))
    best = out.filter("n_links > 0").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("best"))
    out = out.join(best, "component", "left")
    component = F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id"))
    return out.select(F.col("id").alias(id_col), "n_links", component.alias("component_id"), F.coalesce(component == F.col("id"), F.col("best.uid") == F.col("uid"), F.lit(True)).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return near_vectors(read(spark, sf_dir, "embeddings"))
