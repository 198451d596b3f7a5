"""Near-duplicates by fast similarity sketching, banding and exact verification.

A text's set holds its distinct shingles of five words (A-Z lower-cased; with fewer words the whole
sequence), as 64-bit hashes. The sketch has ``BANDS * ROWS`` coordinates. In round i every element
is thrown into the bin its i-th hash names and the least value stays; a bin filled in an earlier
round keeps it. After as many rounds as there are coordinates, one more round per coordinate throws
all elements into that one, so every coordinate is filled, and the estimate is concentrated as for
independent hashes. Bands of ``ROWS`` coordinates name buckets.

Links are confirmed on full sets: 100 * |A & B| >= 75 * |A | B|. As components are wanted, pairs
already connected need no look:

1. Rows with equal sets share one representative, the first row.
2. Each representative is compared with one leader, the first one it shares a bucket with.
3. In buckets that still hold several components, all pairs across components are compared,
   block by block. Nothing is capped.

Both comparisons are made on the sketches first, as these are short; only where a pair's estimate
is ``ESTIMATE`` or more do the texts travel and decide. A pair at the threshold shares no bucket
with probability (1 - 0.75^5)^32 < 2e-4. Comparisons are dealt out by (leader, salt), with at most
``GROUP`` rows each, so a group of copies of any size is spread over tasks; in step 3 a task holds
two blocks of ``BLOCK`` rows at most, and a block's texts only where a sketch called for them.

Edge cases: null, empty or blank texts have an empty set (n_shingles 0) and link with nothing.
Each row is a vertex of its own, whatever its id: rows that repeat an id, or whose ids are null, are
linked by their texts. component_id is the smallest id reached, null if all are null; kept is
id = component_id, and where the id is null, whether the row is its component's first. Of a
component ``drop_near_duplicates`` keeps one row, the one with the smallest id, null last. Ids are
of any type that has an order. Empty tables give empty results; other columns are ignored, or kept
by ``drop_near_duplicates``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.graph import connected_components
from spanloom.llm.shared import drop_table, quoted, read, remembered, sent, trimmed, tune, with_uid, without, write_table

SHINGLE, BANDS, ROWS = 5, 32, 5
T = BANDS * ROWS
#: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Pairs whose estimate from 160 coordinates is below this are 4.4 standard deviations under 0.75.
ESTIMATE = 0.60
GROUP, BLOCK = 256, 512
M64 = (1 << 64) - 1


class Words(dict):
    """Word -> 64-bit hash, with a bounded memory of two generations."""

    old: dict = {}

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self.old.get(word) or xxhash.xxh64_intdigest(word)
        if len(self) >= 150_000:
            self.old = self.copy()
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


def word_hashes() -> Words:
    return remembered("word hashes", Words)


def mix(x):
    """A bijective mixer of 64-bit words (splitmix64's finaliser)."""
    import numpy as np

    u = np.uint64
    x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
    return x ^ (x >> u(31))


@lru_cache(maxsize=1)
def _constants():
    import numpy as np

    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        powers = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(max(SHINGLE, ROWS))], np.uint64)
        bands = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
    return seeds, powers, bands


def shingle_set(text: bytes | None):
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text."""
    import numpy as np

    words = (text or b"").lower().split()  # both are ASCII only for bytes
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, n)
    _, powers, _ = _constants()
    with np.errstate(over="ignore"):
        if n < SHINGLE:
            return mix((h * powers[:n]).sum(keepdims=True) + np.uint64(n))
        x = h[: n - SHINGLE + 1] * powers[0]
        for i in range(1, SHINGLE):
            x = x + h[i : n - SHINGLE + 1 + i] * powers[i]
        return np.unique(mix(x))


def sketch(x):
    """T coordinates (round and least value) of a non-empty set."""
    import numpy as np

    seeds, _, _ = _constants()
    full = np.uint64(M64)
    s = np.full(T, full, np.uint64)
    u = np.uint64
    done, step = 0, max(1, -(-900 // len(x)))
    with np.errstate(over="ignore"):
        while done < T:
            k = min(step, T - done)
            h = mix(x[None, :] ^ seeds[done : done + k, None])
            key = (np.arange(done, done + k, dtype=u)[:, None] << u(54)) | (h >> u(10))
            np.minimum.at(s, (h % u(T)).astype(np.int64).ravel(), key.ravel())
            done += k
            if not (s == full).any():
                return s
        for j in np.flatnonzero(s == full):  # the rounds in which all elements go to one bin
            h = mix(x ^ seeds[T + j])
            s[j] = (u(T + j) << u(54)) | (h.min() >> u(10))
    return s


def signature(text: bytes | None):
    """(n_shingles, two hashes of the set, band keys, 16 bits of each coordinate)."""
    import numpy as np

    x = shingle_set(text)
    if not len(x):
        return 0, 0, 0, [], b""
    _, powers, bands = _constants()
    with np.errstate(over="ignore"):
        s = sketch(x)
        keys = mix((mix(s).reshape(BANDS, ROWS) * powers[:ROWS]).sum(1) ^ bands)
        a, b = mix(x + np.uint64(1)).sum(), np.bitwise_xor.reduce(mix(x + np.uint64(2)))
        small = (mix(s) >> np.uint64(48)).astype(np.uint16)
    return len(x), int(a.astype(np.int64)), int(b.astype(np.int64)), keys.astype(np.int64), small.tobytes()


def similar(x, y, percent: int = PERCENT) -> bool:
    import numpy as np

    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def signatures(docs: DataFrame) -> DataFrame:
    """docs: (uid, id, text). (uid, id, n, h1, h2, bands, sketch) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i64 = pa.int64()
        for b in batches:
            got = [signature(t) for t in b.column(2).cast(pa.binary()).to_pylist()]
            n, h1, h2, keys, small = zip(*got, strict=True) if got else ((),) * 5
            made = [pa.array(n, i64), pa.array(h1, i64), pa.array(h2, i64), pa.array(keys, pa.list_(i64)), pa.array(small, pa.binary())]
            yield pa.record_batch([b.column(0), b.column(1), *made], names=["uid", "id", "n", "h1", "h2", "bands", "sketch"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(trimmed(run), f"uid long, id {kind}, n long, h1 long, h2 long, bands array<long>, sketch binary")


def _dealt(rows: DataFrame, pairs: DataFrame, *values: str) -> DataFrame:
    """``rows`` (uid, values) at each place where ``pairs`` (u, lead) needs them: u's rows beside
    their leader's, GROUP at a time, the leader first."""
    load = pairs.groupBy("lead").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    members = pairs.join(load, "lead").select(F.col("u").alias("at"), "lead", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("rank"))
    leads = load.select(F.col("lead").alias("at"), "lead", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("rank"))
    plan = write_table(members.unionByName(leads), "minhash-plan")
    out = rows.join(sent(plan), rows["uid"] == plan["at"]).select("uid", "lead", "salt", "rank", *values)
    return out.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "rank")


def _pairs(us: list[int], vs: list[int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "lead"])


def promising(sigs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (u, lead) those whose sizes and sketches allow similar sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        lead, size, first = None, 0, None
        for b in batches:
            us, vs = [], []
            n = b.column(4).to_pylist()
            x = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint16).reshape(len(n), T)
            for i, (u, v, rank) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if rank == 0:
                    lead, size, first = v, n[i], x[i].copy()
                elif lead == v and 100 * min(size, n[i]) >= PERCENT * max(size, n[i]) and (x[i] == first).sum() >= ESTIMATE * T:
                    us.append(u)
                    vs.append(v)
            yield _pairs(us, vs)

    return _dealt(sigs, pairs, "n", "sketch").mapInArrow(trimmed(run), "u long, lead long")


def confirm(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (u, lead) those whose sets are similar. docs: (uid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, first = None, None
        for b in batches:
            us, vs = [], []
            for u, v, rank, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).cast(pa.binary()).to_pylist(), strict=True):
                if rank == 0:
                    lead, first = v, shingle_set(text)
                elif lead == v and similar(shingle_set(text), first):
                    us.append(u)
                    vs.append(v)
            yield _pairs(us, vs)

    return _dealt(docs, pairs, "text").mapInArrow(trimmed(run), "u long, lead long")


def _groups(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[list[tuple]]:
    """Rows that agree in (key, b1, b2), which come one after the other."""
    group: list[tuple] = []
    for b in batches:
        columns = [*(c.to_pylist() for c in b.columns[:6]), *([b.column(6).cast(pa.binary()).to_pylist()] if texts else [c.to_pylist() for c in b.columns[6:]])]
        for r in zip(*columns, strict=True):
            if group and group[0][:3] != r[:3]:
                yield group
                group = []
            group.append(r)
    if group:
        yield group


def _calls(group: list[tuple], signs: list[tuple]) -> Iterator[tuple[int, list[int]]]:
    """For each row of a group the rows of another component that its sketch calls for. Two rows
    are looked at in the first bucket they share only. signs: (n, bands, sketch) of each row."""
    import numpy as np

    key, b1, b2 = group[0][:3]
    comp, side = np.array([g[5] for g in group]), np.array([g[3] for g in group])
    n = np.array([s[0] for s in signs])
    bands = np.array([s[1] for s in signs], np.int64).reshape(len(group), BANDS)
    x = np.frombuffer(b"".join(s[2] for s in signs), np.uint16).reshape(len(group), T)
    places = np.arange(len(group))
    for i in range(len(group)):
        if b1 != b2 and side[i] != b1:
            continue
        j = np.flatnonzero((comp != comp[i]) & ((side == b2) if b1 != b2 else (places > i)))
        j = j[100 * np.minimum(n[j], n[i]) >= PERCENT * np.maximum(n[j], n[i])]
        j = j[(x[j] == x[i]).sum(1) >= ESTIMATE * T]
        same = bands[j] == bands[i]
        j = j[same.any(1) & (bands[i][same.argmax(1)] == key)]
        if len(j):
            yield i, j.tolist()


PLACE = ["key", "b1", "b2", "block", "rep", "comp"]


def confirm_across(docs: DataFrame, sigs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: (key, rep, comp) of unresolved buckets. Links (u, lead) that join different components.

    Blocks of a bucket meet pair by pair, first by their sketches; the rows called for meet again
    with their texts. Of the links found a block gives a spanning forest, so no more rows come
    out than went in."""
    load = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    dealt = rows.join(load, "key").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    plan = write_table(dealt.select("key", F.least("block", "o").alias("b1"), F.greatest("block", "o").alias("b2"), "block", "rep", "comp"), "minhash-blocks")

    def met(table: DataFrame, plan: DataFrame, *values: str) -> DataFrame:
        out = table.join(sent(plan), table["uid"] == plan["rep"]).select(*PLACE, *values)
        return out.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, False):
            called: set[int] = set()
            for i, js in _calls(group, [g[6:9] for g in group]):
                called.update((i, *js))
            got = [group[i][:6] for i in sorted(called)]
            yield pa.record_batch([pa.array(c, pa.int32() if k in (1, 2, 3) else pa.int64()) for k, c in enumerate(zip(*got, strict=True) if got else ((),) * 6)], names=PLACE)

    def links(group: list[tuple]) -> list[tuple[int, int]]:
        signs = [signature(g[6]) for g in group]
        sets: dict[int, object] = {}
        up = {g[5]: g[5] for g in group}

        def root(c: int) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        def of(i: int):
            if i not in sets:
                sets[i] = shingle_set(group[i][6])
            return sets[i]

        out = []
        for i, js in _calls(group, [(s[0], s[3], s[4]) for s in signs]):
            for k in js:
                a, b = root(group[i][5]), root(group[k][5])
                if a != b and similar(of(i), of(k)):
                    up[max(a, b)] = min(a, b)
                    out.append((group[i][4], group[k][4]))
        return out

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, True):
            found = links(group)
            yield _pairs([f[0] for f in found], [f[1] for f in found])

    called = write_table(met(sigs, plan, "n", "bands", "sketch").mapInArrow(trimmed(call), "key long, b1 int, b2 int, block int, rep long, comp long"), "minhash-called")
    drop_table(plan)
    return met(docs, called, "text").mapInArrow(trimmed(decide), "u long, lead long")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: (uid, id, text), a written table. (uid, id, n) of all rows; (uid, component_id, first)
    of rows that share their class with others: its smallest id, and the row that has it."""
    sigs = write_table(signatures(docs), "minhash-signatures")
    full = sigs.filter("n > 0")
    sets = full.groupBy("h1", "h2", "n").agg(F.min("uid").alias("rep"), F.count("*").alias("m")).filter("m > 1").drop("m")
    copies = write_table(full.select("uid", "h1", "h2", "n").join(sets, ["h1", "h2", "n"]).filter("uid <> rep").select("uid", "rep"), "minhash-copies")
    reps = full.join(sent(copies.select("uid")), "uid", "left_anti")
    buckets = reps.select(F.explode("bands").alias("key"), F.col("uid").alias("rep"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("lead")).filter("m > 1").drop("m")
    members = write_table(buckets.join(shared, "key"), "minhash-members")
    first = write_table(members.filter("rep <> lead").groupBy(F.col("rep").alias("u")).agg(F.min("lead").alias("lead")), "minhash-first")
    pairs = write_table(promising(sigs, first), "minhash-promising")
    links = write_table(confirm(docs, pairs), "minhash-links")
    edges = links.toDF("u", "v")
    parts = connected_components(edges)
    left = write_table(members.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp")), "minhash-left")
    open_ = left.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    second = write_table(confirm_across(docs, sigs, left.join(open_, "key", "left_semi")), "minhash-second")
    drop_table(members, first, pairs, left)
    if second.limit(1).count():
        parts = connected_components(edges.unionByName(second.toDF("u", "v")))
    own = copies.unionByName(copies.select(F.col("rep").alias("uid"), "rep").distinct())
    parts = parts.select(F.col("id").alias("rep"), "component")
    named = own.join(parts, "rep", "left").select("uid", F.coalesce("component", "rep").alias("comp"))
    named = named.unionByName(parts.select(F.col("rep").alias("uid"), F.col("component").alias("comp"))).distinct()
    named = named.join(sigs.select("uid", "id"), "uid")
    best = named.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("best"))
    named = named.join(best, "comp").select("uid", F.col("best.id").alias("component_id"), (F.col("best.uid") == F.col("uid")).alias("first"))
    return sigs.select("uid", "id", "n"), named


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: (id, n_shingles, component_id, kept)."""
    docs, _ = with_uid(df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")), "minhash-docs")
    rows, named = classes(docs.select("uid", "id", "text"))
    out = rows.join(named, "uid", "left")
    component = F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), "first", F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component; same columns."""
    docs, uid = with_uid(df, "minhash-docs")
    rows, named = classes(docs.select(F.col(uid).alias("uid"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")))
    gone = write_table(named.filter("not first").select("uid"), "minhash-gone")
    return without(docs, uid, gone)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return near_duplicates(read(spark, sf_dir, "documents"))
