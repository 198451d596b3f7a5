"""Packing of tokenised documents into sequences by patterns and non-negative least squares.

Documents become pieces of at most ``CAPACITY`` tokens, and only the histogram of piece lengths (at
most ``CAPACITY`` numbers) reaches the driver. There, patterns of two to four lengths that fill a
sequence exactly are enumerated, their repeat counts are fitted to the histogram by non-negative
least squares and rounded within what is left, over some passes; best-fit decreasing, run on
lengths with counts, packs the residual. The plan's size follows the number of distinct lengths,
not of documents, so it goes to every worker.

Each piece finds its place by its rank among the pieces of its length. Ranks are counted within
(length, salt), with as many salts as keep a group under ``RANK_GROUP`` rows, so a length that a
third of all rows share is ranked by many tasks. Ranks are taken over a written table; a task run
again gives the same ones.

Edge cases: a null or empty text is the end token alone, a piece of length 1. Rows that repeat an
id are packed each. A text of any length is cut, not dropped. An empty table gives an empty
result. Columns other than id and text are ignored. Special-token strings in a text are read as
the tokenizer reads them.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.shared import WHITE, Recent, quoted, read, remembered, trimmed, tune, write_table

CAPACITY, END = 4096, 1
END_BYTES = END.to_bytes(4, "little")
RANK_GROUP = 50_000
ROWS_AT_ONCE = 1_000
PASSES, PATTERNS_PER_LENGTH, STEPS = 6, 6, 120
#: Stems in a generation of a worker's memory, and their longest; about 100 MB.
STEM_ENTRIES, CACHE_CHARS = 250_000, 40
SPLIT = re.compile(rf"[{WHITE}]+")
#: Letters that composition (NFC) and lower case leave letters. U+0130 and U+0958, say, become a letter
#: and a mark, which is one token with the symbols after it. Words of other letters are stems whole.
SCRIPTS = ((0x41, 0x24F), (0x386, 0x3FF), (0x400, 0x52F), (0x5D0, 0x5EA), (0x620, 0x64A), (0x3041, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
LETTERS = "".join(c for a, z in SCRIPTS for c in map(chr, range(a, z + 1)) if c.isalpha() and c != "\u0130")
#: What may follow the letters: no ', which begins tokens with letters in them.
SYMBOLS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Ids:
    """Texts to little-endian 32-bit ids. The tokenizer drops white space and never joins what it
    parts, so stems are encoded once and looked up after."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.stems = Recent(STEM_ENTRIES)
        vocab, suffix = self.tok.get_vocab(), getattr(self.tok.model, "end_of_word_suffix", None)
        #: Whether an id ends what the tokenizer parts; without such a mark none does.
        self.last = np.zeros(max(vocab.values(), default=-1) + 1, bool)
        self.last[[i for w, i in vocab.items() if suffix and w.endswith(suffix)]] = True

    def _together(self, stems: list[str]) -> Iterator[bytes]:
        """Ids of stems of letters, encoded as one text that is cut again after each last id, if
        there are as many as stems; else each by itself. One call costs less than a thousand."""
        ids = np.array(self.tok.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.last[ids]) + 1
        if len(cuts) != len(stems) or cuts[-1] != len(ids):
            return self._apart(stems)
        blob = ids.tobytes()
        return (blob[a:b] for a, b in itertools.pairwise([0, *(4 * cuts).tolist()]))

    def _apart(self, stems: list[str]) -> Iterator[bytes]:
        return (array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(stems, add_special_tokens=False))

    def _blobs(self, stems: pa.DictionaryArray) -> pa.Array:
        """The ids of each stem. Those of at most ``CACHE_CHARS`` are remembered."""
        names = stems.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.stems.turn()
        known = self.stems.young
        long: dict[str, bytes] = {}
        plain, odd = [], []
        for w in self.stems.missing(names):
            (plain if w.isalpha() else odd).append(w)
        for some, encode in ((plain, self._together), (odd, self._apart)):
            for i in range(0, len(some), 1000):
                for w, ids in zip(part := some[i : i + 1000], encode(part), strict=True):
                    (known if len(w) <= CACHE_CHARS else long)[w] = ids
        blobs = [known[w] if w in known else long[w] for w in names] if long else list(map(known.__getitem__, names))
        return pa.array(blobs, pa.large_binary()).take(stems.indices)

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of each word. Letters and the symbols after them are tokens apart, and letters
        are lower-cased by the tokenizer, so most words come down to fewer stems."""
        head, tail = pc.utf8_rtrim(words, SYMBOLS), pc.utf8_ltrim(words, LETTERS)
        parted = pc.equal(pc.add(pc.binary_length(head), pc.binary_length(tail)), pc.binary_length(words))
        heads = pc.if_else(parted, pc.ascii_lower(head), words).dictionary_encode()
        tails = pc.if_else(parted, tail, "").dictionary_encode()
        return pc.binary_join_element_wise(self._blobs(heads), self._blobs(tails), pa.scalar(b"", pa.large_binary()))

    def of(self, texts: pa.Array) -> tuple[memoryview, list[int]]:
        """Ids of all texts, without end tokens, one after the other, and where each begins and ends.
        Words are split, told apart and put together again by Arrow; only distinct stems are objects."""
        texts = texts.fill_null("")
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():  # those are no white space here
            lists = pa.array([[w for w in SPLIT.split(t) if w] for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.utf8_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        ids = self._words(words.dictionary).take(words.indices)
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        if not len(ids):
            return memoryview(b""), [0] * (len(texts) + 1)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)
        return memoryview(ids.buffers()[2]), ends[starts].tolist()


def _ids(path: str) -> Ids:
    return remembered(f"packing {path}", lambda: Ids(path))


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(uid, id, piece, start, length, ids_crc32), a row per piece."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _ids(tokenizer)
        for b in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, len(b), ROWS_AT_ONCE)):
            owner, piece, start, length, crc = [], [], [], [], []
            ids, at = t.of(b.column(2))
            for i in range(len(b)):
                lo, hi = at[i], at[i + 1]
                n = (hi - lo) // 4 + 1  # and the end token
                for k in range(-(-n // capacity)):
                    first, last = lo + 4 * capacity * k, min(lo + 4 * capacity * (k + 1), hi)
                    size = min(capacity, n - capacity * k)
                    sum_ = zlib.crc32(ids[first:last])
                    owner.append(i)
                    piece.append(k)
                    start.append(capacity * k)
                    length.append(size)
                    crc.append(sum_ if size == (last - first) // 4 else zlib.crc32(END_BYTES, sum_))
            own = pa.array(owner, pa.int64())
            i64 = pa.int64()
            yield pa.record_batch(
                [b.column(0).take(own), b.column(1).take(own), pa.array(piece, pa.int32()), pa.array(start, i64), pa.array(length, i64), pa.array(crc, i64)],
                names=["uid", "id", "piece", "start", "length", "ids_crc32"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return rows.mapInArrow(trimmed(run), f"uid long, id {kind}, piece int, start long, length long, ids_crc32 long")


def _patterns(left, capacity: int, per_length: int, rng) -> list[tuple[int, ...]]:
    """Patterns of two present lengths that sum to the capacity; with ``per_length`` of three and
    four as well, so many for each length."""
    have = np.flatnonzero(left)
    found = {(a, capacity - a) for a in have.tolist() if a <= capacity - a and left[capacity - a]}
    weight = left[have] / left[have].sum()
    for a in have.tolist():
        for b in rng.choice(have, per_length, p=weight).tolist() if per_length else ():
            c = capacity - a - b
            if c > 0 and left[c]:
                found.add(tuple(sorted((a, b, c))))
            d = rng.choice(have, p=weight)
            if (e := c - int(d)) > 0 and left[e]:
                found.add(tuple(sorted((a, b, int(d), e))))
    return sorted(found)


def _fit(patterns: list[tuple[int, ...]], left, capacity: int):
    """Repeat counts x >= 0 that minimise |W (A x - left)|^2 by accelerated projected gradients; W
    weighs lengths by their share of the capacity, as long pieces are the hard ones to place."""
    owner = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    item = np.fromiter((i for p in patterns for i in p), np.int64)
    n = len(patterns)
    weight = (np.arange(capacity + 1) / capacity) ** 2
    degree = np.bincount(item, minlength=capacity + 1) * weight
    step = 1.0 / max(np.bincount(owner, weights=degree[item]).max(), 1e-9)
    x = y = np.zeros(n)
    mom = 1.0
    for _ in range(STEPS):
        residual = weight * (np.bincount(item, weights=y[owner], minlength=capacity + 1) - left)
        new = np.maximum(y - step * np.bincount(owner, weights=residual[item], minlength=n), 0)
        nm = (1 + np.sqrt(1 + 4 * mom * mom)) / 2
        y = new + (mom - 1) / nm * (new - x)
        x, mom = new, nm
    return x


def best_fit(left, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over lengths with counts: ([(length, copies)...], number of sequences)."""
    import bisect

    groups: dict[int, list[list]] = {}  # free space -> [contents, number of sequences]
    free: list[int] = []

    def put(space: int, contents: tuple, n: int) -> None:
        if space not in groups:
            groups[space] = []
            bisect.insort(free, space)
        groups[space].append([contents, n])

    for size in range(capacity, 0, -1):
        c = int(left[size])
        while c:
            at = bisect.bisect_left(free, size)
            if at == len(free):
                q = min(capacity // size, c)
                n = c // q
                put(capacity - q * size, ((size, q),), n)
                c -= n * q
                continue
            space = free[at]
            contents, n = groups[space][-1]
            q = min(space // size, c)
            k = min(n, c // q)
            if k == n:
                groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    free.pop(at)
            else:
                groups[space][-1][1] -= k
            put(space - q * size, (*contents, (size, q)), k)
            c -= k * q
    return [(list(contents), n) for gs in groups.values() for contents, n in gs]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """([(length, copies)...], number of sequences) for all pieces of the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        left[size] += n
    out: list[tuple[list[tuple[int, int]], int]] = []
    if left[capacity]:
        out.append(([(capacity, 1)], int(left[capacity])))
        left[capacity] = 0
    rng = np.random.default_rng(7)
    best: tuple[int, list] | None = None
    for nth in range(PASSES):
        if not left.any():
            break
        patterns = _patterns(left, capacity, PATTERNS_PER_LENGTH if nth else 0, rng)
        x = _fit(patterns, left, capacity) if patterns else np.empty(0)
        placed = 0
        # Patterns round the longest pieces first: those have the fewest partners.
        for i in sorted(np.flatnonzero(np.round(x) > 0).tolist(), key=lambda i: (-patterns[i][-1], len(patterns[i]), -x[i])):
            need: dict[int, int] = {}
            for size in patterns[i]:
                need[size] = need.get(size, 0) + 1
            r = min(int(round(x[i])), *(int(left[size]) // k for size, k in need.items()))
            if r > 0:
                out.append((sorted(need.items(), reverse=True), r))
                for size, k in need.items():
                    left[size] -= r * k
                placed += r
        # Exact patterns can use up the pieces that others need: the pass after which patterns and
        # packed residual are fewest together is the last.
        whole = out + best_fit(left, capacity)
        count = sum(n for _, n in whole)
        if best is None or count < best[0]:
            best = (count, whole)
        if not placed and nth:
            break
    return best[1] if best else out


class Slots:
    """For each length, runs of ranks and where they go."""

    def __init__(self, groups: list[tuple[list[tuple[int, int]], int]], capacity: int):
        rows, base = [], 0
        at = [0] * (capacity + 1)
        for contents, n in groups:
            off = 0
            for size, q in contents:
                rows.append((size, at[size], base, off, q))
                at[size] += n * q
                off += size * q
            base += n
        rows.sort()
        self.rows = np.array(rows, np.int64).reshape(-1, 5)
        self.key = self.rows[:, 0] << 44 | self.rows[:, 1]
        self.sequences = base

    def place(self, length, rank):
        i = np.searchsorted(self.key, length << 44 | rank, side="right") - 1
        size, start, base, off, q = self.rows[i].T
        r = rank - start
        return base + r // q, off + (r % q) * size


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece."""
    spark = df.sparkSession
    rows = write_table(pieces(df, id_col, text_col, tokenizer, capacity), "packing-pieces")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most capacity rows
    slots = Slots(plan(histogram, capacity), capacity)
    salts = max(1, -(-max(histogram.values(), default=0) // RANK_GROUP))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("uid", "piece"), F.lit(salts)).cast("int"))
    counts = rows.groupBy("length", "salt").count()
    before = counts.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid", "piece")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    shared = spark.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = shared.value.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.record_batch([*b.columns[:5], pa.array(seq), pa.array(off)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    kind = df.schema[id_col].dataType.simpleString()
    out = ranked.mapInArrow(trimmed(run), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return pack(read(spark, sf_dir, "documents"))
