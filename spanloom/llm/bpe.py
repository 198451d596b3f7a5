"""Byte-level BPE with a local rank file: encoding, and decoding back to raw bytes.

The texts are split before the tokenizer sees them, at places no match of the pre-tokenisation
pattern can cross: between a character that is no white space and one that is. So a text of any
length costs linear time, and pieces that come again are looked up instead of merged again.

Edge cases: a null or empty text has no tokens (empty ids, empty bytes). Runs of white space
longer than ``LONG_RUN`` would exhaust the pattern engine's stack; their one match is merged
directly, with the same ids. Repeated rows and doc_ids are encoded each. Columns of the input
other than the two named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.shared import WHITE, Recent, read, remembered, trimmed, tune

SPLIT = re.compile(rf"(?<=\S)(?=[{WHITE}])")
RUN = re.compile(rf"[{WHITE}]+")
LONG_RUN = 1000
#: Entries of a generation, and characters of a piece, that a worker keeps; about 60 MB.
CACHE_ENTRIES, CACHE_CHARS = 100_000, 40


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """A tokenizer over a rank file, with a bounded memory of short pieces."""

    def __init__(self, rank_path: str, pattern: str):
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known = Recent(CACHE_ENTRIES)

    def piece_ids(self, piece: str) -> list[int]:
        run = RUN.match(piece)
        if run and run.end() > LONG_RUN:
            cut = run.end() - (run.end() < len(piece))
            ids = self.enc._encode_single_piece(piece[:cut])
            return ids + self.enc.encode_ordinary(piece[cut:])
        return self.enc.encode_ordinary(piece)

    def ids(self, text: str | None) -> list[int]:
        return [i for piece in SPLIT.split(text or "") for i in self.piece_ids(piece)]

    def decode(self, ids: list[int]) -> bytes:
        return self.enc.decode_bytes(ids)

    def _look_up(self, piece: str) -> tuple[int, bytes, bytes]:
        got = self.known.old.get(piece)
        if got is None:
            ids = self.piece_ids(piece)
            got = (len(ids), " ".join(map(str, ids)).encode(), self.decode(ids))
        if len(piece) <= CACHE_CHARS:
            self.known.young[piece] = got
        return got

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Count of ids, digest of their decimal form, digest of the bytes they decode to."""
        if not text:
            empty = hashlib.sha256().hexdigest()
            return 0, empty, empty
        self.known.turn()
        known = self.known.young
        got = [known.get(p) or self._look_up(p) for p in SPLIT.split(text)]
        return (
            sum(g[0] for g in got),
            hashlib.sha256(b" ".join([g[1] for g in got])).hexdigest(),
            hashlib.sha256(b"".join([g[2] for g in got])).hexdigest(),
        )


def codec(rank_path: str, pattern: str) -> Codec:
    """One per worker process."""
    return remembered(f"bpe {rank_path} {pattern}", lambda: Codec(rank_path, pattern))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row's whole text. The rank file must lie at the same path
    on every machine."""
    rank_path, pattern = rank_path or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_path, pattern)
        for b in batches:
            ids = [c.ids(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(trimmed(run), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", rank_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, bytes binary): raw bytes, which need not be valid UTF-8 when ids were cut."""
    rank_path, pattern = rank_path or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_path, pattern)
        for b in batches:
            out = [c.decode(i or []) for i in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(trimmed(run), f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes each whole text, decodes the ids again."""
    rank_path, pattern = rank_path or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_path, pattern)
        for b in batches:
            n, ids, dec = zip(*(c.digest(t) for t in b.column(1).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            yield pa.record_batch(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(id_col, text_col).mapInArrow(trimmed(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return round_trip(read(spark, sf_dir, "documents"))
