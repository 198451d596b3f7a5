"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import bpe, chat, embed_dedup, exact_dedup, katz, minhash, packing, pii, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_url_filter": urls.op2_url_filter,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_chat_format": chat.op5_chat_format,
    "op6_katz": katz.op6_katz,
    "op7_packing": packing.op7_packing,
    "op8_embedding_dedup": embed_dedup.op8_embedding_dedup,
    "op9_minhash": minhash.op9_minhash,
    "op10_toxicity": toxicity.op10_toxicity,
}

SQL: dict[str, str] = urls.SQL | exact_dedup.SQL | chat.SQL
