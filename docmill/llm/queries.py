"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (byte_bpe, conversation_repair, decontamination, fill_middle, line_dedup, ngram_join, piece_bpe, quality_model, quality_rules, suffix_dedup,
               token_store, toxicity, warc)
from .common import read

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": lambda s, d: token_store.digests(s, read(s, d, "documents")),
    "op2_quality_rules": lambda s, d: quality_rules.digests(read(s, d, "documents"), read(s, d, "labels")),
    "op3_suffix_dedup": lambda s, d: suffix_dedup.digests(read(s, d, "documents")),
    "op4_decontamination": lambda s, d: decontamination.digests(read(s, d, "documents"), read(s, d, "benchmark")),
    "op5_toxicity": lambda s, d: toxicity.digests(read(s, d, "documents"), read(s, d, "labels")),
    "op6_warc_transactions": lambda s, d: warc.digests(s, read(s, d, "pages")),
    "op7_line_dedup": lambda s, d: line_dedup.digests(read(s, d, "documents")),
    "op8_quality_model": lambda s, d: quality_model.digests(read(s, d, "documents"), read(s, d, "labels")),
    "op9_ngram_join": lambda s, d: ngram_join.link_documents(read(s, d, "documents")),
    "op10_byte_bpe": lambda s, d: byte_bpe.digests(read(s, d, "documents")),
    "op11_conversation_repair": lambda s, d: conversation_repair.digests(read(s, d, "conversations")),
    "op12_fill_middle": lambda s, d: fill_middle.digests(read(s, d, "documents")),
    "op13_piece_bpe": lambda s, d: piece_bpe.digests(read(s, d, "documents")),
}
ORACLE: dict[str, str] = {
    "op4_decontamination": decontamination.ORACLE,
    "op6_warc_transactions": warc.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op9_ngram_join": ngram_join.ORACLE,
    "op12_fill_middle": fill_middle.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
