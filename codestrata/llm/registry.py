"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, bytecnn, chat, jaccard, mixing, pages, passages, pfor, rules, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1_bpe,
    "op2_threshold_topk": topk.op2_threshold_topk,
    "op3_quality_rules": rules.op3_quality_rules,
    "op4_substring_dedup": passages.op4_substring_dedup,
    "op5_token_files": pfor.op5_token_files,
    "op6_quality_classifier": bytecnn.op6_quality_classifier,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_mixing": mixing.op8_mixing,
    "op9_chat_format": chat.op9_chat_format,
    "op10_main_text": pages.op10_main_text,
}

ORACLES: dict[str, str] = {
    "op2_threshold_topk": topk.OP2_SQL,
    "op3_quality_rules": rules.OP3_SQL,
    "op4_substring_dedup": passages.OP4_SQL,
    "op7_jaccard_join": jaccard.OP7_SQL,
    "op9_chat_format": chat.OP9_SQL,
}
