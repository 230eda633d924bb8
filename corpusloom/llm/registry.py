"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, chat, exact_dedup, host_quality, langid, mixing, near_dedup, sharding, substring_dedup, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_host_quality": host_quality.op5_host_quality,
    "op6_sharding": sharding.op6_sharding,
    "op7_chat": chat.op7_chat,
    "op8_langid": langid.op8_langid,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_mixing": mixing.SQL,
    "op5_host_quality": host_quality.SQL,
    "op6_sharding": sharding.SQL,
    "op7_chat": chat.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
