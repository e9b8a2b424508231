"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillon.llm import bpe_codec, chat_format, packing, quality, secret_scan, sharding, shingle_join, tiff, token_counts, top_k

QUERIES = {
    "op1_chat_format": chat_format.query,
    "op2_tiff_pages": tiff.query,
    "op3_secret_scan": secret_scan.query,
    "op4_token_counts": token_counts.query,
    "op5_packing": packing.query,
    "op6_shingle_join": shingle_join.query,
    "op7_bpe_codec": bpe_codec.query,
    "op8_quality": quality.query,
    "op9_top_k": top_k.query,
    "op10_sharding": sharding.query,
}

ORACLE_SQL = {
    "op1_chat_format": chat_format.ORACLE_SQL,
    "op9_top_k": top_k.ORACLE_SQL,
}
