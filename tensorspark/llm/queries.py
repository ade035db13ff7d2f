"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tensorspark.llm import (
    alignment,
    chat,
    decontaminate,
    exact_dedup,
    langid,
    near_dedup,
    packing,
    pii,
    site_lines,
    source_audit,
    token_counts,
    token_files,
    warc,
)

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_masks": chat.query,
    "op2_token_files": token_files.query,
    "op3_hamming_near_dedup": near_dedup.query,
    "op4_site_lines": site_lines.query,
    "op5_curve_packing": packing.query,
    "op6_zstd_warc": warc.query,
    "op7_fm_index_leaks": decontaminate.query,
    "op8_hash_index_dedup": exact_dedup.query,
    "op9_personal_data": pii.query,
    "op10_piece_langid": langid.query,
    "op11_whole_token_counts": token_counts.query,
    "op12_pointer_sort_audit": source_audit.query,
    "op13_run_skip_alignment": alignment.query,
}

LLM_ORACLES: dict[str, str] = {
    "op4_site_lines": site_lines.SQL,
    "op6_zstd_warc": warc.SQL,
    "op8_hash_index_dedup": exact_dedup.SQL,
    "op12_pointer_sort_audit": source_audit.SQL,
}
