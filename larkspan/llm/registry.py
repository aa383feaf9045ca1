"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from larkspan.llm import bpe, chat, exact_dedup, mixing, quality, runs, simhash, suffix_dedup, token_files, topk, url_filter, warc, whitening

QUERIES = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_chat_format": chat.op2_chat_format,
    "op3_quality": quality.op3_quality,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_token_files": token_files.op9_token_files,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_warc": warc.op13_warc,
}

ORACLE_SQL = {
    "op1_exact_topk": topk.ORACLE_SQL,
    "op2_chat_format": chat.ORACLE_SQL,
    "op5_mix_sources": mixing.ORACLE_SQL,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op13_warc": warc.ORACLE_SQL,
}
