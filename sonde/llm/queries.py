"""The queries of the training-data operators, and their SQL where SQL can say what they do."""

from __future__ import annotations

from sonde.llm import bpe, chat, decontaminate, neardup, quality, search, secrets, substrings, token_file, unigram

QUERIES = {
    "op1_bpe": bpe.query,
    "op2_substring_dedup": substrings.query,
    "op3_quality": quality.query,
    "op4_secrets": secrets.query,
    "op5_token_counts": unigram.query,
    "op6_decontaminate": decontaminate.query,
    "op7_near_duplicates": neardup.query,
    "op8_token_files": token_file.query,
    "op9_top_k": search.query,
    "op10_chat": chat.query,
}

ORACLE_SQL = {"op9_top_k": search.ORACLE_SQL, "op10_chat": chat.ORACLE_SQL}
