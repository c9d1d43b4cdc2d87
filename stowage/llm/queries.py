"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from stowage.llm import chat, decontaminate, langid, lines, pieces, simhash, suffixes, toxicity, urlfilter, vectors

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_language_id": langid.op5_language_id,
    "op6_nearest_neighbours": vectors.op6_nearest_neighbours,
    "op7_url_filter": urlfilter.op7_url_filter,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_sentencepiece": pieces.op10_sentencepiece,
}

ORACLES: dict[str, str] = {"op1_chat_format": chat.ORACLE, "op2_suffix_dedup": suffixes.ORACLE, "op7_url_filter": urlfilter.ORACLE}
