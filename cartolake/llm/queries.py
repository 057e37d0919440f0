"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartolake.llm import chat, decontamination, html_text, jaccard_join, line_dedup, mixing, phrases, pii, quality, spelling, suffix_dedup, token_output, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_pii": pii.op4_pii,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_quality": quality.op8_quality,
    "op9_token_output": token_output.op9_token_output,
    "op10_mixing": mixing.op10_mixing,
    "op11_html_text": html_text.op11_html_text,
    "op12_collocations": phrases.op12_collocations,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": decontamination.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op5_jaccard_join": jaccard_join.OP5_SQL,
    "op6_chat_formatting": chat.OP6_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_html_text": html_text.OP11_SQL,
    "op12_collocations": phrases.OP12_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
