"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowdeck.llm import (
    op01_html, op02_rules, op03_pii, op04_chat, op05_toxicity, op06_decontamination, op07_jaccard, op08_ordinal, op09_sentencepiece, op10_paragraphs,
    op11_search, op12_repair, op13_exact,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op01_html.query,
    "op2_quality_rules": op02_rules.query,
    "op3_pii": op03_pii.query,
    "op4_chat_formatting": op04_chat.query,
    "op5_toxicity": op05_toxicity.query,
    "op6_decontamination": op06_decontamination.query,
    "op7_ngram_jaccard_join": op07_jaccard.query,
    "op8_quality_classifier": op08_ordinal.query,
    "op9_sentencepiece": op09_sentencepiece.query,
    "op10_paragraph_dedup": op10_paragraphs.query,
    "op11_ranked_search": op11_search.query,
    "op12_conversation_repair": op12_repair.query,
    "op13_exact_dedup": op13_exact.query,
}
ORACLES: dict[str, str] = {
    "op4_chat_formatting": op04_chat.SQL,
    "op7_ngram_jaccard_join": op07_jaccard.SQL,
    "op11_ranked_search": op11_search.SQL,
    "op12_conversation_repair": op12_repair.SQL,
    "op13_exact_dedup": op13_exact.SQL,
}
