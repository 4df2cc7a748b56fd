"""The queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import chat, decontaminate, katz, language, mixing, pii, quality, simhash, templates, urls

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_simhash_near_dedup": simhash.op2,
    "op3_chat_format": chat.op3,
    "op4_mix_sources": mixing.op4,
    "op5_decontaminate": decontaminate.op5,
    "op6_pii": pii.op6,
    "op7_url_filters": urls.op7,
    "op8_katz_lm": katz.op8,
    "op9_language_id": language.op9,
    "op10_line_templates": templates.op10,
}

ORACLE_SQL = {"op3_chat_format": chat.OP3_SQL, "op5_decontaminate": decontaminate.OP5_SQL, "op7_url_filters": urls.OP7_SQL}
