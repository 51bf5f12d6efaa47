"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from . import chat, decontaminate, embeddings, html, langid, licenses, lm, neardup, packing, records

#: Query name to module; the query is the module's function of that name, SQL its SQL, where it has one.
QUERIES = {
    "op1_decontamination": decontaminate,
    "op2_near_duplicates": neardup,
    "op3_license_scan": licenses,
    "op4_embedding_near_duplicates": embeddings,
    "op5_token_records": records,
    "op6_language_id": langid,
    "op7_best_fit_packing": packing,
    "op8_html_extraction": html,
    "op9_lm_scoring": lm,
    "op10_chat_formatting": chat,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: module.SQL for name, module in QUERIES.items() if hasattr(module, "SQL")}
