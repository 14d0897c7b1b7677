"""The queries of this folder, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import ann, bit_packing, chat_format, html_extract, language_id, mixing, near_dedup, order_minhash, packing, token_count

QUERIES = {
    "op1_token_counts": token_count.query,
    "op2_document_fingerprints": order_minhash.query,
    "op3_nearest_neighbours": ann.query,
    "op4_token_packing": bit_packing.query,
    "op5_source_mixing": mixing.query,
    "op6_near_dedup": near_dedup.query,
    "op7_html_extraction": html_extract.query,
    "op8_packing": packing.query,
    "op9_language_id": language_id.query,
    "op10_chat_format": chat_format.query,
    "chat_typed_parts": chat_format.typed_query,
}
ORACLES = {"op10_chat_format": chat_format.ORACLE_SQL, "chat_typed_parts": chat_format.TYPED_SQL}
