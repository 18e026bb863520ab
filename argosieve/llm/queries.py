"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from argosieve.llm import bpe, exactdedup, fingerprint, htmlextract, linededup, mixing, sharding, simhash, tokenstore, toxicity


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
        "op2_html_extraction": htmlextract.op2_html_extraction,
        "op3_token_store": tokenstore.op3_token_store,
        "op4_source_mixing": mixing.op4_source_mixing,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_line_dedup": linededup.op6_line_dedup,
        "op7_exact_dedup": exactdedup.op7_exact_dedup,
        "op8_bpe": bpe.op8_bpe,
        "op9_document_fingerprints": fingerprint.op9_document_fingerprints,
        "op10_sharding": sharding.op10_sharding,
        "fingerprint_groups": fingerprint.fingerprint_groups,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_source_mixing": mixing.OP4_SQL, "op6_line_dedup": linededup.OP6_SQL, "op7_exact_dedup": exactdedup.OP7_SQL, "fingerprint_groups": fingerprint.GROUPS_SQL}
