"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from corpusloom.llm import byte_bpe, exact_dedup, language_id, mixing, order_minhash, secret_ledger, sharding, simhash, token_files, toxicity


def queries() -> dict:
    return {
        "op1_mixing": mixing.query,
        "op2_toxicity": toxicity.query,
        "op3_order_minhash": order_minhash.query,
        "op4_language_id": language_id.query,
        "op5_exact_dedup": exact_dedup.query,
        "op6_token_files": token_files.query,
        "op7_byte_bpe": byte_bpe.query,
        "op8_simhash": simhash.query,
        "op9_secret_ledger": secret_ledger.query,
        "op10_sharding": sharding.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.SQL,
        "op5_exact_dedup": exact_dedup.SQL,
        "op10_sharding": sharding.SQL,
    }
