"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontam, embeddings, lm, minhash, mixing, quality, sharding, suffix, tokens, toxicity


def queries():
    return {
        "op1_near_duplicates": minhash.op1_near_duplicates,
        "op2_token_counts": tokens.op2_token_counts,
        "op3_sharding": sharding.op3_sharding,
        "op4_decontamination": decontam.op4_decontamination,
        "op5_quality": quality.op5_quality,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_near_vectors": embeddings.op7_near_vectors,
        "op8_mixing": mixing.op8_mixing,
        "op9_language_model": lm.op9_language_model,
        "op10_repeats": suffix.op10_repeats,
    }


def oracle_sql():
    return {"op3_sharding": sharding.ORACLE, "op4_decontamination": decontam.ORACLE, "op8_mixing": mixing.ORACLE}
