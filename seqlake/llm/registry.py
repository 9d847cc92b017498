"""Queries of the training-data operators; none of their outputs is expressible in DuckDB SQL.

Tokenizers, CRC-32, sketches, suffix windows and trained models have no SQL
form, so each query is tested against a brute-force version in tests/llm.
"""

from __future__ import annotations

from seqlake.llm.decontamination import op6_latent_decontamination
from seqlake.llm.extraction import op4_boosted_extraction
from seqlake.llm.fingerprints import op8_bottom_k_fingerprints
from seqlake.llm.near_dedup import op5_super_minhash
from seqlake.llm.packing import op2_best_fit_packing
from seqlake.llm.quality import op7_kneser_ney_quality
from seqlake.llm.sharding import op9_hilbert_shards
from seqlake.llm.suffix_dedup import op3_suffix_dedup
from seqlake.llm.tokens import op1_token_counts
from seqlake.llm.warc import op10_merkle_audit


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op5_super_minhash": op5_super_minhash,
        "op4_boosted_extraction": op4_boosted_extraction,
        "op6_latent_decontamination": op6_latent_decontamination,
        "op7_kneser_ney_quality": op7_kneser_ney_quality,
        "op8_bottom_k_fingerprints": op8_bottom_k_fingerprints,
        "op9_hilbert_shards": op9_hilbert_shards,
        "op10_merkle_audit": op10_merkle_audit,
    }


def oracle_sql() -> dict:
    return {}
