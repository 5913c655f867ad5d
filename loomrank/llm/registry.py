"""Queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from . import (
    exact_dedup,
    line_dedup,
    minhash_dedup,
    nbest_segmentation,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    token_counts,
    token_records,
)


def queries() -> dict:
    return {
        "op1_minhash_dedup": minhash_dedup.op1_minhash_dedup,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_token_records": token_records.op5_token_records,
        "op6_nbest_segmentation": nbest_segmentation.op6_nbest_segmentation,
        "op7_quality_classifier": quality_classifier.op7_quality_classifier,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_quality_rules": quality_rules.op10_quality_rules,
    }


def oracle_sql() -> dict:
    return {"op1_minhash_dedup": minhash_dedup.OP1_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL}
