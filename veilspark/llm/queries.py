"""The queries of this folder, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ball_tree, classifier, line_dedup, log_bilinear, mixing, near_dedup, packing, quality_rules, token_files, transducer

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_packing,
        mixing.op2_mixing,
        log_bilinear.op3_lm_scores,
        transducer.op4_token_counts,
        quality_rules.op5_quality_rules,
        token_files.op6_token_files,
        line_dedup.op7_line_dedup,
        classifier.op8_quality_classifier,
        near_dedup.op9_near_dedup,
        ball_tree.op10_top_k,
    )
}

ORACLES = {"op5_quality_rules": quality_rules.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op10_top_k": ball_tree.ORACLE}
