"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import compression_quality, hamming_search, hard_negatives, html_extract, jaccard_join, license_scan, mixing, packing, periodic_runs, pii, quality_rules, sharding, vector_dedup

QUERIES = {
    "op1_cube_mix": mixing.op1_cube_mix,
    "op2_compression_quality": compression_quality.op2_compression_quality,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_feistel_pii": pii.op4_feistel_pii,
    "op5_label_propagation": sharding.op5_label_propagation,
    "op6_line_cleaning": quality_rules.op6_line_cleaning,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_recurrent_labeller": html_extract.op8_recurrent_labeller,
    "op9_multi_index_hashing": hamming_search.op9_multi_index_hashing,
    "op10_partition_jaccard": jaccard_join.op10_partition_jaccard,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_pstable_dedup": vector_dedup.op12_pstable_dedup,
    "op13_vantage_negatives": hard_negatives.op13_vantage_negatives,
}

SQL = {
    "op6_line_cleaning": quality_rules.SQL,
    "op9_multi_index_hashing": hamming_search.SQL,
    "op13_vantage_negatives": hard_negatives.SQL,
}
