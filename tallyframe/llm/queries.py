"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import fill_in_middle, importance_resample, jaccard_join, line_dedup, nn_descent, packing, quality_rules, secret_scan, source_mix, suffix_dedup, token_counts, url_filter, warc_revisit

QUERIES = {
    "op1_warc_revisit": warc_revisit.op1_warc_revisit,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_bestfit_packing": packing.op4_bestfit_packing,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_source_mix": source_mix.op7_source_mix,
    "op8_ngram_jaccard_join": jaccard_join.op8_ngram_jaccard_join,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_nn_descent": nn_descent.op10_nn_descent,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_importance_resample": importance_resample.op13_importance_resample,
}

ORACLE_SQL = {
    "op1_warc_revisit": warc_revisit.ORACLE,
    "op2_url_filter": url_filter.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    "op13_importance_resample": importance_resample.ORACLE,
}
