"""Operators of a training-data pipeline, each with its registered query.

Nothing else in the library imports this subpackage.
"""

from __future__ import annotations

from . import (
    collocations,
    decontamination,
    embedding_dedup,
    fill_in_middle,
    html_text,
    jaccard_join,
    license_scan,
    line_dedup,
    mixing,
    quality,
    secret_scan,
    sharding,
    toxicity,
)

QUERIES = {
    "op1_mixing_sources": mixing.op1_mixing_sources,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_sharding": sharding.op3_sharding,
    "op4_toxicity_weak_supervision": toxicity.op4_toxicity_weak_supervision,
    "op5_benchmark_decontamination": decontamination.op5_benchmark_decontamination,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_license_scans": license_scan.op7_license_scans,
    "op8_embedding_near_dedup": embedding_dedup.op8_embedding_near_dedup,
    "op9_ngram_jaccard_join": jaccard_join.op9_ngram_jaccard_join,
    "op10_html_extraction": html_text.op10_html_extraction,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
    "op13_secret_scans": secret_scan.op13_secret_scans,
}

ORACLES = {
    "op1_mixing_sources": mixing.OP1_SQL,
    "op5_benchmark_decontamination": decontamination.OP5_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op7_license_scans": license_scan.OP7_SQL,
    "op8_embedding_near_dedup": embedding_dedup.OP8_SQL,
    "op9_ngram_jaccard_join": jaccard_join.OP9_SQL,
    "op11_fill_in_middle": fill_in_middle.OP11_SQL,
    "op12_phrase_collocations": collocations.OP12_SQL,
    "op13_secret_scans": secret_scan.OP13_SQL,
}
