"""Queries of the corpus operators: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from hitlink.llm import divergence, licenses, line_dedup, merkle
from hitlink.llm.ann import op8_nearest_neighbours
from hitlink.llm.langid import op9_language_id
from hitlink.llm.mixing import op5_source_mix
from hitlink.llm.ngram_join import op1_ngram_jaccard_join
from hitlink.llm.nn_descent import op11_embedding_near_dedup
from hitlink.llm.packing import op3_packing
from hitlink.llm.pii import op6_pii
from hitlink.llm.quality import op7_quality_rules
from hitlink.llm.suffix_dedup import op10_suffix_dedup

QUERIES = {
    "op1_ngram_jaccard_join": (op1_ngram_jaccard_join, None),
    "op2_line_dedup": (line_dedup.op2_line_dedup, line_dedup.ORACLE),
    "op3_packing": (op3_packing, None),
    "op4_license_scan": (licenses.op4_license_scan, licenses.ORACLE),
    "op5_source_mix": (op5_source_mix, None),
    "op6_pii": (op6_pii, None),
    "op7_quality_rules": (op7_quality_rules, None),
    "op8_nearest_neighbours": (op8_nearest_neighbours, None),
    "op9_language_id": (op9_language_id, None),
    "op10_suffix_dedup": (op10_suffix_dedup, None),
    "op11_embedding_near_dedup": (op11_embedding_near_dedup, None),
    "op12_merkle_manifest": (merkle.op12_merkle_manifest, merkle.ORACLE),
    "op13_divergence_audit": (divergence.op13_divergence_audit, divergence.ORACLE),
}
