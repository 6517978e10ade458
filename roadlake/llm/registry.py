"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from . import byte_cnn, collocations, decontaminate, divergence, hilbert_shards, language_fusion, metric_join, packing, quality_rules, secrets, simhash, toxicity, url_rules

QUERIES = {
    "op1_hilbert_shards": hilbert_shards.op1_hilbert_shards,
    "op2_harmonic_packing": packing.op2_harmonic_packing,
    "op3_bigru_toxicity": toxicity.op3_bigru_toxicity,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_byte_cnn": byte_cnn.op5_byte_cnn,
    "op6_cgk_decontamination": decontaminate.op6_cgk_decontamination,
    "op7_secret_battery": secrets.op7_secret_battery,
    "op8_simhash_pigeonring": simhash.op8_simhash_pigeonring,
    "op9_language_fusion": language_fusion.op9_language_fusion,
    "op10_url_rules": url_rules.op10_url_rules,
    "op11_metric_join": metric_join.op11_metric_join,
    "op12_tiled_collocations": collocations.op12_tiled_collocations,
    "op13_quadtree_divergence": divergence.op13_quadtree_divergence,
}

SQL = {
    "op4_quality_rules": quality_rules.SQL,
    "op10_url_rules": url_rules.SQL,
    "op11_metric_join": metric_join.SQL,
    "op12_tiled_collocations": collocations.SQL,
    "op13_quadtree_divergence": divergence.SQL,
}
