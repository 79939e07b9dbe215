"""Queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from tidewell.llm import alignment, cap_filters, divergence, langid, lm_scoring, media, mixing, ngram_join, packing, secrets, sharding, toxicity, wavelet


def queries() -> dict:
    return {
        "op1_dominance_best_fit": packing.op1_dominance_best_fit,
        "op2_weak_supervision": toxicity.op2_weak_supervision,
        "op3_consistent_hash_shards": sharding.op3_consistent_hash_shards,
        "op4_byte_gru": langid.op4_byte_gru,
        "op5_flac_media": media.op5_flac_media,
        "op6_t_occurrence_join": ngram_join.op6_t_occurrence_join,
        "op7_trigram_secret_scan": secrets.op7_trigram_secret_scan,
        "op8_hierarchical_mix": mixing.op8_hierarchical_mix,
        "op9_spherical_caps": cap_filters.op9_spherical_caps,
        "op10_masked_pseudo_likelihood": lm_scoring.op10_masked_pseudo_likelihood,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_token_alignment": alignment.op12_token_alignment,
        "op13_wavelet_shards": wavelet.op13_wavelet_shards,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_hierarchical_mix": mixing.OP8_SQL, "op11_source_divergence": divergence.OP11_SQL}
