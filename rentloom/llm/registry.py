"""The corpus queries, one per operator, with SQL where SQL can express them."""

from __future__ import annotations

from rentloom.llm import avi_mjpeg, byte_bpe, decontamination, exact_dedup, filter_audit, jaccard_join, line_dedup, packing, phrases, quality, secret_scan, substring_dedup, toxicity

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_avi_mjpeg": avi_mjpeg.op2_avi_mjpeg,
    "media_clips": avi_mjpeg.media_clips,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op4_line_dedup_words": line_dedup.op4_line_dedup_words,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_suffix_dedup": substring_dedup.op6_suffix_dedup,
    "op7_ngram_jaccard_join": jaccard_join.op7_ngram_jaccard_join,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "exact_groups": exact_dedup.exact_groups,
    "op9_harmonic_packing": packing.op9_harmonic_packing,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_phrase_collocations": phrases.op12_phrase_collocations,
    "op13_benchmark_decontamination": decontamination.op13_benchmark_decontamination,
}
ORACLE = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op4_line_dedup_words": line_dedup.ORACLE_WORDS,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "exact_groups": exact_dedup.ORACLE_GROUPS,
    "op10_secret_scan": secret_scan.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_phrase_collocations": phrases.ORACLE,
    "op13_benchmark_decontamination": decontamination.ORACLE,
}
