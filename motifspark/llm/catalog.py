"""Registered queries of this subpackage, and SQL where SQL can express them."""

from motifspark.llm import centroid_clustering, decontamination, document_fingerprints, hard_negatives, html_extraction, jaccard_join, license_scans, quality_rules, secret_scans, sentencepiece_codec, url_filters, warc
from motifspark.llm.token_counts import op1_token_counts

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scans": license_scans.op2_license_scans,
    "op3_sentencepiece": sentencepiece_codec.op3_sentencepiece,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_secret_scans": secret_scans.op6_secret_scans,
    "op7_html_extraction": html_extraction.op7_html_extraction,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_url_filters": url_filters.op9_url_filters,
    "op10_warc": warc.op10_warc,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_centroid_clustering": centroid_clustering.op12_centroid_clustering,
    "op13_document_fingerprints": document_fingerprints.op13_document_fingerprints,
    # What SQL can express of operators whose method adds columns of its own.
    "license_phrases": license_scans.license_phrases,
    "quality_statistics": quality_rules.quality_statistics,
    "secret_base_spans": secret_scans.secret_base_spans,
}

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": jaccard_join.ORACLE_SQL,
    "op8_decontamination": decontamination.ORACLE_SQL,
    "op9_url_filters": url_filters.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_centroid_clustering": centroid_clustering.ORACLE_SQL,
    "op13_document_fingerprints": document_fingerprints.ORACLE_SQL,
    "license_phrases": license_scans.PHRASES_SQL,
    "quality_statistics": quality_rules.STATISTICS_SQL,
    "secret_base_spans": secret_scans.BASE_SQL,
}
