"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import centroid_clusters, exact_dedup, license_scan, line_dedup, url_filter, vector_codes
from .byte_bpe import op8_byte_bpe
from .decontaminate import op9_decontaminate
from .jaccard_join import op2_jaccard_join
from .pii import op7_pii
from .quality_classifier import op4_quality_classifier
from .quality_rules import op1_quality_rules
from .secret_scan import op10_secret_scan

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_pii": op7_pii,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_decontaminate": op9_decontaminate,
    "op10_secret_scan": op10_secret_scan,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_centroid_clusters": centroid_clusters.op13_centroid_clusters,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op5_license_scan": license_scan.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op11_exact_dedup": exact_dedup.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_centroid_clusters": centroid_clusters.ORACLE,
}
