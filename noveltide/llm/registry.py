"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from noveltide.llm import conversations, decontaminate, fingerprint, jaccard_join, license_scan, line_dedup, packing, quality, suffix_dedup, token_counts, toxicity, warc, whitening

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_packing": packing.op7_packing,
    "op8_fingerprints": fingerprint.op8_fingerprints,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_whitening": whitening.op11_whitening,
    "op12_conversations": conversations.op12_conversations,
    "op13_quality": quality.op13_quality,
}
ORACLES = {**warc.ORACLES, **license_scan.ORACLES, **decontaminate.ORACLES, **line_dedup.ORACLES, **conversations.ORACLES}
