"""The registered queries of this subpackage and their SQL forms."""

from __future__ import annotations

from . import align, decontam, exact, langid, licenses, lines, lm, mixing, negatives, simhash, tokens, toxicity, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_language_id": langid.op2_language_id,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_warc_derivatives": warc.op4_warc_derivatives,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_decontaminate": decontam.op6_decontaminate,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_simhash_near_duplicates": simhash.op9_simhash_near_duplicates,
    "op10_exact_duplicates": exact.op10_exact_duplicates,
    "op11_lm_scores": lm.op11_lm_scores,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_token_alignment": align.op13_token_alignment,
}
SQL = {"op1_mix_sources": mixing.ORACLE, "op3_line_dedup": lines.ORACLE, "op10_exact_duplicates": exact.ORACLE, "op12_hard_negatives": negatives.ORACLE}
