"""The queries of the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, fill_middle, html_text, lattice, line_dedup, mixing, ngram_join, pii, quality, suffix_dedup, telephony, toxicity, vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        telephony.op1_telephony_audio,
        ngram_join.op2_ngram_jaccard_join,
        quality.op3_quality_ordinal,
        html_text.op4_html_main_text,
        lattice.op5_lattice_near_dedup,
        bpe.op6_bpe,
        pii.op7_pii_weak_supervision,
        suffix_dedup.op8_suffix_array_dedup,
        mixing.op9_mix_sources,
        toxicity.op10_toxicity,
        line_dedup.op11_line_dedup,
        vector_codes.op12_vector_codes,
        fill_middle.op13_fill_in_middle,
    )
}
SQL: dict[str, str] = {"op11_line_dedup": line_dedup.SQL, "op12_vector_codes": vector_codes.SQL, "op13_fill_in_middle": fill_middle.SQL}
