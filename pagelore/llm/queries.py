"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pagelore.llm import bpe, bwt, htmltext, langid, linedup, media, mixing, negatives, periodic, rlz, simhash, sketch, topk

QUERIES = {
    "op1_html_extraction": htmltext.op1,
    "op2_exact_topk": topk.op2,
    "op3_language_id": langid.op3,
    "op4_substring_dedup": rlz.op4,
    "op5_line_dedup": linedup.op5,
    "op6_byte_bpe": bpe.op6,
    "op7_media_columns": media.op7,
    "op8_suffix_dedup": bwt.op8,
    "op9_mixing": mixing.op9,
    "op10_simhash": simhash.op10,
    "op11_fingerprints": sketch.op11,
    "op12_hard_negatives": negatives.op12,
    "op13_periodic_runs": periodic.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_topk": topk.OP2_SQL,
    "op4_substring_dedup": rlz.OP4_SQL,
    "op5_line_dedup": linedup.OP5_SQL,
    "op9_mixing": mixing.sql(),
    "op12_hard_negatives": negatives.OP12_SQL,
}
