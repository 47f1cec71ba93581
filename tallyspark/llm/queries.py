"""The queries of this subpackage for __spark_entry__.py, and their SQL where SQL can express them."""

from __future__ import annotations

from . import attribution, bpe, crosswalk, infill, lines, mixing, mpeg, packing, quality, recurrent, simhash, substrings, toxicity


def queries():
    return {
        "op1_toxicity": toxicity.op1,
        "op2_byte_bpe": bpe.op2,
        "op3_packing": packing.op3,
        "op4_substring_dedup": substrings.op4,
        "op5_recurrent_lm": recurrent.op5,
        "op6_mpeg_audio": mpeg.op6,
        "op7_simhash": simhash.op7,
        "op8_line_dedup": lines.op8,
        "op9_quality_rules": quality.op9,
        "op10_section_tokens": attribution.op10,
        "op11_infill": infill.op11,
        "op12_crosswalk": crosswalk.op12,
        "op13_mixing": mixing.op13,
    }


def oracle_sql():
    """Hashes, tokenizers, learned models and media are beyond SQL; tests compare those queries with brute force."""
    return {"op4_substring_dedup": substrings.SQL, "op8_line_dedup": lines.SQL, "op9_quality_rules": quality.SQL, "op11_infill": infill.SQL}
