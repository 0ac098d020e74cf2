"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import jaccard, language, lines, media, mixing, packing, passages, quality, suffix, warc


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_suffix_dedup": suffix.op2_suffix_dedup,
        "op3_mpeg_audio": media.op3_mpeg_audio,
        "op4_source_mixing": mixing.op4_source_mixing,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_jaccard_join": jaccard.op6_jaccard_join,
        "op7_passage_dedup": passages.op7_passage_dedup,
        "op8_language_id": language.op8_language_id,
        "op9_line_dedup": lines.op9_line_dedup,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_source_mixing": mixing.SQL, "op5_quality_rules": quality.SQL, "op6_jaccard_join": jaccard.SQL, "op10_warc": warc.SQL}
