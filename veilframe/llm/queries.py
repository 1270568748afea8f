"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import chat, chosen_path, curriculum, iblt, infill, pieces, pii, quality, rans, seeds, suffixes, sweep, urlrules


def queries() -> dict:
    return {
        "op1_ngram_join": chosen_path.op1_ngram_join,
        "op2_rans_tokens": rans.op2_rans_tokens,
        "op3_sentencepiece": pieces.op3_sentencepiece,
        "op4_chat_formatting": chat.op4_chat_formatting,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_url_filters": urlrules.op6_url_filters,
        "op7_iblt_fingerprints": iblt.op7_iblt_fingerprints,
        "op8_suffix_dedup": suffixes.op8_suffix_dedup,
        "op9_curriculum": curriculum.op9_curriculum,
        "op10_pii": pii.op10_pii,
        "op11_fill_in_middle": infill.op11_fill_in_middle,
        "op12_peak_concurrency": sweep.op12_peak_concurrency,
        "op13_substring_dedup": seeds.op13_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filters": urlrules.OP6_SQL, "op9_curriculum": curriculum.OP9_SQL, "op11_fill_in_middle": infill.OP11_SQL, "op12_peak_concurrency": sweep.OP12_SQL, "op13_substring_dedup": seeds.OP13_SQL}
