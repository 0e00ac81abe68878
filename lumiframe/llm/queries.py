"""The training-data queries and their oracle SQL, by name."""

from __future__ import annotations

from lumiframe.llm import ann, conversation, decontaminate, forest, html_extract, language_id, packing, secret_scan, simhash, spelling, substring_dedup, tokens, toxicity


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_token_counts": tokens.op2_token_counts,
        "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_packing": packing.op5_packing,
        "op6_html_extraction": html_extract.op6_html_extraction,
        "op7_ann": ann.op7_ann,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_secret_scan": secret_scan.op10_secret_scan,
        "op11_conversation_repair": conversation.op11_conversation_repair,
        "op12_minhash_near_dedup": forest.op12_minhash_near_dedup,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_ann": ann.oracle_sql(),
        "op8_substring_dedup": substring_dedup.oracle_sql(),
        "op10_secret_scan": secret_scan.oracle_sql(),
        "op11_conversation_repair": conversation.oracle_sql(),
        "op12_minhash_near_dedup": forest.oracle_sql(),
        "op13_spelling_variants": spelling.oracle_sql(),
    }
