"""The queries of the operators, by name, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from vigil.llm import (
    conversations,
    factors,
    fingerprint,
    langid,
    mixing,
    negatives,
    packing,
    quality,
    simhash,
    substring,
    suffix,
    tokenfile,
    urlfilter,
)

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_substring": substring.op2_substring,
    "op3_fingerprint": fingerprint.op3_fingerprint,
    "op4_simhash": simhash.op4_simhash,
    "op5_suffix_array": suffix.op5_suffix_array,
    "op6_url_filter": urlfilter.op6_url_filter,
    "op7_language": langid.op7_language,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_token_files": tokenfile.op9_token_files,
    "op10_mixing": mixing.op10_mixing,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_quality_classifier": factors.op13_quality_classifier,
}

ORACLE_SQL = {
    "op6_url_filter": urlfilter.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
    "op12_hard_negatives": negatives.ORACLE_SQL,
}
