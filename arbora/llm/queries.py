"""Queries and SQL of the operators in this subpackage."""

from arbora.llm import chat, crf, decontaminate, divergence, mixing, neardup, packing, repeats, rules, search, sharding, toxicity, urls

QUERIES = {
    "op1_sharding": sharding.digest,
    "op2_quality_rules": rules.digest,
    "op3_url_filters": urls.digest,
    "op4_suffix_array_dedup": repeats.digest,
    "op5_decontamination": decontaminate.digest,
    "op6_toxicity": toxicity.digest,
    "op7_near_duplicates": neardup.digest,
    "op8_chat_formatting": chat.digest,
    "op9_mixing": mixing.digest,
    "op10_quality_classifier": crf.digest,
    "op11_source_divergence": divergence.digest,
    "op12_ranked_search": search.digest,
    "op13_packing": packing.digest,
}

ORACLE_SQL = {
    "op1_sharding": sharding.SQL,
    "op2_quality_rules": rules.SQL,
    "op4_suffix_array_dedup": repeats.SQL,
    "op5_decontamination": decontaminate.SQL,
    "op7_near_duplicates": neardup.SQL,
    "op8_chat_formatting": chat.SQL,
    "op9_mixing": mixing.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_ranked_search": search.SQL,
}
