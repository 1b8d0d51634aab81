"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from clusterloom.llm import chat_format, decontaminate, hard_negatives, host_rules, html_extract, ranked_groups, simhash, source_mix, subword_quality, suffix_tree, token_store, toxic_compression, url_filter


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_html_extract": html_extract.op1_html_extract,
        "op2_source_mix": source_mix.op2_source_mix,
        "op3_chat_format": chat_format.op3_chat_format,
        "op4_token_store": token_store.op4_token_store,
        "op5_simhash": simhash.op5_simhash,
        "op6_toxic_compression": toxic_compression.op6_toxic_compression,
        "op7_subword_quality": subword_quality.op7_subword_quality,
        "op8_host_rules": host_rules.op8_host_rules,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_suffix_tree": suffix_tree.op12_suffix_tree,
        "op13_ranked_groups": ranked_groups.op13_ranked_groups,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op2_source_mix": source_mix.OP2_SQL, "op8_host_rules": host_rules.OP8_SQL, "op11_hard_negatives": hard_negatives.OP11_SQL, "op13_ranked_groups": ranked_groups.OP13_SQL}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
