"""The queries of this subpackage, by name, with SQL for those that it can express."""

from __future__ import annotations

from . import byte_bpe, decontaminate, divergence, language_id, oracles, orc_tokens, order_minhash, quality_mil, quality_rules, ranked_search, sharding, suffix_dedup, url_filters, warc

QUERIES = {
    "op1_order_minhash": order_minhash.op1_order_minhash,
    "op2_orc_tokens": orc_tokens.op2_orc_tokens,
    "op3_rendezvous": sharding.op3_rendezvous,
    "op4_quality_mil": quality_mil.op4_quality_mil,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_warc": warc.op6_warc,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_url_filters": url_filters.op11_url_filters,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}
ORACLE_SQL = {
    "op3_rendezvous": oracles.rendezvous_sql(),
    "op6_warc": warc.OP6_SQL,
    "op8_suffix_dedup": oracles.SUFFIX_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
    "op11_url_filters": url_filters.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_ranked_search": ranked_search.OP13_SQL,
}
