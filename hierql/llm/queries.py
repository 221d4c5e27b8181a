"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from . import chat_format, decontaminate, language_id, mixing, multiset_hash, ngram_join, token_rollup, toxicity, url_filter, warc

QUERIES = {
    "op1_prefix_target_chat": chat_format.op1_prefix_target_chat,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_multiset_fingerprint": multiset_hash.op3_multiset_fingerprint,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_language_id": language_id.op5_language_id,
    "op6_weighted_fair_mix": mixing.op6_weighted_fair_mix,
    "op7_warc": warc.op7_warc,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_token_rollup": token_rollup.op10_token_rollup,
}

SQL = {
    "op1_prefix_target_chat": chat_format.OP1_SQL,
    "op6_weighted_fair_mix": mixing.OP6_SQL,
    "op7_warc": warc.OP7_SQL,
    "op10_token_rollup": token_rollup.OP10_SQL,
}
