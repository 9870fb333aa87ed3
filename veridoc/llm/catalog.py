"""The queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from veridoc.llm import bpe, chat, gam, minhash, mixing, qalsh, ring, rules, urls, warc

QUERIES = {
    "op1_gam_quality": gam.op1_gam_quality,
    "op2_hierarchical_mix": mixing.op2_hierarchical_mix,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_warc_revisits": warc.op4_warc_revisits,
    "op5_collision_counting_ann": qalsh.op5_collision_counting_ann,
    "op6_temporal_url_filter": urls.op6_temporal_url_filter,
    "op7_ring_bounded_load": ring.op7_ring_bounded_load,
    "op8_quality_rules": rules.op8_quality_rules,
    "op9_chat_prefix_target": chat.op9_chat_prefix_target,
    "op10_prob_minhash": minhash.op10_prob_minhash,
}
ORACLE = {
    "op2_hierarchical_mix": mixing.SQL,
    "op4_warc_revisits": warc.SQL,
    "op6_temporal_url_filter": urls.SQL,
    "op7_ring_bounded_load": ring.SQL,
    "op8_quality_rules": rules.SQL,
    "op9_chat_prefix_target": chat.SQL,
}
