"""Queries op1 to op10 and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, licences, lm, neardup, packing, quality, sharding, topk, urlfilter, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_licence_scan": licences.op3_licence_scan,
    "op4_warc": warc.op4_warc,
    "op5_url_filter": urlfilter.op5_url_filter,
    "op6_near_duplicates": neardup.op6_near_duplicates,
    "op7_kd_tree_shards": sharding.op7_kd_tree_shards,
    "op8_quality": quality.op8_quality,
    "op9_exact_top_k": topk.op9_exact_top_k,
    "op10_log_bilinear": lm.op10_log_bilinear,
}
ORACLES = {
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op3_licence_scan": licences.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op6_near_duplicates": neardup.OP6_SQL,
    "op9_exact_top_k": topk.OP9_SQL,
}
