"""The queries on these operators, and the SQL of those that have one."""

from __future__ import annotations

from . import op1_langid, op2_topk, op3_quality, op4_mixing, op5_packing, op6_dedup, op7_secrets, op8_html, op9_urls, op10_spots

_ALL = {
    "op1_langid": op1_langid,
    "op2_topk": op2_topk,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_dedup": op6_dedup,
    "op7_secrets": op7_secrets,
    "op8_html": op8_html,
    "op9_urls": op9_urls,
    "op10_spots": op10_spots,
}


def queries() -> dict:
    return {name: module.query for name, module in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _ALL.items() if module.SQL}
