"""The driver queries of the ten operators, and the SQL of those that SQL expresses."""

from __future__ import annotations

from larkspur.llm import fingerprint, html, lm, media, mixing, neardup, packing, quality, toxicity, training_order

QUERIES = {
    "op1_html": html.op1_html,
    "op2_neardup": neardup.op2_neardup,
    "op3_mixing": mixing.op3_mixing,
    "op4_lm": lm.op4_lm,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_packing": packing.op6_packing,
    "op7_quality": quality.op7_quality,
    "op8_media": media.op8_media,
    "op9_fingerprint": fingerprint.op9_fingerprint,
    "op10_training_order": training_order.op10_training_order,
}
SQL = {
    "op2_neardup": neardup.SQL,
    "op3_mixing": mixing.SQL,
}
