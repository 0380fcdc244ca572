"""Queries and oracle SQL of the operators, for the driver contract."""

from __future__ import annotations

from funnelworks.llm import (
    centroids,
    chat,
    decontaminate,
    html,
    importance,
    katz,
    language,
    near,
    packing,
    secrets,
    sketch,
    substrings,
    training_order,
)

QUERIES = {
    "op1_ppm_language": language.op1_ppm_language,
    "op2_scaled_sketch": sketch.op2_scaled_sketch,
    "op3_secret_ledger": secrets.op3_secret_ledger,
    "op4_training_order": training_order.op4_training_order,
    "op5_style_tree": html.op5_style_tree,
    "op6_power_of_two": packing.op6_power_of_two,
    "op7_template_windows": decontaminate.op7_template_windows,
    "op8_weighted_minhash": near.op8_weighted_minhash,
    "op9_seed_extend": substrings.op9_seed_extend,
    "op10_chat_format": chat.op10_chat_format,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_katz_backoff": katz.op12_katz_backoff,
    "op13_ptolemaic_pivots": centroids.op13_ptolemaic_pivots,
}

ORACLE_SQL = {
    "op2_scaled_sketch": sketch.OP2_SQL,
    "op3_secret_ledger": secrets.OP3_SQL,
    "op7_template_windows": decontaminate.OP7_SQL,
    "op9_seed_extend": substrings.OP9_SQL,
    "op10_chat_format": chat.OP10_SQL,
    "op11_importance_resampling": importance.OP11_SQL,
    "op13_ptolemaic_pivots": centroids.OP13_SQL,
}
