"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, chat, collocations, html_extract, line_dedup, media, minhash, mixing, packing, pii, quality_gam, quality_rules, warc

QUERIES = {
    "op1_near_duplicates": minhash.op1_near_duplicates,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_mixing": mixing.op3_mixing,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_html": html_extract.op5_html,
    "op6_quality": quality_gam.op6_quality,
    "op7_packing": packing.op7_packing,
    "op8_pii": pii.op8_pii,
    "op9_chat": chat.op9_chat,
    "op10_media": media.op10_media,
    "op11_warc": warc.op11_warc,
    "op12_alignment": alignment.op12_alignment,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op9_chat": chat.OP9_SQL,
    "op11_warc": warc.OP11_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
