"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from . import align, decontaminate, langid, lines, media, merkle, mixing, naming, near, repeats, shards, tokens, toxicity

QUERIES = {
    "op1_decontamination": decontaminate.query,
    "op2_sharding": shards.query,
    "op3_line_dedup": lines.query,
    "op4_toxicity": toxicity.query,
    "op5_media": media.query,
    "op6_suffix_dedup": repeats.query,
    "op7_token_counts": tokens.query,
    "op8_language_id": langid.query,
    "op9_mixing": mixing.query,
    "op10_near_dedup": near.query,
    "op11_merkle_manifest": merkle.query,
    "op12_exact_dedup": naming.query,
    "op13_token_alignment": align.query,
}
ORACLES = {
    "op1_decontamination": decontaminate.SQL,
    "op3_line_dedup": lines.SQL,
    "op9_mixing": mixing.SQL,
    "op10_near_dedup": near.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_exact_dedup": naming.SQL,
}
