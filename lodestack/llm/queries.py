"""The registered queries of this package and, where SQL can express one, its oracle SQL."""

from __future__ import annotations

from lodestack.llm import langid, line_dedup, media, ngram_join, packing, pieces, quality, sharding, suffix_dedup, toxicity

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_packing": packing.op2_packing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_pieces": pieces.op5_pieces,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_media": media.op7_media,
    "op8_sharding": sharding.op8_sharding,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_quality": quality.op10_quality,
}
ORACLES = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op8_sharding": sharding.ORACLE,
    "op10_quality": quality.ORACLE,
}
