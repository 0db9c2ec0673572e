"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import bitplane, langid, licenses, mixing, pieces, quality, sharding, simhash, token_lengths, topk

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_sharding": sharding.op3_sharding,
    "op4_langid": langid.op4_langid,
    "op5_token_counts": token_lengths.op5_token_counts,
    "op6_quality": quality.op6_quality,
    "op7_mixing": mixing.op7_mixing,
    "op8_simhash": simhash.op8_simhash,
    "op9_licenses": licenses.op9_licenses,
    "op10_bitplane": bitplane.op10_bitplane,
}

SQL = {"op1_topk": topk.OP1_SQL, "op6_quality": quality.OP6_SQL, "op7_mixing": mixing.OP7_SQL}
