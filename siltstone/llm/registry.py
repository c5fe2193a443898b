"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, langid, licences, mixing, search, sharding, simhash, suffixes, toxicity, winnowing

_ALL = [
    sharding.op1_rendezvous_shards, simhash.op2_simhash_components, mixing.op3_mix_sources, search.op4_bm25_top_k,
    suffixes.op5_suffix_repeats, toxicity.op6_toxicity, winnowing.op7_winnowing, licences.op8_licence_digests,
    bpe.op9_byte_bpe, langid.op10_language_id, licences.licences_known,
]


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return licences.oracle_sql()
