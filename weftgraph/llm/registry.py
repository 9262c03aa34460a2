"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import alignment, bytelevel, codes, fingerprints, licenses, media, mixing, pieces, sharding, simhash, tokens, toxicity, urls


def queries() -> dict:
    return {"op1_sentencepiece": pieces.op1_sentencepiece, "op2_mixing": mixing.op2_mixing, "op3_media": media.op3_media, "op4_token_ids": tokens.op4_token_ids, "op5_fingerprints": fingerprints.op5_fingerprints, "op6_url_filter": urls.op6_url_filter, "op7_license_scan": licenses.op7_license_scan, "op8_simhash": simhash.op8_simhash, "op9_toxicity": toxicity.op9_toxicity, "op10_sharding": sharding.op10_sharding, "op11_alignment": alignment.op11_alignment, "op12_byte_bpe": bytelevel.op12_byte_bpe, "op13_codes": codes.op13_codes}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.OP2_SQL, "op6_url_filter": urls.OP6_SQL, "op7_license_scan": licenses.OP7_SQL}
