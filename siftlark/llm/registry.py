"""Queries of the corpus operators, by number."""

from __future__ import annotations

from siftlark.llm import exact_dedup, minhash, mixing, packing, quality, sanitize, site_style, spelling, token_records, toxicity, url_lists, vector_codes, warc

QUERIES: dict = {
    "op1_packing": packing.query,
    "op2_mixing": mixing.query,
    "op3_site_style": site_style.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_minhash": minhash.query,
    "op6_toxicity": toxicity.query,
    "op7_token_records": token_records.query,
    "op8_warc": warc.query,
    "op9_url_lists": url_lists.query,
    "op10_quality_rules": quality.query,
    "op11_sanitize": sanitize.query,
    "op12_vector_codes": vector_codes.query,
    "op13_spelling_variants": spelling.query,
}
ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op9_url_lists": url_lists.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
