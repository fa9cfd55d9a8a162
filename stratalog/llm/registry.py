"""The queries of the subpackage, and their SQL where SQL can express them."""
from __future__ import annotations

from stratalog.llm import lang_id, licenses, mixing, near_dup, packing, quality, quotes, secrets, simhash, warc

QUERIES = {
    "op1_license_scan": licenses.query,
    "op2_quotation_linking": quotes.query,
    "op3_best_fit_packing": packing.query,
    "op4_quality_rules": quality.query,
    "op5_secret_scan": secrets.query,
    "op6_warc_chain": warc.query,
    "op7_language_id": lang_id.query,
    "op8_source_mixing": mixing.query,
    "op9_minhash_near_dedup": near_dup.query,
    "op10_simhash": simhash.query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": quality.ORACLE_SQL,
    "op6_warc_chain": warc.ORACLE_SQL,
    "op8_source_mixing": mixing.ORACLE_SQL,
    "op9_minhash_near_dedup": near_dup.ORACLE_SQL,
}
