"""All queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import ann, bpe, chat_format, html_extract, license_scan, packing, quality_rules, secret_scan, simhash_dedup, substring_dedup

MODULES = (ann, bpe, chat_format, html_extract, license_scan, packing, quality_rules, secret_scan, simhash_dedup, substring_dedup)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
