"""The corpus queries and their SQL, for the repository's entry module."""

from __future__ import annotations

from pathloom.llm import bpe, collocations, exact_dedup, filter_audit, fingerprint, mixing, near_dup, quality, rans, substring_dedup, toxicity, url_filter, warc_fixity

MODULES = [toxicity, substring_dedup, warc_fixity, near_dup, bpe, url_filter, mixing, exact_dedup, quality, fingerprint, filter_audit, collocations, rans]


def queries() -> dict:
    return {name: f for module in MODULES for name, f in vars(module).items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in getattr(module, "SQL", {}).items()}
