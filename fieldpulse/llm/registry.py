"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import functools

from . import (bpe, chat, exact_dedup, importance, mixing, pieces, quality_rules, simhash, site_quality, substring,
               token_files, toxicity, whitening)
from .common import ship_package

MODULES = (exact_dedup, bpe, toxicity, substring, chat, quality_rules, mixing, token_files, site_quality, simhash,
           importance, whitening, pieces)


def _with_code(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)
    return run


def queries() -> dict:
    return {n: _with_code(f) for m in MODULES for n, f in vars(m).items() if n.startswith("op") and n[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "ORACLE", {}).items()}
