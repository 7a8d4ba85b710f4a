"""Registry of this subpackage's queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, fill_middle, line_dedup, maxscore, mixing, packing, phrases, quality_model, quality_rules, secret_scan, simhash, token_count, url_filter

_MODULES = (quality_rules, mixing, url_filter, chat, simhash, packing, maxscore, quality_model, line_dedup, secret_scan, token_count, phrases, fill_middle)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
