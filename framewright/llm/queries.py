"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.common import read_table

#: name: (module, function, tables it takes)
_OPERATORS = {
    "op1_mpegts": ("mpegts", "media_features", ("documents",)),
    "op2_mixing": ("mixing", "mix_documents", ("documents",)),
    "op3_wrappers": ("wrappers", "extract", ("pages",)),
    "op4_quality": ("quality", "classify", ("documents", "labels")),
    "op5_licenses": ("licenses", "scan_licenses", ("documents",)),
    "op6_bloomlm": ("bloomlm", "score_documents", ("documents",)),
    "op7_decontaminate": ("decontaminate", "find_all_leaks", ("documents", "benchmark")),
    "op8_neardup": ("neardup", "components", ("documents",)),
    "op9_chat": ("chat", "format_all", ("conversations",)),
    "op10_kdshard": ("kdshard", "shard_documents", ("documents",)),
}


def _query(module: str, function: str, tables: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    operator = getattr(importlib.import_module(f"framewright.llm.{module}"), function)
    return lambda spark, sf_dir: operator(*(read_table(spark, sf_dir, t) for t in tables))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(*spec) for name, spec in _OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    from framewright.llm import oracles

    return {name: sql for name, sql in oracles.ORACLES.items() if name in _OPERATORS}
