"""Registry of the reference operators' queries; each module gives QUERIES and ORACLES."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODULES = (
    "operators.frame_queries", "functions.time_queries", "operators.audio_queries", "plans.segment_queries",
    "plans.decision_queries", "sources.parser_queries", "streaming.job_queries",
)

#: Columns that sum or scale doubles: the order of summation shows in their last bits, so results
#: and oracles carry them to nine decimals.
ROUNDED = {
    "frame_diffs": ("luma", "histogram", "edge", "mad", "score"), "shot_statistics": ("median_seconds",), "frame_times": ("seconds",), "grain": ("sigma", "confidence", "strength", "forced"), "grain_planes": ("sigma", "confidence"), "warped": ("value",),
    "time_instants": ("span",), "audio_chunks": ("ms", "peak_dbfs"), "audio_programme": ("programme", "lra"), "audio_speech": ("threshold_db", "smooth"),
    "audio_remaster": ("speech_ratio", "median_snr", "confidence", "programme", "dialogue", "ldr", "gain_db", "duck_db", "ldr_after", "gain"), "audio_curve": ("gain_db", "duck_db", "gain"),
    "audio_weighted": ("filtered",), "audio_speech_levels": ("speech_db",), "audio_downmix": ("mono", "right"), "audio_roles": ("out",), "segment_progress": ("fraction",), "cadence": ("confidence", "combing"),
    "cadence_points": ("at",), "job_progress": ("fraction", "eta"), "manifests": ("content",), "stage_views": ("fraction", "overall"),
}

#: Decimals of the queries whose exact values end in a 5 at the ninth.
DIGITS = {"audio_chunks": 12}


def _modules():
    return [importlib.import_module(f"framewright.{name}") for name in MODULES]


def _rounded(name: str, query: Callable) -> Callable:
    digits = DIGITS.get(name, 9)
    return lambda spark, sf_dir: query(spark, sf_dir).withColumns({c: F.round(c, digits) + 0.0 for c in ROUNDED[name]})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for module in _modules():
        found |= module.QUERIES
    return {name: _rounded(name, q) if name in ROUNDED else q for name, q in found.items()}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        found |= module.ORACLES
    for name, columns in ROUNDED.items():
        replaced = ", ".join(f'round("{c}", {DIGITS.get(name, 9)}) + 0.0::DOUBLE AS "{c}"' for c in columns)
        found[name] = f"SELECT * REPLACE ({replaced}) FROM ({found[name]})"
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next(iter(queries().values()))(spark, sf_dir)
