"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES = {
    "op1_recurrent_lm": "recurrent_lm",
    "op2_mixing": "mixing",
    "op3_private_data": "private_data",
    "op4_sentencepiece": "sentencepiece_lattice",
    "op5_html_extraction": "html_extraction",
    "op6_media_columns": "matroska",
    "op7_quality_rules": "quality_rules",
    "op8_jaccard_join": "jaccard_join",
    "op9_quality_classifier": "kneser_ney",
    "op10_suffix_dedup": "suffix_dedup",
    "op11_simhash": "simhash",
    "op12_spelling": "spelling",
    "op13_filter_audit": "filter_audit",
}

#: Those that SQL can express; their modules state it.
WITH_SQL = ["op13_filter_audit"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: import_module(f"{__package__}.{QUERIES[name]}").SQL for name in WITH_SQL}
