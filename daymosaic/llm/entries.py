"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, licenses, lm, mixing, simhash, tokenout, topk, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": decontam.query,
    "op2_token_output": tokenout.query,
    "op3_license_scan": licenses.query,
    "op4_exact_top_k": topk.query,
    "op5_language_id": langid.query,
    "op6_lm_scoring": lm.query,
    "op7_arc_to_warc": warc.query,
    "op8_simhash": simhash.query,
    "op9_source_mixing": mixing.query,
    "op10_toxicity": toxicity.query,
}
SQL: dict[str, str] = {
    "op1_benchmark_decontamination": decontam.SQL,
    "op4_exact_top_k": topk.SQL,
    "op7_arc_to_warc": warc.SQL,
    "op9_source_mixing": mixing.SQL,
}
