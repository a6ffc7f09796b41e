"""Queries of the corpus operators, each over its whole table, and their SQL where SQL can state them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from sourceloom.llm import (alignment, exact, html, licenses, lines, mixing, packing, simhash, spelling, spots, substrings, topk,
                            toxicity)
from sourceloom.llm.common import prepare

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _over(apply: Callable[..., DataFrame], *tables: str) -> Plan:
    return lambda spark, sf_dir: apply(*[_table(spark, sf_dir, t) for t in tables])


PLANS["op1_line_dedup"] = _over(lines.digest, "documents")
PLANS["op2_source_mixing"] = _over(mixing.digest, "documents")
PLANS["op3_packing"] = _over(packing.pack, "documents")
PLANS["op4_exact_dedup"] = _over(exact.digest, "documents")
PLANS["op5_spot_signatures"] = _over(spots.digest, "documents")
PLANS["op6_simhash_near_dedup"] = _over(simhash.digest, "documents")
PLANS["op7_license_scan"] = _over(licenses.licenses, "documents")
PLANS["op8_html_extraction"] = _over(html.extract, "pages")
PLANS["op9_substring_dedup"] = _over(substrings.digest, "documents")
PLANS["op10_toxicity"] = _over(toxicity.digest, "documents", "labels")
PLANS["op11_exact_top_k"] = _over(topk.digest, "embeddings")
PLANS["op12_spelling_variants"] = _over(spelling.digest, "documents")
PLANS["op13_tokenizer_alignment"] = _over(alignment.digest, "documents")
PLANS["pipeline"] = corpus_pipeline.run

ORACLES["op1_line_dedup"] = lines.SQL
ORACLES["op2_source_mixing"] = mixing.SQL
ORACLES["op4_exact_dedup"] = exact.SQL
ORACLES["op9_substring_dedup"] = substrings.SQL
ORACLES["op11_exact_top_k"] = topk.SQL
ORACLES["op12_spelling_variants"] = spelling.SQL
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
