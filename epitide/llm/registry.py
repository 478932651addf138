"""The registered queries of this package: one opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from epitide.llm import queries as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": q.op1_fingerprints,
    "op2_byte_bpe": q.op2_byte_bpe,
    "op3_suffix_dedup": q.op3_suffix_dedup,
    "op4_neighbours": q.op4_neighbours,
    "op5_mixture": q.op5_mixture,
    "op6_quality": q.op6_quality,
    "op7_url_filter": q.op7_url_filter,
    "op8_ngram_join": q.op8_ngram_join,
    "op9_html_text": q.op9_html_text,
    "op10_toxicity": q.op10_toxicity,
    "op11_lexical_search": q.op11_lexical_search,
    "op12_token_alignment": q.op12_token_alignment,
    "op13_personal_data": q.op13_personal_data,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op7_url_filter": q.OP7_SQL,
    "op8_ngram_join": q.OP8_SQL,
    "op11_lexical_search": q.OP11_SQL,
}
