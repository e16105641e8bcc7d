"""Named queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from bedtrace.llm import exact, jaccard, langid, lines, packing, phrases, pieces, pii, quality, secrets, tokens, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact.op1_exact_dedup,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_packing": packing.op5_packing,
    "op6_language_id": langid.op6_language_id,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_secret_scans": secrets.op8_secret_scans,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_pii": pii.op11_pii,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_collocations": phrases.op13_collocations,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": exact.OP1_SQL,
    "op10_quality_rules": quality.OP10_SQL,
    "op13_collocations": phrases.OP13_SQL,
}
