"""The corpus pipeline: quality rules, line dedup, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns of documents;
the last returns the pieces of the packed sequences. Null ids, null and empty texts, repeated rows and extra columns
are handled as the operators of the stages document it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtrace.llm import jaccard, lines, packing, quality, secrets
from bedtrace.llm.common import documents, labels
from bedtrace.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a risk-controlled cutoff rejects go."""
    return quality.judged(docs, labels(spark, sf_dir), docs.columns).filter("kept").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines leave the texts; a document that loses all its words that way goes."""
    out = lines.dedup_lines(docs).filter(~((F.col("lines_removed") > 0) & (F.translate("text", " \t\n\x0b\x0c\r", "") == "")))
    return measured(out, docs, F.col("lines_removed") > 0)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays, the one with the smallest id."""
    return jaccard.one_of_each(docs).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings are replaced by a mark."""
    return measured(secrets.redact_texts(docs), docs, F.lit(True))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def measured(out: DataFrame, docs: DataFrame, changed) -> DataFrame:
    """The columns of ``docs``, with n_chars (if it is there) of the new text."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed & F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_stage),
    ("secret_scans", secret_stage),
    ("packing", packing_stage),
]

# SQL cannot express the hashed line chunks and the token ids; each stage is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is written and read again by the next one."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
