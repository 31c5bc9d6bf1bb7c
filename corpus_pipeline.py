"""The corpus pipeline: documents through quality rules, toxicity, near-dedup, decontamination and encoding.

All stages take null, empty and very long texts, null and repeated ids, repeated rows, empty tables and further columns of
any names; what becomes of each is said at the operator that a stage calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm import decontaminate, pieces, quality, simhash, toxicity
from lodeframe.llm.queries import tokenizer_path
from lodeframe.session import table
from lodeframe.storage import cut, holding, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the strict policy, with all their columns; null and empty texts have too few words."""
    return quality.kept(docs, quality.STRICT)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by the model learnt from this stage's labelled documents; without labels all stay."""
    return toxicity.kept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of every group of near copies (five words, similarity 0.8).

    Texts without words are copies of each other only; a null id comes after all others.
    """
    return simhash.near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark; without benchmark all stay."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's piece ids, with the proof that they decode to its text; an empty text has none."""
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL has neither XXH64 nor a stage that learns; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read by the next.

    Tables of a stage before go when the next has been written; the last kept one is read by the result.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        kept = cut(found, "stage")
        release(found, docs)
        docs = kept
    return holding(STAGES[-1][1](spark, docs, sf_dir), docs)
