"""The corpus pipeline: quality, toxicity, near-duplicates, packing, each over all that the stage before has kept.

All stages read a null text as an empty one, take whole texts of any length, keep the columns of documents whatever others
they have, and give an empty table for an empty one. The classifiers judge a row by its text alone, so repeated rows share
their fate; with too few labels they keep every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from speechloom.llm import near_dup, packing, quality, toxicity
from speechloom.llm.common import table, written
from speechloom.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score at least 0.3); an empty text is scored like any other."""
    return quality.scored(docs, table(spark, sf_dir, "labels"), threshold=0.3, keep=True)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject (score under 0.5); a text without words isn't toxic."""
    return toxicity.scored(docs, table(spark, sf_dir, "labels"), threshold=0.5, keep=True)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the least doc_id, those without one last. Texts without words are
    of one class only with equal ones; of repeated rows one stays."""
    return near_dup.deduplicated(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, in sequences of 2048 tokens; an empty text is one piece, its end id."""
    return packing.packed(docs, tokenizer("word_bpe_49k.json"), end_id=1, length=2048)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_dup", near_dup_stage), ("packing", packing_stage)]

#: No stage but the exact part of near_dup can be put in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all that the stages keep of the table documents; each stage's rows are written, and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
