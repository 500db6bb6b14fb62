"""The flagship query: diarized turns to styled, numbered chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from speechloom.plans.catalog import diarization_chunks


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diarization_chunks(spark, sf_dir)
