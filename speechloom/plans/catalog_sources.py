"""Registered queries of sources at scale: tables are written in a source's form to the shared folder, and read back."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from speechloom.plans.catalog import Query, table
from speechloom.sources import diarization, files, json_ranges
from speechloom.sources.arrow_shards import read_shards, write_shards
from speechloom.sources.shared import scratch

if TYPE_CHECKING:
    import pyarrow as pa

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


@query("SELECT doc_id, lang, n_chars FROM documents")
def arrow_dataset(spark, sf_dir):
    """All documents as Arrow shards; three of their five columns read back."""
    write_shards(table(spark, sf_dir, "documents"), path := scratch(spark, "arrow"), 64 << 20)
    return read_shards(spark, path, ["doc_id", "lang", "n_chars"])


@query("SELECT doc_id, lang, md5(text) AS text FROM documents WHERE source > 'src1' AND n_chars >= 100")
def arrow_dataset_where(spark, sf_dir):
    """Conditions are met in the scan of the shards."""
    write_shards(table(spark, sf_dir, "documents"), path := scratch(spark, "arrow"), 64 << 20)
    rows = read_shards(spark, path, ["doc_id", "lang", "text"], [("source", ">", "src1"), ("n_chars", ">=", 100)])
    return rows.select("doc_id", "lang", F.md5("text").alias("text"))


def as_lists(rows, path: str) -> None:
    """JSON texts (a column), as a list in each file."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc

        some = False
        for b in batches:
            if b.num_rows:
                first = pa.array(["," if some or i else "[" for i in range(b.num_rows)])
                some = True
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(first, b.column(0), "")], names=["value"])
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

    rows.mapInArrow(lists, "value string").write.text(path)


@query(
    """SELECT 'c' || CAST(conv_id AS VARCHAR) AS record_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, md5(max(text)) AS last_text, CAST(max(turn) + 0.5 AS DOUBLE) AS ends
      FROM conversations GROUP BY conv_id"""
)
def json_list_records(spark, sf_dir):
    """Conversations as diarized recordings in JSON lists, read back by byte range."""
    turn = F.struct(F.col("turn").cast("double").alias("start"), (F.col("turn") + 0.5).alias("end"), "text", F.col("role").alias("speaker"))
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("diarization"))
    record = F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.lit("http://x").alias("audio_url"), "diarization")
    as_lists(own.select(F.to_json(record).alias("value")), path := scratch(spark, "json"))
    rows = diarization.turns(diarization.read_json(spark, path))
    return rows.groupBy("record_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.md5(F.max("text")).alias("last_text"), F.max("end").alias("ends"))


@query("SELECT 'http://x/' || CAST(doc_id AS VARCHAR) AS url, md5(text) AS text FROM documents")
def url_list_records(spark, sf_dir):
    """Documents as records of lists that tell their address, read back by byte range."""
    record = F.struct(F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")).alias("audio_url"), "text")
    as_lists(table(spark, sf_dir, "documents").select(F.to_json(record).alias("value")), path := scratch(spark, "json"))
    rows = files.read_url_lists(spark, path)
    return rows.select("url", F.md5(F.get_json_object("record", "$.text")).alias("text"))


@query("SELECT doc_id, md5(text) AS text, true AS in_place FROM documents")
def strict_json_lines(spark, sf_dir):
    """Documents as JSON lines that tell their own place in their file, read strictly: each must get that number."""
    place = (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1).alias("place")
    table(spark, sf_dir, "documents").select("doc_id", "text", place).write.json(path := scratch(spark, "lines"))
    rows = json_ranges.strict_rows(spark, path, "doc_id long, text string, place long")
    return rows.select("doc_id", F.md5("text").alias("text"), (F.col("number") == F.col("place")).alias("in_place"))
