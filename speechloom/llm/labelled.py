"""Bounded samples of labelled rows, and the fold that is never learnt from."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechloom.llm.common import bound_batches, map_columns


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5. A null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fitting(docs: DataFrame, longest: int) -> DataFrame:
    """The ids of texts no longer than longest."""
    return docs.where(F.length(F.coalesce("text", F.lit(""))) <= longest).select("doc_id")


def labelled_ids(labels: DataFrame, column: str, value: int, rows: int, among: DataFrame | None = None) -> DataFrame:
    """At most rows ids with that label outside the held-out fold, out of those of among where given: those of the least hash.
    An id with several labels has the largest."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).alias("label"))
    ids = ids.where((F.col("label") == value) & ~held_out(F.col("doc_id")))
    if among is not None:
        ids = ids.join(among, "doc_id", "left_semi")
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id")


def texts_of(docs: DataFrame, ids: DataFrame, longest: int | None = None) -> DataFrame:
    """doc_id and text of those ids (a bounded set, so it is broadcast); a repeated id counts once, texts longer than longest,
    where given, don't."""
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if longest is not None:
        found = found.where(F.length("text") <= longest)
    return found.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))


def hash_sample(docs: DataFrame, rows: int, without: DataFrame) -> DataFrame:
    """About rows documents by hash of the id, without a bounded set of ids."""
    total = max(1, docs.count())
    share = min(1.0, rows / total)
    kept = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < round(share * (1 << 20)))
    return kept.join(F.broadcast(without), "doc_id", "left_anti")


def score_name(docs: DataFrame) -> str:
    """A name for one more column that none of docs has."""
    name = "_score"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def scorer(docs: DataFrame, score: Callable[[list[str]], list[float]], keep: bool) -> DataFrame:
    """doc_id and score of every row, or, with keep, every column of docs and _score."""
    bound_batches(docs.sparkSession)
    if not keep:
        kept = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        return map_columns(kept, "doc_id long, score double", lambda bs: ({"doc_id": b["doc_id"], "score": score(b["text"])} for b in bs))
    name = score_name(docs)
    # The rows go through whole, as they are: the score is one more column.
    def make(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            found = score([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(make, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def finish(found: DataFrame, docs: DataFrame, threshold: float, keep: bool, good: int) -> DataFrame:
    """The report of a classifier, or the rows it predicts as good (1 or 0) with the columns of docs."""
    if keep:
        passes = F.col(score_name(docs)) >= threshold
        return found.where(passes if good else ~passes).select(*[F.col(f"`{c}`") for c in docs.columns])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
