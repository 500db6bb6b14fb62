"""Spans over tables of frame levels: speech between silences, cut into segments, without a waveform or a task per recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a recording that one task joins at first.
CHUNK = 1 << 12


def islands(marks: DataFrame, series: str, at: str, gap: int, chunk: int = CHUNK) -> DataFrame:
    """(series, begin, end): marks (whole numbers, at) that lie less than gap apart, as spans, end exclusive.

    A stretch of each series is joined by itself, then what is left of the stretches, a row a span; so a series of any length
    is dealt to many tasks, and only its spans, which are at least gap apart or at a border, meet in one.
    """

    def joined(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("begin")
        new = F.coalesce(F.col("begin") - F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) >= gap, F.lit(True))
        numbered = rows.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w))
        return numbered.groupBy(*by, "_run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_run")

    points = marks.where(F.col(at).isNotNull()).select(series, F.col(at).alias("begin"), (F.col(at) + 1).alias("end"), F.floor(F.col(at) / chunk).alias("_chunk"))
    return joined(joined(points, series, "_chunk").drop("_chunk"), series)


def speech(levels: DataFrame, series: str, at: str, loud: Column, min_silence: int, keep: int, chunk: int = CHUNK) -> DataFrame:
    """(series, frames, begin, end): what lies between silences of at least min_silence frames, with keep frames of these on
    both sides. A frame that is missing or has no level is silent; a series without a loud frame has one row without a span."""
    frames = levels.groupBy(series).agg((F.max(at) + 1).alias("frames")).withColumnRenamed(series, "_s")
    found = islands(levels.where(F.coalesce(loud, F.lit(False))), series, at, min_silence, chunk)
    both = frames.join(found, F.col("_s").eqNullSafe(F.col(series)), "left")
    some = F.col("begin").isNotNull()
    begin, end = F.greatest(F.col("begin") - keep, F.lit(0)), F.least(F.col("end") + keep, F.col("frames"))
    return both.select(F.col("_s").alias(series), "frames", F.when(some, begin).alias("begin"), F.when(some, end).alias("end"))


def segments(spans: DataFrame, series: str, shortest: int, longest: int) -> DataFrame:
    """(series, segment, begin, end): nothing of a short recording, all of a middling one, else its spans, cut hard at longest,
    without what is short then; numbered from 1."""
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("frames").cast("long").alias("end")))
    last = F.floor((F.col("end") - F.col("begin") - 1) / longest)
    pieces = F.transform(
        F.sequence(F.lit(0).cast("long"), last), lambda i: F.struct((F.col("begin") + i * longest).alias("begin"), F.least(F.col("end"), F.col("begin") + (i + 1) * longest).alias("end"))
    )
    # A middling recording counts once, whatever the number of its spans.
    middling = spans.where(F.col("frames").between(shortest, longest)).select(series, "frames").distinct().select(series, F.explode(whole).alias("p"))
    long = spans.where((F.col("frames") > longest) & F.col("begin").isNotNull()).select(series, F.explode(pieces).alias("p"))
    kept = middling.unionByName(long).select(series, "p.*").where(F.col("end") - F.col("begin") >= shortest)
    number = F.row_number().over(Window.partitionBy(series).orderBy("begin"))
    return kept.select(series, number.alias("segment"), "begin", "end")
