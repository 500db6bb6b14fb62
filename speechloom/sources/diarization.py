"""Diarized recordings to chunks, and the style of their clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom.functions.expr import strip
from speechloom.operators.ladders import is_non_latin, is_trash
from speechloom.sources.json_ranges import json_records

TURN = "struct<start:double,end:double,text:string,speaker:string>"
RECORD = f"struct<id:string,audio_url:string,diarization:array<{TURN}>,duration:double>"


def read_json(spark, path: str) -> DataFrame:
    """Records of JSON files whose root is a list or one object, read by byte range: (ordinal, id, audio_url, diarization,
    duration). ordinal counts over all files, so records without an id get names of their own."""
    r = F.from_json("record", RECORD)
    return json_records(spark, path).select(F.col("number").alias("ordinal"), r.alias("r")).select("ordinal", "r.*")


def record_id(given: Column, ordinal: Column) -> Column:
    """The id with characters that file names can't hold replaced; rec_1, rec_2, ... where there is none."""
    return F.regexp_replace(F.coalesce(given, F.concat(F.lit("rec_"), (ordinal + 1).cast("string"))), r'[\\/*?:"<>|]', "_")


def turns(records: DataFrame) -> DataFrame:
    """One row a turn, in order; records without an address are left out; a null text is an empty one."""
    rows = records.where(F.coalesce(F.trim("audio_url"), F.lit("")) != "").select(record_id(F.col("id"), F.col("ordinal")).alias("record_id"), "audio_url", F.posexplode("diarization").alias("pos", "t"))
    return rows.select("record_id", "audio_url", "pos", "t.start", "t.end", F.coalesce("t.text", F.lit("")).alias("text"), "t.speaker")


def plain_chunks(rows: DataFrame, min_seconds: float = 0.5, latin_only: bool = False) -> DataFrame:
    """Chunks numbered as the turns were: without trash and short ones (and, for one variant, without other scripts)."""
    keep = ~is_trash(F.col("text")) & (F.col("end") - F.col("start") >= min_seconds)
    keep = keep & ~is_non_latin(F.col("text")) if latin_only else keep
    name = F.concat("record_id", F.lit("_chunk" if latin_only else "_seg"), F.lpad(F.col("pos").cast("string"), 4, "0"), F.lit(".wav"))
    return rows.where(keep).select(name.alias("file_name"), "record_id", F.col("pos").alias("idx"), strip(F.col("text")).alias("transcription"), "speaker", "start", "end", F.bround(F.col("end") - F.col("start"), 3).alias("duration"))


def skip_counts(rows: DataFrame, min_seconds: float = 0.5) -> DataFrame:
    """How many turns each rule leaves out, the first that applies."""
    why = F.when(is_trash(F.col("text")), "skipped_trash").when(is_non_latin(F.col("text")), "skipped_nonlatin").when(F.col("end") - F.col("start") < min_seconds, "skipped_short").otherwise("kept")
    return rows.groupBy(why.alias("outcome")).agg(F.count("*").alias("n"))


def cleaned(rows: DataFrame) -> DataFrame:
    """Turns without trash and other scripts, numbered anew (idx)."""
    w = Window.partitionBy("record_id").orderBy("pos")
    return rows.where(~is_trash(F.col("text")) & ~is_non_latin(F.col("text"))).withColumn("idx", F.row_number().over(w) - 1)


def styles(clean: DataFrame) -> DataFrame:
    """(record_id, style): a clock that jumps back by over 5; one over 3600, perhaps in milliseconds; over 60; or a short clip."""
    w = Window.partitionBy("record_id").orderBy("idx")
    seen = clean.select("record_id", "start", "end", F.lag("end").over(w).alias("before"))
    facts = seen.groupBy("record_id").agg(F.bool_or(F.col("start") < F.col("before") - 5).alias("resets"), F.max("end").alias("most"))
    style = F.when(F.col("resets"), "has_resets").when(F.col("most") > 3600, "possibly_ms").when(F.col("most") > 60, "normal").otherwise("short_clip")
    return facts.select("record_id", style.alias("style"))


def chunks(rows: DataFrame, min_seconds: float = 0.4) -> DataFrame:
    """The main variant: cleaned first, numbered after cleaning, styled by record, short ones dropped last. Style and number come
    from one partitioning by record."""
    clean = cleaned(rows)
    by_record = Window.partitionBy("record_id")
    before = F.lag("end").over(by_record.orderBy("idx"))
    facts = clean.withColumn("_back", F.coalesce(F.col("start") < before - 5, F.lit(False))).withColumns({"_resets": F.max("_back").over(by_record), "_most": F.max("end").over(by_record)})
    style = F.when(F.col("_resets"), "has_resets").when(F.col("_most") > 3600, "possibly_ms").when(F.col("_most") > 60, "normal").otherwise("short_clip")
    name = F.concat("record_id", F.lit("_chunk"), F.lpad(F.col("idx").cast("string"), 4, "0"), F.lit(".wav"))
    kept = facts.where(F.col("end") - F.col("start") >= min_seconds)
    return kept.select(name.alias("file_name"), strip(F.col("text")).alias("transcription"), "speaker", "start", "end", (F.col("end") - F.col("start")).alias("duration"), "record_id", "idx", style.alias("style"), F.lit("v3_python_filter").alias("pipeline"))
