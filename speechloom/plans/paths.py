"""Path 1 (transcribe, polish, compare), path 2 (transcribe and score by a model), path 3 (diarized records)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.functions.expr import blank, let
from speechloom.functions.similarity import change_ratio
from speechloom.operators import ladders
from speechloom.operators.ladders import AudioLimits, TextLimits
from speechloom.operators.normalise import Normaliser, normalised_text
from speechloom.operators.polish import Polisher, polished
from speechloom.sources import diarization


def path1(segments: DataFrame, raw: str = "raw_text", audio: AudioLimits = AudioLimits(snr_min=0.0), text: TextLimits = ladders.PATH1_TEXT, polish: Polisher = Polisher(), words_min: int = 3) -> DataFrame:
    """segments: file_name, duration, snr_score, silence_ratio and the raw transcript. Cheap rules run first; texts of rows that
    they rule out are never polished (they are null there)."""
    col = F.col
    first = F.coalesce(ladders.audio_reason(col("duration"), col("snr_score"), col("silence_ratio"), audio), ladders.text_reason(col(raw), text))
    rows = segments.withColumn("_first", first)
    rows = polished(rows.withColumn("_raw", F.when(col("_first").isNull(), col(raw))), "_raw", "_polished", polish)

    # One struct, each part of it bound once: a filter on one of its fields then repeats no more than this expression.
    def judged(t: Column) -> Column:
        return let(F.coalesce("_first", ladders.validity_reason(t, words_min, check_cyrillic=True)), lambda why: compared(t, why))

    def compared(t: Column, why: Column) -> Column:
        return let(F.when(why.isNull(), change_ratio(col("_raw"), t)), lambda ratio: outcome(t, why, ratio))

    def outcome(t: Column, why: Column, ratio: Column) -> Column:
        status = F.when(why.isNotNull(), "filtered").otherwise(ladders.status_of_change(ratio))
        shown = F.when(why.isNull(), ladders.text_after_change(ratio, col("_raw"), t))
        return F.struct(status.alias("status"), why.alias("reason"), ratio.alias("change_ratio"), shown.alias("transcription"))

    rows = rows.withColumn("_out", let(F.when(blank(col("_polished")), col("_raw")).otherwise(col("_polished")), judged))
    names = ("status", "reason", "change_ratio", "transcription")
    return rows.withColumns({n: col("_out")[n] for n in names} | {"original_text": col(raw), "pipeline": F.lit("aisha_stt")}).drop("_first", "_raw", "_polished", "_out", raw)


def path2(segments: DataFrame, raw: str = "raw_text", answer: str = "score_answer", audio: AudioLimits = AudioLimits(snr_min=0.0, silence_max=70.0), text: TextLimits = ladders.PATH2_TEXT, approve_min: int = 3, reject_max: int = 2) -> DataFrame:
    """segments: also the scoring model's answer."""
    col = F.col
    reason = F.coalesce(ladders.audio_reason(col("duration"), col("snr_score"), col("silence_ratio"), audio), ladders.text_reason(col(raw), text))
    rows = segments.withColumn("reason", reason).withColumn("gemini_score", F.when(col("reason").isNull(), ladders.parsed_score(col(answer))))
    status = F.when(col("reason").isNotNull(), "filtered").otherwise(ladders.status_of_score(col("gemini_score"), approve_min, reject_max))
    return rows.withColumns({"status": status, "transcription": col(raw), "original_text": col(raw), "pipeline": F.lit("gemini_stt")}).drop(raw, answer)


def normalised_results(results: DataFrame, on: Normaliser = Normaliser()) -> DataFrame:
    """The last stage: rows that aren't filtered and have a text are normalised, and filtered where that drops them."""

    def redone(s: Column) -> Column:
        applies = (s["status"] != "filtered") & ~blank(s["text"])
        return let(F.when(applies, normalised_text(s["text"], on)), lambda n: F.struct(F.when(applies, n["t"]).otherwise(s["text"]).alias("text"), F.when(applies, n["why"]).alias("why")))

    rows = results.withColumn("_out", let(F.struct("status", F.col("transcription").alias("text")), redone))
    dropped = F.col("_out")["why"].isNotNull()
    return rows.withColumns({"transcription": F.col("_out")["text"], "status": F.when(dropped, "filtered").otherwise(F.col("status")), "reason": F.when(dropped, F.col("_out")["why"]).otherwise(F.col("reason"))}).drop("_out")


def path3(turns: DataFrame, min_seconds: float = 0.4) -> DataFrame:
    return diarization.chunks(turns, min_seconds)


def status_counts(results: DataFrame) -> DataFrame:
    """(pipeline, total, approved, pending, rejected, filtered, saved) in one pass."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    saved = F.count_if(ladders.exportable(F.col("status"), F.col("transcription"))).alias("saved")
    return results.groupBy("pipeline").agg(F.count("*").alias("total"), n("approved"), n("pending"), n("rejected"), n("filtered"), saved)


def run_report(results: DataFrame) -> DataFrame:
    """One JSON row: the counts of every path, and the hours they hold."""
    return status_counts(results).agg(F.to_json(F.sort_array(F.collect_list(F.struct("pipeline", "total", "approved", "pending", "rejected", "filtered", "saved")))).alias("report"))
