"""Human review: a log of decisions, merged into segments; counts; what is saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.functions.expr import blank
from speechloom.operators.dataset import last_rows


def decided(log: DataFrame) -> DataFrame:
    """The last decision of each file: log is (file_name, decision, edited_text, seq)."""
    return last_rows(log.select("file_name", "decision", "edited_text", "seq"), "file_name", "seq").select("file_name", "decision", "edited_text")


def decision_of(edited: Column, original: Column) -> Column:
    """Approving with another text is an edit."""
    return F.when(~blank(edited) & (edited != F.coalesce(original, F.lit(""))), "edited").otherwise("approved")


def merged(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every segment with its decision (pending where there is none) and its text: edited, else transcribed, else original."""
    text = F.coalesce(F.when(~blank(F.col("edited_text")), F.col("edited_text")), F.when(~blank(F.col("transcription")), F.col("transcription")), F.col("original_text"))
    out = segments.join(decisions, "file_name", "left")
    return out.withColumns({"decision": F.coalesce("decision", F.lit("pending")), "text": text})


def saved(reviewed: DataFrame) -> DataFrame:
    """All but rejected rows; pending ones stay."""
    return reviewed.where("decision <> 'rejected'")


def stats(reviewed: DataFrame) -> DataFrame:
    """total, approved (edits included), edited, rejected, pending, and the percentage that is decided."""
    n = lambda *d: F.count_if(F.col("decision").isin(*d))
    out = reviewed.agg(F.count("*").alias("total"), n("approved", "edited").alias("approved"), n("edited").alias("edited"), n("rejected").alias("rejected"))
    pending = F.col("total") - F.col("approved") - F.col("rejected")
    done = F.coalesce(F.try_divide((F.col("approved") + F.col("rejected")) * 100, F.col("total")), F.lit(0.0))
    return out.withColumns({"pending": pending, "percent": F.bround(done, 1)})


def cursor(position: Column, step: int, total: Column) -> Column:
    """The place after a step, held inside the list."""
    return F.greatest(F.lit(0), F.least(total - 1, position + step))


def percent(done: Column, total: Column, finished: Column | None = None) -> Column:
    """Whole percent done; of nothing to do 100 if the run has finished, else 0."""
    none = F.when(F.coalesce(finished, F.lit(False)), 100).otherwise(0) if finished is not None else F.lit(0)
    return F.when(total > 0, F.bround(done * 100 / total, 0).cast("int")).otherwise(none)


def acted(actions: DataFrame, segments: DataFrame) -> DataFrame:
    """The log of decisions that actions leave (file_name, decision, edited_text, seq). actions: (seq, action, file_name, text);
    approving with another text than the segment's is an edit; moving about decides nothing; files without a segment are
    left out."""
    original = F.coalesce(F.when(~blank(F.col("transcription")), F.col("transcription")), F.col("original_text"))
    texts = segments.select("file_name", original.alias("_original"))
    made = actions.where(F.col("action").isin("approve", "reject")).join(texts, "file_name")
    decision = F.when(F.col("action") == "reject", "rejected").otherwise(decision_of(F.col("text"), F.col("_original")))
    return made.select("file_name", decision.alias("decision"), F.when(decision == "edited", F.col("text")).alias("edited_text"), "seq")


def places(actions: DataFrame, session: str, total: int) -> DataFrame:
    """(session, place): where each session's cursor stands after its actions: a decision moves on by one, next and previous by
    one, all held inside the list at each step. The steps of a session, which one person made, are folded as one array."""
    step = F.when(F.col("action").isin("approve", "reject", "next"), 1).when(F.col("action") == "previous", -1).otherwise(0)
    steps = actions.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("seq", step.alias("step")))).alias("_steps"))
    place = F.aggregate("_steps", F.lit(0), lambda at, s: F.greatest(F.lit(0), F.least(F.lit(total - 1), at + s["step"])).cast("int"))
    return steps.select(session, place.alias("place"))


def meta(*names: str) -> Column:
    """A map of those of a list of columns that are neither null nor blank."""
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (F.trim(v) != ""))
