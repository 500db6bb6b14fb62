"""Clock styles and run coherence of recordings whose turns arrive in parts: state a recording, so that a run can stop anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TURNS = "record_id string, pos long, start double, end double, speaker string"
_FACTS = "record_id string, turns long, last_pos long, resets boolean, last_end double, most_end double, last_speaker string, runs long, seconds double"
_STATE = _FACTS.replace("record_id string, ", "")


def fold(state: tuple | None, rows: pd.DataFrame) -> tuple:
    """What is known of a recording after more turns, in their order. A turn at or before the last one known was here before
    (a file delivered twice) and changes nothing."""
    turns, last_pos, resets, last_end, most_end, last_speaker, runs, seconds = state or (0, None, False, None, None, None, 0, 0.0)
    # Plain lists: a recording has few turns in a batch, for which data frames cost more than the turns.
    number = lambda x: None if x is None or x != x else float(x)
    columns = (rows[c].tolist() for c in ("pos", "start", "end", "speaker"))
    for pos, start, end, speaker in sorted(zip(*columns, strict=True), key=lambda r: r[0]):
        if last_pos is not None and pos <= last_pos:
            continue
        start, end = number(start), number(end)
        speaker = speaker if isinstance(speaker, str) else None
        resets = resets or (last_end is not None and start is not None and start < last_end - 5)
        if not turns or speaker != last_speaker:
            runs += 1
        if end is not None:
            most_end = end if most_end is None else max(most_end, end)
            seconds += end - (start or 0.0)
        turns, last_pos, last_end, last_speaker = turns + 1, int(pos), end, speaker
    return turns, last_pos, resets, last_end, most_end, last_speaker, runs, seconds


def followed(turns: DataFrame) -> DataFrame:
    """A stream of turns to a stream of what is known of each recording that got more of them: its facts so far."""

    names = [f.split()[0] for f in _FACTS.split(", ")]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # The turns of one recording in one batch, which the trigger bounds.
        rows = list(parts)
        now = fold(state.get if state.exists else None, rows[0] if len(rows) == 1 else pd.concat(rows, ignore_index=True))
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=names, dtype=object)

    return turns.groupBy("record_id").applyInPandasWithState(step, _FACTS, _STATE, "update", GroupStateTimeout.NoTimeout)


def keep_batch(target: str):
    """Writes a batch to a folder of its number: one that is repeated after a stop replaces what it wrote before."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return put


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Goes through the Parquet files of turns that no earlier run has finished, and ends. Files of a recording must arrive in the
    order of its turns."""
    rows = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return followed(rows).writeStream.outputMode("update").foreachBatch(keep_batch(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def known(spark: SparkSession, target: str, few: int = 4, least: float = 1.0) -> DataFrame:
    """(record_id, turns, style, runs, mean_run, coherent) by the last batch that told of each recording."""
    facts = spark.read.schema(f"{_FACTS}, batch int").parquet(target)
    last = facts.groupBy("record_id").agg(F.max_by(F.struct("turns", "resets", "most_end", "runs", "seconds"), "turns").alias("f")).select("record_id", "f.*")
    style = F.when(F.col("resets"), "has_resets").when(F.col("most_end") > 3600, "possibly_ms").when(F.col("most_end") > 60, "normal").otherwise("short_clip")
    mean = F.try_divide(F.col("seconds"), F.col("runs"))
    return last.select("record_id", "turns", style.alias("style"), "runs", mean.alias("mean_run"), ((F.col("turns") < few) | (mean >= least)).alias("coherent"))
