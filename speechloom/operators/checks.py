"""Dataset checks: each gives one row (name, passed, critical, summary, metrics); a verdict over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of augmented rows; corpora of the noise collection.
AUG_STATUSES = ["augmented", "skip_prob", "skip_long", "failed", "invalid_input"]
NOISE_DIRS = ["noise", "music", "speech", "rir"]
QUARANTINE = "_quarantine"


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def result(name: str, passed: Column, summary: Column, metrics: dict[str, Column], critical: Column | None = None) -> list[Column]:
    pairs = [x for k, v in metrics.items() for x in (F.lit(k), v.cast("string"))]
    return [F.lit(name).alias("name"), passed.alias("passed"), (critical if critical is not None else F.lit(False)).alias("critical"), summary.alias("summary"), F.create_map(*pairs).alias("metrics")]


def status_distribution(df: DataFrame, prob: float, tolerance: float, failed_max: float = 0.02, invalid_max: float = 0.01, status: str = "aug_status") -> DataFrame:
    """One pass: share of augmented rows among valid ones against the wanted one; failed and invalid shares; unknown states fail."""
    one = {s: count_if(F.col(status) == s).alias(s) for s in AUG_STATUSES}
    counts = df.agg(F.count("*").alias("total"), *one.values(), count_if(F.col(status).isNull() | ~F.col(status).isin(AUG_STATUSES)).alias("unknown"))
    ratio = lambda a, b: F.bround(F.coalesce(F.try_divide(F.col(a), b), F.lit(0.0)), 4)
    valid = F.col("total") - F.col("invalid_input")
    found = counts.withColumns({"effective_total": valid, "augmented_ratio": ratio("augmented", valid), "failed_ratio": ratio("failed", valid), "invalid_ratio": ratio("invalid_input", F.col("total"))})
    near = F.abs(F.col("augmented_ratio") - prob) <= tolerance + 1e-12
    passed = (F.col("total") > 0) & near & (F.col("failed_ratio") <= failed_max) & (F.col("invalid_ratio") <= invalid_max) & (F.col("unknown") == 0)
    return found.withColumn("passed", passed)


def schema_issues(df: DataFrame) -> DataFrame:
    """Counts of rows whose audio, text, duration or name can't be used; a path without bytes is only noted."""
    audio = F.col("audio")
    issues = {
        "no_audio": audio.isNull() | (audio["bytes"].isNull() & audio["path"].isNull()),
        "no_text": F.col("text").isNull(),
        "no_duration": F.col("duration").isNull() | (F.col("duration") <= 0),
        "no_name": F.col("file_name").isNull() | (F.trim("file_name") == ""),
        "no_status": F.col("aug_status").isNull(),
        "path_only": audio["bytes"].isNull() & audio["path"].isNotNull(),
    }
    counts = df.agg(F.count("*").alias("total"), *[count_if(c).alias(n) for n, c in issues.items()])
    hard = sum((F.col(n) for n in issues if n != "path_only"), F.lit(0))
    return counts.withColumn("passed", hard == 0)


# Fixed value: the statuses of rows whose audio is compared with its source.
CHECKED = ("augmented", "skip_prob", "skip_long", "failed")


def looks_unmodified(rms_in: Column, rms_out: Column, n_in: Column, n_out: Column, tolerance: float = 0.001) -> Column:
    """Equal lengths, and energies that are both nothing or differ by no more than a share of tolerance."""
    quiet = (rms_in < 1e-6) & (rms_out < 1e-6)
    near = F.abs(rms_in - rms_out) / F.greatest(rms_in, F.lit(1e-12)) <= tolerance
    return (n_in == n_out) & (quiet | near)


def audio_changed(pairs: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """pairs: aug_status, rms_in, rms_out, n_in, n_out, and found (whether there is a source; without that column, rms_in tells).
    Augmented rows must differ from their source; failed ones must not, in the main; skipped ones are counted alone. A pair
    with a source but without energies couldn't be decoded."""
    rows = pairs.where(F.col("aug_status").isin(*CHECKED))
    found = F.col("found") if "found" in pairs.columns else F.col("rms_in").isNotNull()
    read = found & F.col("rms_in").isNotNull() & F.col("rms_out").isNotNull()
    same = looks_unmodified(F.col("rms_in"), F.col("rms_out"), F.col("n_in"), F.col("n_out"), tolerance)
    is_ = lambda *s: F.col("aug_status").isin(*s)
    counts = rows.agg(
        count_if(~found).alias("missing"),
        count_if(found & ~read).alias("decode_errors"),
        count_if(read & is_("augmented")).alias("augmented_checked"),
        count_if(read & same & is_("augmented")).alias("augmented_unmodified"),
        count_if(read & is_("skip_prob", "skip_long")).alias("skip_checked"),
        count_if(read & is_("failed")).alias("failed_checked"),
        count_if(read & ~same & is_("failed")).alias("failed_modified"),
    )
    share = F.coalesce(F.try_divide(F.col("failed_modified"), F.col("failed_checked")), F.lit(0.0))
    critical = (F.col("failed_checked") >= 5) & (share > 0.5)
    return counts.withColumns({"critical": critical, "passed": (F.col("augmented_unmodified") == 0) & ~critical})


def noise_corpus(listing: DataFrame, least: int) -> DataFrame:
    """Files below each required folder (zero counts kept), without those in quarantine. listing: path."""
    spark = listing.sparkSession
    wanted = spark.createDataFrame([(d,) for d in NOISE_DIRS], "folder string")
    folder = F.regexp_extract("path", r"(?:^|/)([^/]+)/[^/]+$", 1)
    wavs = listing.where(F.lower("path").endswith(".wav") & ~F.col("path").contains(f"/{QUARANTINE}/")).select(folder.alias("folder"))
    counts = wavs.groupBy("folder").agg(F.count("*").alias("files"))
    return F.broadcast(wanted).join(counts, "folder", "left").select("folder", F.coalesce("files", F.lit(0)).alias("files")).withColumn("enough", F.col("files") >= least)


def noise_quarantine(listing: DataFrame, min_duration: float = 1.0) -> DataFrame:
    """What becomes of each noise file: kept, or moved aside (never deleted) if short or unreadable. listing: path, duration."""
    short = F.col("duration").isNull() | (F.col("duration") < min_duration)
    moved = F.regexp_replace("path", r"([^/]+)$", QUARANTINE + "/$1")
    return listing.select("path", F.when(short, "quarantine").otherwise("keep").alias("action"), F.when(short, moved).otherwise(F.col("path")).alias("target"))


def verdict(results: DataFrame) -> DataFrame:
    """pass, fail or critical over results (passed, critical), with the exit code 0, 2 or 3."""
    out = results.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.coalesce(F.bool_or("critical"), F.lit(False)).alias("critical"))
    word = F.when(F.col("critical"), "critical").when(F.col("passed"), "pass").otherwise("fail")
    return out.select(word.alias("verdict"), F.when(F.col("critical"), 3).when(F.col("passed"), 0).otherwise(2).alias("exit_code"))


def assert_some(df: DataFrame, condition: Column, message: str) -> None:
    """Fails loudly where no row meets a condition."""
    if df.where(condition).limit(1).count() == 0:
        raise ValueError(message)


def decodes(df: DataFrame, audio: str = "content", key: str = "file_name", named: int = 5) -> DataFrame:
    """(scanned, failed, first_failures, passed): whether every recording can be read and holds samples. The first failures
    are the least few by key, with the reason; at most that many a task go on."""
    import heapq

    from speechloom.operators.audio import decode

    def run(batches):
        import pandas as pd

        scanned, failed, least = 0, 0, []
        for pdf in batches:
            for name, data in zip(pdf[key], pdf[audio], strict=True):
                scanned += 1
                got = decode(data)
                if got is None or not len(got[0]):
                    failed += 1
                    least.append(f"{name}: {'unreadable' if got is None else 'empty'}")
            least = heapq.nsmallest(named, least)
        yield pd.DataFrame({"scanned": [scanned], "failed": [failed], "first": [least]})

    own = df.select(key, audio).mapInPandas(run, "scanned long, failed long, first array<string>")
    out = own.agg(F.coalesce(F.sum("scanned"), F.lit(0)).alias("scanned"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.slice(F.sort_array(F.flatten(F.collect_list("first"))), 1, named).alias("first_failures"))
    return out.withColumn("passed", F.col("failed") == 0)


def changed_sample(inputs: DataFrame, outputs: DataFrame, rows: int = 200, seed: int = 0, audio: str = "content", key: str = "file_name") -> DataFrame:
    """What audio_changed checks, from recordings: a fixed sample of all output rows, of which those that can be checked stay,
    each with the input of its name without prefix: whether it is there (found), energy and length of both, null where they
    can't be read."""
    from speechloom.operators.audio import measured
    from speechloom.operators.dataset import shuffled_head
    from speechloom.sources.files import stem, without_prefix

    chosen = shuffled_head(outputs.select(key, "aug_status", audio), key, rows, seed).where(F.col("aug_status").isin(*CHECKED))
    base = lambda c: stem(without_prefix(F.substring_index(c, "/", -1)))
    read = (F.col("snr_score") >= 0) | (F.col("samples") > 0)
    levels = lambda side: [F.when(read, F.col("rms")).alias(f"rms_{side}"), F.when(read, F.col("samples")).alias(f"n_{side}")]
    out = measured(chosen, audio).select(base(F.col(key)).alias("_base"), "aug_status", *levels("out"))
    wanted = out.select("_base").distinct()
    held = inputs.withColumn("_base", base(F.col(key))).join(F.broadcast(wanted), "_base", "left_semi").dropDuplicates(["_base"])
    source = measured(held.select("_base", audio), audio).select("_base", *levels("in"), F.lit(True).alias("found"))
    return out.join(source, "_base", "left").select("aug_status", F.coalesce("found", F.lit(False)).alias("found"), "rms_in", "rms_out", "n_in", "n_out")
