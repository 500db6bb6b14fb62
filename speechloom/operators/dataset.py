"""Set-level operations on datasets: union, manifests, sampling, splitting, augmentation plans, label and file joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom.functions.expr import blank, strip


def concatenated(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; their columns must be the same."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def merged(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; what a part lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_file(meta: DataFrame, files: DataFrame, key: str = "file_name") -> DataFrame:
    return meta.join(files.select(key), key, "left_semi")


def without_file(meta: DataFrame, files: DataFrame, key: str = "file_name") -> DataFrame:
    return meta.join(files.select(key), key, "left_anti")


def manifest(df: DataFrame, key: str = "file_name") -> DataFrame:
    """The distinct names that are not blank, trimmed."""
    return df.where(~blank(F.col(key))).select(strip(F.col(key)).alias(key)).distinct()


def not_in_manifest(df: DataFrame, used: DataFrame, key: str = "file_name", keep_unnamed: bool = True) -> DataFrame:
    """Rows whose name isn't in a manifest. Rows without a name stay (null never equals), unless keep_unnamed is off."""
    rows = df if keep_unnamed else df.where(~blank(F.col(key)))
    names = used.select(strip(F.col(key)).alias("_used")).where("_used <> ''")
    return rows.join(names, F.when(~blank(F.col(key)), strip(F.col(key))) == F.col("_used"), "left_anti")


def draw(seed: int | str, key: Column) -> Column:
    """A uniform number in [0, 1) fixed by seed and key: 32 bits of an md5 sum."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def order_key(seed: int | str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def shuffled_head(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """A sample of fixed size: the first rows in the shuffled order (a bounded heap in each task, no full sort)."""
    return df.orderBy(order_key(seed, F.col(key)), key).limit(rows)


def head(df: DataFrame, key: str, rows: int = 100) -> DataFrame:
    return df.orderBy(key).limit(rows)


def split_threshold(df: DataFrame, key: str, share: float, seed: int) -> tuple[int, str | None]:
    """The size of the test part, ceil(share * rows), and the largest order key in it. The order key of the n-th row is found
    in a histogram of key prefixes, and then among the rows of one prefix only, so nothing is sorted as a whole."""
    import math

    keyed = df.select(order_key(seed, F.col(key)).alias("k"))
    counts = keyed.groupBy(F.substring("k", 1, 3).alias("p")).count().orderBy("p").collect()
    need = math.ceil(share * sum(r["count"] for r in counts))
    left = need
    for r in counts:
        if left <= r["count"]:
            top = keyed.where(F.col("k").startswith(r.p)).orderBy("k").limit(max(1, left)).agg(F.max("k")).first()[0]
            return need, top if need else None
        left -= r["count"]
    return need, None


def train_test(df: DataFrame, key: str, share: float = 0.01, seed: int = 42, to: str = "split") -> DataFrame:
    """Adds train or test, an exact number of test rows where keys are distinct."""
    need, top = split_threshold(df, key, share, seed)
    return df.withColumn(to, F.when(F.lit(need > 0) & (order_key(seed, F.col(key)) <= F.lit(top)), "test").otherwise("train"))


def augment_status(key: Column, readable: Column, duration: Column, failed: Column, prob: float = 0.5, seed: int = 42, longest: float = 24.5) -> Column:
    """The augmentation ladder: unreadable, not drawn, empty, too long, failed, augmented."""
    return (
        F.when(~readable, "invalid_input")
        .when(draw(seed, key) > prob, "skip_prob")
        .when(F.coalesce(duration, F.lit(0.0)) <= 0, "invalid_input")
        .when(duration > longest, "skip_long")
        .when(failed, "failed")
        .otherwise("augmented")
    )


def only_usable(df: DataFrame, strict: bool = False, drop_failed: bool = True) -> DataFrame:
    """strict: augmented rows only; else all but failed ones, if wanted."""
    if strict:
        return df.where("aug_status = 'augmented'")
    return df.where("aug_status <> 'failed'") if drop_failed else df


def short_labels(df: DataFrame, labels: str = "labels", below: int = 440) -> DataFrame:
    return df.where(F.size(labels) < below)


def required_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, transcription renamed to text; an error names those that lack."""
    df = df.withColumnRenamed("transcription", "text") if "text" not in df.columns else df
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return df.select(*names)


def first_found(rows: DataFrame, key: str, *places: DataFrame) -> DataFrame:
    """The path of each row's file in the first of several listings (key, path) that has it."""
    ranked = reduce(lambda a, b: a.unionByName(b), [p.select(key, "path", F.lit(i).alias("priority")) for i, p in enumerate(places)])
    best = ranked.groupBy(key).agg(F.min_by("path", "priority").alias("path"))
    return rows.join(best, key, "left")


def last_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(key, "row.*")


def base_rows(meta: DataFrame, files: DataFrame, key: str = "file_name") -> DataFrame:
    """Rows that have a name, and whose file is there."""
    return with_file(meta.where(~blank(F.col(key))), files, key)


def tail(df: DataFrame, key: str, rows: int = 60) -> DataFrame:
    """The last rows by key."""
    return df.orderBy(F.col(key).desc()).limit(rows)


def resumed(df: DataFrame, key: str, done: int) -> DataFrame:
    """What is left of a run that ended after so many rows in the order of key (distinct): those beyond the last one done.
    Only that key is looked up; the rest is a filter."""
    if done <= 0:
        return df
    last = df.select(key).orderBy(key).limit(done).agg(F.max(key)).first()[0]
    return df.where(F.col(key) > F.lit(last))


def numbered(df: DataFrame, partition: str, order: str, to: str, start: int = 0) -> DataFrame:
    return df.withColumn(to, F.row_number().over(Window.partitionBy(partition).orderBy(order)) - 1 + start)


def noise_level_snr(level: Column) -> tuple[Column, Column]:
    """The range of signal-to-noise ratios (dB) of a noise level, held to 0..100."""
    low = F.lit(30.0) - F.lit(0.27) * F.greatest(F.lit(0.0), F.least(F.lit(100.0), level.cast("double")))
    return low, low + 5


def written_with_counts(df: DataFrame, path: str, keep: Column, **counts: Column) -> dict[str, int]:
    """Writes the rows to keep as Parquet, and gives the numbers of rows before and after, and of those that meet each further
    condition, all of which the write itself counts."""
    from pyspark.sql import Observation

    seen, kept = Observation(), F.coalesce(keep, F.lit(False))
    own = {"before": F.count(F.lit(1)), "after": F.count_if(kept), **{n: F.count_if(F.coalesce(c, F.lit(False))) for n, c in counts.items()}}
    df.observe(seen, *[c.alias(n) for n, c in own.items()]).where(kept).write.parquet(path)
    return seen.get


# Where noise comes from, and the chain's chances and ranges.
NOISE_KINDS = ("noise/free-sound", "noise/sound-bible", "speech/librivox", "music/jamendo")
CHAIN = {"rate": (0.8, 0.8, 1.2), "semitones": (0.8, -4.0, 4.0), "cutoff": (0.5, 500.0, 4000.0), "gain_db": (0.5, -2.0, 2.0)}


def augment_draws(df: DataFrame, key: str, noises: DataFrame, level: float = 50.0, seed: int = 42) -> DataFrame:
    """The plan of a random chain for each row: (key, rate, semitones, cutoff, gain_db, kind, noise, snr_db).

    Every number is drawn from an md5 sum of seed, its name and the key, so it is the same on any cluster; what isn't applied
    is null. noises (kind, path): a kind is drawn first, each as likely as another, then a file of that kind by its place in
    their order; a kind without files gives no noise. The listing must be small enough to be numbered a kind at a time.
    """
    at = lambda name: draw(f"{seed}|{name}", F.col(key))
    between = lambda name, lo, hi: at(name) * (hi - lo) + lo
    chain = [F.when(at(f"{n} applies") < p, between(n, lo, hi)).alias(n) for n, (p, lo, hi) in CHAIN.items()]
    low, high = noise_level_snr(F.lit(level))
    kind = F.get(F.array(*map(F.lit, NOISE_KINDS)), F.floor(at("kind") * len(NOISE_KINDS)).cast("int"))
    plan = df.select(key, *chain, kind.alias("kind"), (at("snr") * (high - low) + low).alias("snr_db"), at("file").alias("_at"))
    numbered_ = noises.withColumn("_i", F.row_number().over(Window.partitionBy("kind").orderBy("path")) - 1)
    sizes = noises.groupBy("kind").agg(F.count("*").alias("_n"))
    placed = plan.join(sizes, "kind", "left").withColumn("_i", F.floor(F.col("_at") * F.col("_n")).cast("int"))
    return placed.join(numbered_.withColumnRenamed("path", "noise"), ["kind", "_i"], "left").select(key, *CHAIN, "kind", "noise", "snr_db")


# How a run of augmentation may be asked for, and the size of a trial.
MODES = ("skip", "test", "continue", "full")
TRIAL = 100


def rows_of_mode(df: DataFrame, mode: str, key: str = "file_name", used: DataFrame | None = None) -> DataFrame:
    """The rows that a run in a mode augments: none (skip); the first hundred by name (test), whose names should be kept as a
    manifest; those that a manifest doesn't name (continue); all (full). A trial of nothing, a continuation without a
    manifest and an unknown mode are errors."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; there are {', '.join(MODES)}")
    if mode == "skip":
        return df.where(F.lit(False))
    if mode == "test":
        if df.isEmpty():
            raise ValueError("a trial needs at least one row")
        return head(df, key, TRIAL)
    if mode == "continue":
        if used is None:
            raise ValueError("to continue, the manifest of the trial is needed")
        return not_in_manifest(df, used, key)
    return df
