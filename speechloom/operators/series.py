"""Operators that need an order: frames, runs, histograms, peaks, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom.functions.expr import let


def framed_rms(samples: DataFrame, series: str, at: str, value: str, length: int, hop: int) -> DataFrame:
    """(series, frame, rms) of all full frames of length samples, a new one every hop. Each sample goes to the few frames that
    hold it, and frames are sums combined before the shuffle: a long series needs no one task."""
    span = -(-length // hop)
    n = samples.groupBy(series).agg(F.max(at).alias("_last"))
    frames = F.explode(F.sequence(F.lit(0), F.lit(span - 1))).alias("_back")
    frame = F.floor(F.col(at) / hop) - F.col("_back")
    rows = samples.join(n, series).select(series, at, value, "_last", frames).withColumn("frame", frame.cast("long"))
    inside = (F.col("frame") >= 0) & (F.col(at) < F.col("frame") * hop + length) & (F.col("frame") * hop + length <= F.col("_last") + 1)
    return rows.where(inside).groupBy(series, "frame").agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def snr_db(frames: DataFrame, series: str) -> DataFrame:
    """Signal over noise: the mean frame against the 10th percentile (exact, interpolated); 0 without signal, 60 without noise."""
    parts = frames.groupBy(series).agg(F.avg("rms").alias("signal"), F.percentile("rms", 0.1).alias("noise"), F.count("*").alias("frames"))
    db = F.bround(20 * F.log10(F.col("signal") / F.col("noise")), 2)
    return parts.withColumn("snr_db", F.when(F.col("signal") <= 0, 0.0).when(F.col("noise") <= 0, 60.0).otherwise(db))


def silent_share(samples: DataFrame, series: str, at: str, value: str, width: int, threshold: float) -> DataFrame:
    """Percentage of bins of width samples whose RMS is below a threshold."""
    bins = samples.groupBy(series, F.floor(F.col(at) / width).alias("bin")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    share = F.bround(F.count_if(F.col("rms") < threshold) / F.count("*") * 100, 1)
    return bins.groupBy(series).agg(F.count("*").alias("bins"), share.alias("silence_ratio"))


def runs(rows: DataFrame, series: str, order: list[str], label: str, weight: str) -> DataFrame:
    """(series, run, label, total weight) of stretches of equal labels."""
    w = Window.partitionBy(series).orderBy(*order)
    change = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)
    return rows.withColumn("_new", change).withColumn("run", F.sum("_new").over(w)).groupBy(series, "run", label).agg(F.sum(weight).alias("run_weight"))


def coherent(rows: DataFrame, series: str, order: list[str], label: str, weight: str, least: float = 1.0, few: int = 4) -> DataFrame:
    """Whether the mean run is at least so long; true where there are few rows."""
    n = rows.groupBy(series).agg(F.count("*").alias("segments"))
    mean = runs(rows, series, order, label, weight).groupBy(series).agg(F.avg("run_weight").alias("mean_run"), F.count("*").alias("runs"))
    return n.join(mean, series).withColumn("coherent", (F.col("segments") < few) | (F.col("mean_run") >= least))


def histogram(rows: DataFrame, series: str, value: str, bins: int = 30) -> DataFrame:
    """Equal-width counts between each series' least and largest value; the last bin takes its upper bound in."""
    bounds = rows.groupBy(series).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    bin_ = F.when(F.col("_hi") == F.col("_lo"), bins // 2).otherwise(F.least(at, F.lit(bins - 1))).cast("int")
    return rows.join(bounds, series).groupBy(series, bin_.alias("bin")).agg(F.count("*").alias("n"))


def bimodal(counts: DataFrame, series: str, ratio: float = 0.30) -> DataFrame:
    """Whether the second-highest local peak of a histogram reaches a share of the highest."""
    w = Window.partitionBy(series).orderBy("bin")
    lone = lambda col, gap: F.when(gap == 1, col).otherwise(0)
    left = F.coalesce(lone(F.lag("n").over(w), F.col("bin") - F.lag("bin").over(w)), F.lit(0))
    right = F.coalesce(lone(F.lead("n").over(w), F.lead("bin").over(w) - F.col("bin")), F.lit(0))
    peaks = counts.select(series, "bin", "n", left.alias("l"), right.alias("r")).where("n > l AND n >= r")
    rank = F.row_number().over(Window.partitionBy(series).orderBy(F.desc("n"), "bin"))
    top = peaks.withColumn("rank", rank).where("rank <= 2").groupBy(series)
    two = top.agg(F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("second"))
    return two.select(series, "first", F.coalesce("second", F.lit(0)).alias("second"), (F.coalesce("second", F.lit(0)) > F.col("first") * ratio).alias("bimodal"))


def standardised(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """Vectors with each dimension's mean taken off and divided by its population deviation (0 stays 0), within each group."""
    flat = rows.select(group, key, F.posexplode(vector).alias("dim", "x"))
    stats = flat.groupBy(group, "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col("x") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    cells = flat.join(stats, [group, "dim"]).select(group, key, F.struct("dim", z.alias("z")).alias("cell"))
    return cells.groupBy(group, key).agg(F.transform(F.array_sort(F.collect_list("cell")), lambda c: c["z"]).alias("z"))


def cosine_distances(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """Distances of all pairs inside a group (the segments of one recording, which are few), the smaller key first."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    a = rows.select(group, F.col(key).alias("a"), F.col(vector).alias("va"))
    b = rows.select(group, F.col(key).alias("b"), F.col(vector).alias("vb"))
    norm = F.sqrt(dot(F.col("va"), F.col("va")) * dot(F.col("vb"), F.col("vb")))
    return a.join(b, group).where("a < b").select(group, "a", "b", F.when(norm > 0, 1 - dot(F.col("va"), F.col("vb")) / norm).otherwise(1.0).alias("distance"))


def moments(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, population deviation and variance, their ratio (cv), and root mean square."""
    v = F.col(value)
    out = df.groupBy(by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.var_pop(v).alias("var"), F.sqrt(F.avg(v * v)).alias("rms"))
    return out.withColumn("cv", F.try_divide(F.col("sd"), F.col("mean")))


def clipped(samples: Column) -> Column:
    """An array of samples held to [-1, 1]."""
    return F.transform(samples, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def broken(samples: Column) -> Column:
    """Whether a sample is no number, or no finite one."""
    return F.exists(samples, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def levelled(samples: Column) -> Column:
    """An array of samples, peak to -3 dB, or energy to -20 dB where one click would rule (crest over 12); null for silence."""

    def scaled(s: Column) -> Column:
        by = F.when(s["peak"] / s["rms"] > 12, 0.1 / s["rms"]).otherwise(10 ** (-3 / 20) / s["peak"])
        return F.when((s["peak"] >= 1e-6) & (s["rms"] >= 1e-8), let(by, lambda b: F.transform(s["x"], lambda x: x * b)))

    peak = F.aggregate(samples, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    energy = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / F.size(samples)
    return let(F.struct(samples.alias("x"), peak.alias("peak"), F.sqrt(energy).alias("rms")), scaled)
