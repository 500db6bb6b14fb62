"""Order over whole tables: percentiles of many keys, and shuffles with numbers, without a task that holds a key or a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom.operators.dataset import order_key
from speechloom.sources.shared import written

#: Buckets a range is cut into at each step, and values left in one that are sorted outright.
BUCKETS, FEW = 1024, 256
#: Keys times percentiles whose ranges are sent to every task (some 50 bytes each); more are joined.
RANGES = 200_000


def _scale(x: Column) -> Column:
    """A number that grows with x, by its logarithm, for ranges of many orders of magnitude; infinities are at its ends."""
    size = F.ln(F.abs(x)) + 745.0
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * F.least(size, F.lit(2000.0)))


def _bucket(x: Column, lo: Column, hi: Column, logarithmic: bool) -> Column:
    plain = (x - lo) / (hi - lo)
    scaled = (_scale(x) - _scale(lo)) / (_scale(hi) - _scale(lo))
    wide = F.isnan(hi - lo) | (F.abs(hi - lo) == float("inf"))
    share = F.when(F.lit(logarithmic) | wide, scaled).otherwise(plain)
    return F.when(lo == hi, 0).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BUCKETS), F.lit(BUCKETS - 1))).cast("int")


def _ranged(rows: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Each value with the ranges of its key that hold it."""
    sides = F.broadcast(ranges) if ranges.count() <= RANGES else ranges
    return rows.join(sides, rows["_key"].eqNullSafe(sides[key])).where("_value BETWEEN lo AND hi").select(key, "lo", "hi", "below", "_value")


def percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles of each key: (key, a column for each of shares).

    A histogram of the range between a key's least and largest value tells in which bucket a rank lies, and how many values
    are below; the next step cuts the bucket. Counts are combined before they are shuffled, so a key that holds a third of
    all rows costs each task a table of buckets. Each step reads the values once; steps end when a bucket holds one value, or
    few. Null and NaN count nowhere; a key without other values has null percentiles; a null key is a key; an empty table
    gives an empty one.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_value"))
    usable = F.when(~F.isnan("_value"), F.col("_value"))
    ends = written(rows.groupBy(F.col("_key").alias(key)).agg(F.count(usable).alias("n"), F.min(usable).alias("lo"), F.max(usable).alias("hi")), "percentile-ends")
    rows = rows.where("_value IS NOT NULL AND NOT isnan(_value)")

    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    ranks = reduce(lambda a, b: F.array_union(a, b), [F.array(F.floor(place(q)), F.ceil(place(q))) for q in shares.values()])
    wanted = ends.where("n > 0").select(key, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), "n")
    done: list[DataFrame] = []
    for step in range(256):
        wanted = written(wanted, "percentile-ranks")
        done.append(wanted.where("lo = hi").select(key, "rank", F.col("lo").alias("found")))
        small = wanted.where(f"lo < hi AND n <= {FEW}")
        done.append(_sorted(rows, small, key))
        wanted = wanted.where(f"lo < hi AND n > {FEW}")
        if wanted.isEmpty():
            break
        own = _ranged(rows, wanted.select(key, "lo", "hi", "below").distinct(), key)
        bucket = _bucket(F.col("_value"), F.col("lo"), F.col("hi"), step % 2 == 1)
        counts = own.groupBy(key, "lo", "hi", "below", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("_value").alias("least"), F.max("_value").alias("most"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(key, "lo", "hi").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = counts.withColumn("below", F.col("below") + before).withColumnsRenamed({key: "_k", "lo": "_lo", "hi": "_hi", "n": "_n", "below": "_below"})
        same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi"))
        inside = (F.col("rank") >= F.col("_below")) & (F.col("rank") < F.col("_below") + F.col("_n"))
        wanted = wanted.join(cut, same).where(inside).select(key, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("_below").alias("below"), F.col("_n").alias("n"))
    else:
        raise ArithmeticError("percentiles did not settle")

    at = reduce(lambda a, b: a.unionByName(b), done).withColumnRenamed(key, "_k")
    both = ends.join(at, F.col(key).eqNullSafe(F.col("_k")), "left")

    def of(q: float) -> Column:
        low, high = (F.max(F.when(F.col("rank") == end(place(q)), F.col("found"))) for end in (F.floor, F.ceil))
        part = F.max(place(q) - F.floor(place(q)))
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part)

    return both.groupBy(key).agg(*[of(q).alias(name) for name, q in shares.items()])


def _sorted(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Ranks in ranges of few values, by sorting these."""
    values = _ranged(rows, small.select(key, "lo", "hi", "below").distinct(), key).groupBy(key, "lo", "hi").agg(F.sort_array(F.collect_list("_value")).alias("_values"))
    values = values.withColumnsRenamed({key: "_k", "lo": "_lo", "hi": "_hi"})
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi"))
    return small.join(values, same).select(key, "rank", F.get("_values", (F.col("rank") - F.col("below")).cast("int")).alias("found"))


def numbered_by(df: DataFrame, *order: Column, to: str = "position") -> DataFrame:
    """Numbers all rows from 0 in an order, without gaps. Rows are dealt out and sorted by range, and written with their place
    in their task; running sums of the tasks' counts, a row a task, give the rest."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = written(placed.select("*", F.spark_partition_id().alias("_task"), at.alias("_at")), "numbered")
    counts = rows.groupBy("_task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(counts.select("_task", before.alias("_before"))), "_task").withColumn(to, F.col("_before") + F.col("_at")).drop("_task", "_at", "_before")


def shuffled(df: DataFrame, key: str, seed: int = 42, to: str = "position") -> DataFrame:
    """All rows in a random order that seed and key fix: to is each row's place, from 0. Rows of one key stand together."""
    return numbered_by(df, order_key(seed, F.col(key)), F.col(key), to=to)
