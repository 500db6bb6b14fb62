"""Percentiles, shuffles, components, clusters and draws against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechloom.functions import prompts
from speechloom.operators import clusters, dataset, graph, ordered, series, spans
from speechloom.sources import diarization
from speechloom.streaming import styles


def test_percentiles_against_numpy(spark):
    rng = random.Random(0)
    values = {
        "plain": [rng.gauss(0, 1) for _ in range(3000)],
        "equal": [2.5] * 5000,
        "wide": [10.0 ** rng.randint(-300, 300) * rng.choice([1, -1]) for _ in range(3000)],
        "two": [1.0, 2.0],
        "one": [-3.0],
        "steps": [float(rng.randint(0, 3)) for _ in range(2000)],
        "ends": [float("inf"), float("-inf")] + [rng.random() for _ in range(1500)],
        None: [5.0, 7.0],
        "close": [1.0 + i * 2.0**-52 for i in range(1000)] + [1e9],
    }
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("none", None), ("none", float("nan")), ("two", None), ("two", float("nan"))]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 0.0, 0) for r in rows], "k string, v double, n int, lo double, rank int").repartition(4)
    shares = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.k: tuple(r)[1:] for r in ordered.percentiles(df, "k", "v", shares).collect()}
    assert set(got) == {*values, "none"}
    assert got.pop("none") == (None,) * 6
    for k, found in got.items():
        want = np.percentile(np.array(values[k]), [100 * q for q in shares.values()])
        # Between equal infinities numpy finds no number.
        want = [w if w == w else e for w, e in zip(want, (min(values[k]), *found[1:5], max(values[k])), strict=True)]
        np.testing.assert_allclose(found, want, rtol=1e-12)
    assert ordered.percentiles(df.limit(0), "k", "v", shares).count() == 0


def test_no_task_gets_a_hot_key(spark):
    """A third of all rows are of one key: what is shuffled is a table of buckets."""
    df = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).alias("k"), F.rand(1).alias("v"))
    got = {r.k: r.p for r in ordered.percentiles(df, "k", "v", {"p": 0.5}).where("k < 3").collect()}
    want = {r.k: r.p for r in df.where("k < 3").groupBy("k").agg(F.percentile("v", 0.5).alias("p")).collect()}
    assert got == pytest.approx(want, rel=1e-12)


def test_shuffle_is_a_permutation_without_gaps(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("n"))
    rows = ordered.shuffled(df, "id", seed=1).collect()
    assert sorted(r.position for r in rows) == list(range(5000))
    assert all(r.n == r.id % 7 for r in rows)
    again = {r.id: r.position for r in ordered.shuffled(df.repartition(3), "id", seed=1).collect()}
    assert again == {r.id: r.position for r in rows}
    assert again != {r.id: r.position for r in ordered.shuffled(df, "id", seed=2).collect()}
    assert ordered.shuffled(df.limit(0), "id").count() == 0
    twice = ordered.numbered_by(df.unionByName(df), F.col("n"), F.col("id").desc()).collect()
    assert [(r.n, -r.id) for r in sorted(twice, key=lambda r: r.position)] == sorted((r.n, -r.id) for r in twice)


def plain_components(links):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(500)] + [(rng.randint(2000, 2600), rng.randint(2000, 2600)) for _ in range(400)] + [(5000, 5000), (3, 3), (1, 0)]
    rng.shuffle(links)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == plain_components(links)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_dbscan(x, eps, least):
    size = np.sqrt((x * x).sum(1, keepdims=True))
    u = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    near = 1 - u @ u.T <= eps
    np.fill_diagonal(near, True)
    core = near.sum(1) >= least
    found = plain_components([(i, j) for i in np.flatnonzero(core) for j in np.flatnonzero(near[i] & core)])
    out = []
    for i in range(len(x)):
        if core[i]:
            out.append(int(found[i]))
        else:
            js = np.flatnonzero(near[i] & core)
            out.append(int(found[js[0]]) if len(js) else None)
    return out


@pytest.mark.parametrize("least", [2, 5])
def test_clusters_of_recordings_in_many_blocks(spark, least):
    rng = np.random.default_rng(4)
    sizes, rows, want = {"long": 700, "short": 3, None: 40}, [], {}
    for g, n in sizes.items():
        centre = rng.normal(size=(4, 8))
        x = centre[rng.integers(0, 4, n)] + rng.normal(size=(n, 8)) * rng.choice([0.2, 1.0], (n, 1))
        x[-1] = 0
        keys = np.arange(n) + len(rows)
        for k, c in zip(keys, plain_dbscan(x, 0.03, least), strict=True):
            want[int(k)] = None if c is None else int(keys[c])
        rows += [(g, int(k), v.tolist(), 0, 1.0) for k, v in zip(keys, x, strict=True)]
    df = spark.createDataFrame([*rows, ("long", None, [1.0] * 8, 0, 0.0), ("long", 9999, None, 0, 0.0)], "rec string, seg long, v array<double>, block int, key double")
    got = clusters.dbscan(df, "rec", "seg", "v", 0.03, least, block=64).collect()
    assert {r.seg: r.cluster for r in got} == want and len(got) == len(want)
    assert len({r.cluster for r in got}) > 3
    assert clusters.dbscan(df.limit(0), "rec", "seg", "v", 0.03, least).count() == 0


def test_five_thousand_segments_of_one_recording(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6, 16))[rng.integers(0, 6, 5000)] + rng.normal(size=(5000, 16)) * 0.25
    df = spark.createDataFrame([("r", i, v.tolist()) for i, v in enumerate(x)], "rec string, seg long, v array<double>")
    got = {r.seg: r.cluster for r in clusters.dbscan(df, "rec", "seg", "v", 0.05).collect()}
    assert [got[i] for i in range(5000)] == plain_dbscan(x, 0.05, 2)


def test_split_of_clusters(spark):
    rows = [("a", 0)] * 17 + [("a", 1)] * 3 + [("b", 0)] * 5 + [("b", 9)] * 19 + [("b", None)] * 50 + [("c", 2)] * 4
    got = {r.g: (r.clusters, r.several) for r in clusters.well_split(spark.createDataFrame(rows, "g string, cluster long"), "g").collect()}
    assert got == {"a": (2, True), "b": (2, True), "c": (1, False)}


def test_counts_beside_the_write(spark, tmp_path):
    df = spark.range(1000).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("id"))
    seen = dataset.written_with_counts(df, str(tmp_path / "x"), F.col("id") < 500, odd=F.col("id") % 2 == 1)
    assert seen == {"before": 1000, "after": 450, "odd": 500} and spark.read.parquet(str(tmp_path / "x")).count() == 450


def test_draws_of_a_chain(spark):
    noises = spark.createDataFrame([(k, f"{k}/{i}") for k, n in zip(dataset.NOISE_KINDS, (1, 50, 3, 0), strict=True) for i in range(n)], "kind string, path string")
    rows = dataset.augment_draws(spark.range(8000), "id", noises, level=0.0).collect()
    assert len(rows) == 8000
    # Each kind is near a quarter, whatever the number of its files; one without files gives none.
    for kind in dataset.NOISE_KINDS:
        own = [r for r in rows if r.kind == kind]
        assert abs(len(own) - 2000) < 200
        assert all((r.noise is None) == (kind == dataset.NOISE_KINDS[3]) and (r.noise or kind).startswith(kind) for r in own)
    for name, (p, lo, hi) in dataset.CHAIN.items():
        some = [r[name] for r in rows if r[name] is not None]
        assert abs(len(some) / 8000 - p) < 0.03 and lo <= min(some) and max(some) <= hi and abs(np.mean(some) - (lo + hi) / 2) < 0.03 * (hi - lo)
    assert all(30 <= r.snr_db <= 35 for r in rows)


def plain_segments(levels, loud, silence, keep, shortest, longest):
    frames = max(levels) + 1
    if frames < shortest:
        return []
    if frames <= longest:
        return [(0, frames)]
    spans = []
    for i in sorted(i for i, v in levels.items() if v is not None and v >= loud):
        if spans and i - spans[-1][1] < silence:
            spans[-1][1] = i + 1
        else:
            spans.append([i, i + 1])
    out = []
    for b, e in spans:
        b, e = max(0, b - keep), min(frames, e + keep)
        out += [(x, min(e, x + longest)) for x in range(b, e, longest) if min(e, x + longest) - x >= shortest]
    return out


@pytest.mark.parametrize("chunk", [7, 64, 1 << 16])
def test_segments_of_frame_tables(spark, chunk):
    rng = random.Random(6)
    series = {"short": {i: 1.0 for i in range(5)}, "middling": {i: rng.choice([0.0, 1.0]) for i in range(60)}, "silent": {i: 0.0 for i in range(300)}, None: {i: 1.0 for i in range(250)}}
    series["long"] = {i: (1.0 if (i // rng.choice([20, 37])) % 3 else 0.0) for i in range(3000)}
    series["gaps"] = {i: rng.choice([None, 0.0, 1.0]) for i in range(2000) if i % 300 < 150}
    rows = [(s, i, v, 1) for s, own in series.items() for i, v in own.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, at long, v double, begin int")
    got = spans.segments(spans.speech(df, "s", "at", F.col("v") >= 0.5, 12, 3, chunk), "s", 20, 100).collect()
    for s, own in series.items():
        mine = sorted((r.segment, r.begin, r.end) for r in got if r.s == s)
        assert mine == [(n, *p) for n, p in enumerate(plain_segments(own, 0.5, 12, 3, 20, 100), 1)]


def test_prompts(spark):
    plain = prompts.transcribing()
    fewer = prompts.transcribing(prompts.Transcribing(capitals=False, latin_only=False))
    assert len(plain.split("\n")) == 8 and len(fewer.split("\n")) == 6 and prompts.UNCLEAR in fewer
    df = spark.createDataFrame([("salom",), (None,)], "t string")
    texts = [r.p for r in df.select(prompts.correcting(F.col("t"), prompts.Correcting(spelling=False, russian_in_latin=True)).alias("p")).collect()]
    assert texts[0].endswith("Text: salom") and texts[1].endswith("Text: ") and texts[0].count("\n- ") == 3


def test_a_stopped_stream_of_turns_equals_one_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for rec in range(30):
        at = 0.0
        for pos in range(rng.randint(1, 12)):
            start = 0.0 if rng.random() < 0.05 else at
            at = start + rng.choice([0.2, 0.5, 3.0, 40.0, 3000.0])
            rows.append((f"r{rec}", pos, start, at, rng.choice(["a", "b", None])))
    df = spark.createDataFrame(rows, styles.TURNS)
    parts = [df.where(f"pos % 12 BETWEEN {a} AND {b}") for a, b in ((0, 2), (3, 6), (7, 11))]
    once, source, out = str(tmp_path / "once"), str(tmp_path / "source"), str(tmp_path / "out")
    df.coalesce(1).write.parquet(once)
    styles.follow(spark, once, str(tmp_path / "once-out"), str(tmp_path / "once-check")).awaitTermination()
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(source)
        styles.follow(spark, source, out, str(tmp_path / "check")).awaitTermination()
    # A file that is delivered again changes nothing, nor does a batch that is written again.
    parts[1].coalesce(1).write.mode("append").parquet(source)
    styles.follow(spark, source, out, str(tmp_path / "check")).awaitTermination()
    last = spark.read.parquet(f"{out}/batch=2")
    styles.keep_batch(out)(spark.createDataFrame(last.collect(), last.schema), 2)
    got = {r.record_id: tuple(r) for r in styles.known(spark, out).collect()}
    assert got == {r.record_id: tuple(r) for r in styles.known(spark, str(tmp_path / "once-out")).collect()}
    batch = {r.record_id: r.style for r in diarization.styles(df.withColumnRenamed("pos", "idx")).collect()}
    assert {k: v[2] for k, v in got.items()} == batch and len(set(batch.values())) == 4
    seconds = df.withColumn("seconds", F.col("end") - F.col("start"))
    want = {r.record_id: (r.segments, r.runs, pytest.approx(r.mean_run), r.coherent) for r in series.coherent(seconds, "record_id", ["pos"], "speaker", "seconds").collect()}
    assert {k: (v[1], v[3], v[4], v[5]) for k, v in got.items()} == want
