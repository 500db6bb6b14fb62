"""Dataset operators, sources, audio, streaming, and every registered query against its SQL."""

import io
import json
import wave

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from speechloom.operators import audio, checks, dataset, review, series
from speechloom.plans import catalog, catalog_parts, catalog_scale, catalog_sources, catalog_sql, paths
from speechloom.sources import diarization, files
from speechloom.streaming.incremental import incremental

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    fix = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(([fix(v) for v in r] for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


ORACLES = catalog_sql.ORACLES | catalog_parts.ORACLES | catalog_sources.ORACLES | catalog_scale.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    other = duck.execute(ORACLES[name])
    names = [d[0] for d in other.description]
    assert sorted(names) == columns
    rows = [[r[names.index(c)] for c in columns] for r in other.fetchall()]
    assert plain([[r[c] for c in columns] for r in df.collect()]) == plain(rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_diarization_json(spark, tmp_path):
    turns = [{"start": 0.0, "end": 1.0, "text": "salom", "speaker": "a"}, {"start": 1.0, "end": 1.3, "text": "x", "speaker": "b"}, {"start": 2.0, "end": 9.0, "text": " [shovqin] ", "speaker": "a"}, {"start": 1.0, "end": 3.0, "text": "da", "speaker": "a"}]
    records = [{"id": "a/b?", "audio_url": "u", "diarization": turns, "duration": 9.0}, {"audio_url": "v", "diarization": turns[:1]}, {"id": "c", "audio_url": " ", "diarization": turns}]
    (tmp_path / "list.json").write_text(json.dumps(records))
    (tmp_path / "one.json").write_text(json.dumps(records[0]))
    rows = diarization.turns(diarization.read_json(spark, str(tmp_path / "list.json")))
    assert {r.record_id for r in rows.collect()} == {"a_b_", "rec_2"}
    assert [r.idx for r in diarization.plain_chunks(rows).where("record_id = 'a_b_'").orderBy("idx").collect()] == [0, 3]
    chunk = diarization.chunks(rows).where("record_id = 'a_b_'").orderBy("idx").collect()
    assert [(r.idx, r.style) for r in chunk] == [(0, "short_clip"), (2, "short_clip")]
    assert diarization.turns(diarization.read_json(spark, str(tmp_path / "one.json"))).count() == 4


def test_anti_join_keeps_unnamed_and_parts_are_whole(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, " "), (4, "b "), (5, "c")], "i int, file_name string")
    used = spark.createDataFrame([("a",), ("b",), (None,), ("",)], "file_name string")
    assert {r.i for r in dataset.not_in_manifest(rows, used).collect()} == {2, 3, 5}
    assert {r.i for r in dataset.not_in_manifest(rows, used, keep_unnamed=False).collect()} == {5}
    assert dataset.manifest(rows).count() == 3


def test_split_is_exact_and_repeatable(spark):
    rows = spark.range(1001).withColumnRenamed("id", "k")
    one, two = (dataset.train_test(rows, "k", 0.1, seed=5).where("split = 'test'").collect() for _ in range(2))
    assert len(one) == 101 and {r.k for r in one} == {r.k for r in two}


def test_required_columns(spark):
    df = spark.createDataFrame([("a", "b")], "file_name string, transcription string")
    assert dataset.required_columns(df, "file_name", "text").columns == ["file_name", "text"]
    with pytest.raises(ValueError, match="duration"):
        dataset.required_columns(df, "duration")


def test_review_last_decision_wins_and_pending_is_saved(spark):
    log = spark.createDataFrame([("a", "approved", None, 1), ("a", "rejected", None, 2), ("b", "edited", "new", 1)], "file_name string, decision string, edited_text string, seq int")
    rows = spark.createDataFrame([("a", "t", "o"), ("b", "t", "o"), ("c", " ", "o")], "file_name string, transcription string, original_text string")
    merged = review.merged(rows, review.decided(log))
    assert {(r.file_name, r.decision, r.text) for r in review.saved(merged).collect()} == {("b", "edited", "new"), ("c", "pending", "o")}
    assert review.stats(merged).first().pending == 1


def test_verdict(spark):
    v = lambda *rows: tuple(checks.verdict(spark.createDataFrame(list(rows), "passed boolean, critical boolean")).first())
    assert v((True, False)) == ("pass", 0) and v((True, False), (False, False)) == ("fail", 2) and v((True, True)) == ("critical", 3)


def test_run_coherence_depends_on_seconds(spark):
    rows = [(k, i, c, s) for k, (labels, s) in enumerate([("00001111", 0.5), ("01010101", 0.5), ("01010101", 1.0), ("010", 0.1)]) for i, c in enumerate(labels)]
    df = spark.createDataFrame(rows, "k int, at int, label string, s double")
    assert [r.coherent for r in series.coherent(df, "k", ["at"], "label", "s").orderBy("k").collect()] == [True, False, True, True]


def tone(seconds, rate=16000, level=0.5):
    return level * np.sin(2 * np.pi * 220 * np.arange(int(seconds * rate)) / rate).astype(np.float32)


def test_audio_levels_and_segments(spark):
    quiet = np.zeros(16000, np.float32)
    x = np.concatenate([tone(4), quiet, tone(2), quiet, tone(35)])
    rows = spark.createDataFrame([("long.wav", bytearray(audio.encode(x))), ("mid.wav", bytearray(audio.encode(tone(5)))), ("short.wav", bytearray(audio.encode(tone(1)))), ("bad.wav", bytearray(b"no"))], "file_name string, content binary")
    got = {r.file_name: r for r in audio.segmented(rows).collect()}
    assert sorted(got) == ["long_seg_001.wav", "long_seg_002.wav", "long_seg_003.wav", "mid_seg_001.wav"] and got["mid_seg_001.wav"].duration == 5.0
    levels = {r.file_name: r for r in audio.measured(rows).collect()}
    assert levels["bad.wav"].snr_score == -1.0 and levels["mid.wav"].silence_ratio == 0.0 and 0 < levels["long.wav"].silence_ratio < 10
    assert audio.with_music(rows).count() == 4


def test_stereo_and_widths():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[16384, -16384], [32767, 32767]], "<i2").tobytes())
    x, rate = audio.decode(out.getvalue())
    assert rate == 8000 and abs(x[0]) < 1e-6 and x[1] > 0.99
    assert audio.to_mono(np.ones((2, 5))).shape == (5,)


def test_two_speakers_are_told_apart():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 0.1, (6, 8)) + np.r_[np.ones(4), np.zeros(4)], rng.normal(0, 0.1, (6, 8)) + np.r_[np.zeros(4), np.ones(4)]
    assert audio.several_speakers(np.r_[a, b], np.full(12, 1.0))
    assert not audio.several_speakers(rng.normal(size=(3, 8)), np.full(3, 1.0))


def test_word_error_rate(spark):
    rows = spark.createDataFrame([("a b c d", "a x c"), ("", "x"), ("Hi, there", "hi there")], "r string, g string")
    got = audio.word_error_rate(rows, "r", "g").first()
    assert got.wer_ortho == pytest.approx(100 * 3 / 6) and got.wer == pytest.approx(100 * 2 / 6)


def test_sinks_and_sources(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t", "approved", None), ("b", "u", "filtered", "x"), ("c", " ", "pending", None), ("d", 'v "q"', "rejected", "y")], "file_name string, transcription string, status string, reason string")
    files.write_jsonl(rows, str(tmp_path / "j"), ["file_name", "reason"])
    assert {(r.file_name, r.reason) for r in files.read_jsonl(spark, str(tmp_path / "j"), "file_name string, reason string").collect()} == {("a", ""), ("d", "y")}
    assert files.write_csv(rows, str(tmp_path / "c"), ["file_name", "transcription"]) and not files.write_csv(rows.where("status = 'filtered'"), str(tmp_path / "n"), ["file_name"])
    assert {r.transcription for r in files.read_csv(spark, str(tmp_path / "c")).collect()} == {"t", 'v "q"'}
    (tmp_path / "w").mkdir()
    for name in ("b.WAV", "a.mp3", "c.txt"):
        (tmp_path / "w" / name).write_bytes(b"x")
    assert [r.file_name for r in files.audio_files(spark, str(tmp_path / "w")).collect()] == ["a.mp3", "b.WAV"]
    assert [r.line for r in files.json_lines(rows, ["file_name", "reason"]).collect()][0] == '{"file_name":"a"}'
    answered = files.provided(rows, "transcription", "answer", lambda batch: [t.upper() for t in batch])
    assert answered.where("file_name = 'a'").first().answer == "T"


def test_paths_add_up(spark):
    rows = catalog.path1_run(spark, SF)
    done = paths.status_counts(rows).first()
    assert done.total == done.approved + done.pending + done.rejected + done.filtered
    assert rows.where("status = 'filtered' AND reason IS NULL").count() == 0


def test_incremental_run_resumes(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    rows = spark.createDataFrame([(i, "approved") for i in range(6)], "i int, status string")
    rows.where("i < 3").coalesce(1).write.json(src)
    run = lambda: incremental(spark, src, "i int, status string", lambda df: df.where(F.col("i") % 2 == 0), out, state).awaitTermination()
    run()
    assert spark.read.json(out).count() == 2
    rows.where("i >= 3").coalesce(1).write.mode("append").json(src)
    run()
    run()
    assert sorted(r.i for r in spark.read.json(out).collect()) == [0, 2, 4]


def test_path1_runs_over_whole_tables(spark):
    """A row a document, long ones too."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = catalog.path1_run(spark, SF).collect()
    assert docs.where("length(text) >= 1500").count() > 0
    assert sorted(r.doc_id for r in got if r.doc_id >= 0) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def brute_table(a, b):
    """Longest common subsequence, longest common run and edits, by the full table."""
    lcs, run, edit = ([[0] * (len(b) + 1) for _ in range(len(a) + 1)] for _ in range(3))
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                edit[i][j] = i + j
                continue
            same = a[i - 1] == b[j - 1]
            lcs[i][j] = lcs[i - 1][j - 1] + 1 if same else max(lcs[i - 1][j], lcs[i][j - 1])
            run[i][j] = run[i - 1][j - 1] + 1 if same else 0
            edit[i][j] = min(edit[i - 1][j] + 1, edit[i][j - 1] + 1, edit[i - 1][j - 1] + (not same))
    return lcs[-1][-1], max(map(max, run)), edit[-1][-1]


def test_pairs_are_whole_texts(spark, tmp_path):
    """Measures of order over all tokens of longer texts, against brute force."""
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 30, n))) for i, n in enumerate([40, 60, 55, 70, 90, 33, 80, 64, 0, 1, 2, 3])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    change = [lambda a: a, lambda a: a[::-1], lambda a: a[2:], lambda a: [*a[:5], "besh", *a[6:]]]
    both = {i: (t.split(), change[i % 4](t.split())) for i, t in docs}
    got = {r.doc_id: r for r in catalog.lcs_run_ratio(spark, str(tmp_path)).collect()}
    half = {r.doc_id: r.text for r in catalog.dedup_half(spark, str(tmp_path)).collect()}
    edits = words = 0
    for i, (a, b) in both.items():
        lcs, run, edit = brute_table(a, b)
        longest = max(len(a), len(b), 1)
        shared = len(set(a) & set(b)) / max(1, len(set(a) | set(b)))
        assert (got[i].lcs, got[i].run) == (pytest.approx(lcs / longest, abs=1e-6), pytest.approx(run / longest, abs=1e-6))
        assert got[i].jaccard == pytest.approx(shared, abs=1e-6)
        edits, words = edits + edit * bool(a), words + len(a)
        n = (len(a) + len(b)) // 2
        first, second = (a + b)[:n], (a + b)[n:]
        lcs, run, _ = brute_table(first, second)
        agree = n >= 4 and len(set(first) & set(second)) / len(set(first) | set(second)) >= 0.82 and (first == second or lcs / len(second) >= 0.7 and run / len(second) >= 0.4)
        assert half[i] == (" ".join(first) if agree else f"{' '.join(a)} {' '.join(b)}")
    rate = catalog.word_error_rate(spark, str(tmp_path)).first()
    assert rate.wer_ortho == rate.wer == pytest.approx(100 * edits / words, abs=1e-3)
