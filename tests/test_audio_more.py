"""Resampling, speakers, augmentation, features and decode checks on made-up recordings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechloom.operators import audio, augment, checks
from speechloom.sources import files

RATE = 16_000


def tone(hz, seconds, rate=RATE, level=0.3):
    return (level * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)).astype(np.float32)


def voice(hz, seconds, rng):
    """A buzz with a formant, so that both pitch and spectrum tell voices apart."""
    t = np.arange(int(seconds * RATE)) / RATE
    x = sum(np.sin(2 * np.pi * hz * k * t + rng.uniform(0, 6)) / (1 + abs(hz * k - 6 * hz) / 300) for k in range(1, 30))
    return (0.3 * x / np.abs(x).max()).astype(np.float32)


@pytest.mark.parametrize("rate", [8000, 11_025, 22_050, 44_100, 48_000])
def test_resampling_keeps_a_tone(rate):
    got = audio.resampled(tone(440, 1.0, rate), rate)
    assert abs(len(got) - RATE) <= 1
    middle = slice(1600, 14_400)
    assert np.abs(got[middle] - tone(440, 1.0)[: len(got)][middle]).max() < 0.01


def test_resampling_drops_what_does_not_fit():
    assert np.abs(audio.resampled(tone(12_000, 1.0, 48_000), 48_000)[800:-800]).max() < 0.01


def test_loader_takes_bytes_then_array_then_path(tmp_path):
    wav = audio.encode(tone(300, 0.5))
    (tmp_path / "a.wav").write_bytes(wav)
    assert len(audio.loaded(wav, array=[0.0] * 10, rate=RATE)) == 8000
    assert len(audio.loaded(b"junk", array=np.zeros((2, 4000)), rate=8000)) == 8000
    assert len(audio.loaded(None, path=str(tmp_path / "a.wav"))) == 8000
    assert audio.loaded(b"junk") is None and audio.loaded(None, path=str(tmp_path / "none.wav")) is None


def test_wav_of_three_bytes_a_sample():
    import io
    import wave

    x = (tone(300, 0.1) * (1 << 23)).astype(np.int32)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(3)
        w.setframerate(RATE)
        w.writeframes(b"".join(int(v).to_bytes(3, "little", signed=True) for v in x))
    assert np.abs(audio.decode(out.getvalue())[0] - tone(300, 0.1)).max() < 1e-6


def test_pitch_of_a_tone():
    assert np.abs(audio.pitch(tone(150, 1.0)) - 150).max() < 2


def test_two_pitches():
    rng = np.random.default_rng(1)
    low, high = 2 ** rng.normal(np.log2(110), 0.03, 40_000), 2 ** rng.normal(np.log2(220), 0.03, 30_000)
    assert audio.two_pitches(np.concatenate([low, high])) and not audio.two_pitches(low) and not audio.two_pitches(low[:20])


def test_speakers_from_recordings():
    rng = np.random.default_rng(2)
    gap = np.zeros(int(0.4 * RATE), np.float32)
    one = np.concatenate([np.concatenate([voice(120, 1.5, rng), gap]) for _ in range(8)])
    two = np.concatenate([np.concatenate([voice(hz, 1.5, rng), gap]) for hz in (110, 110, 230, 230) * 2])
    assert audio.has_several_speakers(two, RATE) and not audio.has_several_speakers(tone(150, 5.0), RATE)
    assert not audio.has_several_speakers(one[: int(1.9 * RATE)], RATE)


def test_radii_are_held_to_bounds_and_votes_count():
    rng = np.random.default_rng(3)
    groups = np.concatenate([rng.normal(0, 0.05, (12, 6)) + c for c in (np.tile([3, -3], 3), np.tile([-3, 3], 3))])
    order = np.ones(24)
    assert audio.several_speakers(groups, order) and not audio.several_speakers(groups, order * 0.01)
    assert not audio.several_speakers(rng.normal(0, 1, (3, 6)), np.ones(3))


def test_transforms():
    x = tone(220, 2.0)
    longer = augment.stretched(x, 0.8)
    assert abs(len(longer) - len(x) / 0.8) < 10 and np.median(np.abs(audio.pitch(longer)[4:-4] - 220)) < 3
    higher = augment.pitched(x, 4)
    assert len(higher) == len(x) and np.median(np.abs(audio.pitch(higher)[4:-4] - 220 * 2 ** (4 / 12))) < 4
    noise = np.random.default_rng(0).normal(0, 1, 5000).astype(np.float32)
    added = augment.with_noise(x, noise, 10.0) - x
    assert abs(20 * np.log10(np.sqrt((x**2).mean()) / np.sqrt((added**2).mean())) - 10) < 0.01
    assert np.abs(augment.low_passed(tone(6000, 0.5), 1000)[400:-400]).max() < 0.01


def test_augmentation_repeats_and_marks_failures(spark):
    wav = audio.encode(tone(200, 2.0))
    rows = spark.createDataFrame([("a.wav", wav, "augmented"), ("b.wav", b"junk", "augmented"), ("c.wav", wav, "skip_prob")], "file_name string, content binary, aug_status string")
    one, two = (sorted(augment.augment(rows, [wav]).collect()) for _ in range(2))
    assert [tuple(r) for r in one] == [tuple(r) for r in two]
    assert [r.aug_status for r in one] == ["augmented", "failed", "skip_prob"] and one[0].content != wav and one[2].content == wav
    changed = checks.changed_sample(rows.withColumn("aug_status", F.lit("x")), augment.augment(rows, [wav]).withColumn("file_name", F.concat(F.lit("augmented_"), "file_name")))
    got = checks.audio_changed(changed).first()
    # b.wav has a source that can't be decoded; c.wav was left as it is.
    assert got.passed and (got.missing, got.decode_errors, got.augmented_checked, got.skip_checked, got.augmented_unmodified) == (0, 1, 1, 1, 0)
    lone = checks.audio_changed(checks.changed_sample(rows.where("file_name = 'x'"), rows)).first()
    assert lone.missing == 3 and lone.passed


def test_features_and_their_guard(spark):
    rows = spark.createDataFrame([("a", audio.encode(tone(200, 1.0)), "ab"), ("b", b"", "x"), ("c", None, None)], "file_name string, content binary, text string")
    got = {r.file_name: r for r in augment.with_features(rows).collect()}
    assert [got[k].map_status for k in "abc"] == ["ok", "failed", "failed"] and len(got["a"].input_features) % 80 == 0 and got["a"].labels == [97, 98]
    assert augment.usable_features(augment.with_features(rows)).count() == 1
    with pytest.raises(ValueError):
        augment.usable_features(augment.with_features(rows.where("file_name <> 'a'")))


def test_decode_check(spark):
    rows = spark.createDataFrame([(f"f{i}", audio.encode(tone(200, 0.1)) if i % 3 else (b"junk" if i % 2 else audio.encode(np.zeros(0)))) for i in range(24)], "file_name string, content binary")
    got = checks.decodes(rows.repartition(3)).first()
    assert (got.scanned, got.failed, got.passed) == (24, 8, False)
    assert got.first_failures == ["f0: empty", "f12: empty", "f15: unreadable", "f18: empty", "f21: unreadable"]
    assert checks.decodes(rows.where("file_name IN ('f1', 'f2')")).first().passed and checks.decodes(rows.where("false")).first().scanned == 0


def test_standardised_files(spark):
    rows = spark.createDataFrame([("a", audio.encode(tone(200, 1.0, 8000), 8000)), ("b", None)], "file_name string, content binary")
    got = {r.file_name: r.wav for r in audio.standardised_files(rows).collect()}
    assert audio.decode(bytes(got["a"]))[1] == RATE and len(audio.decode(bytes(got["a"]))[0]) == RATE and got["b"] is None
    assert {r.file_name: r.has_multiple_speakers for r in audio.with_speakers(rows).collect()} == {"a": False, "b": False}


def test_paths_notes_and_shards(spark, tmp_path):
    assert files.inside(str(tmp_path), str(tmp_path / "a" / ".." / "b")) and not files.inside(str(tmp_path), str(tmp_path / ".." / "x"))
    assert files.run_suffix("new", "101112") == "_101112" and files.run_suffix("append", "101112") == ""
    out = str(tmp_path / "meta")
    assert files.read_sidecar(spark, out) is None
    files.write_sidecar(spark, out, "/audio/here")
    assert files.read_sidecar(spark, out) == "/audio/here"
    files.write_sharded(spark.range(100).coalesce(1), str(tmp_path / "shards"), 30)
    assert len([p for p in (tmp_path / "shards").iterdir() if p.suffix == ".parquet"]) == 4
    path = files.write_reviewed(spark.createDataFrame([("a", "rejected"), ("b", "pending")], "file_name string, decision string"), out)
    assert path.endswith("_reviewed") and [r.file_name for r in spark.read.json(path).collect()] == ["b"]


def test_strict_lines_name_the_bad_one(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken {\n{"a": 2}\n')
    rows = files.numbered_lines(spark, str(tmp_path / "x.jsonl"))
    assert [(r.number, r.line) for r in rows.orderBy("number").collect()][1] == (2, "broken {")
    assert files.parsed_lines(rows, "line", "a int").count() == 2
    with pytest.raises(Exception, match="broken"):
        files.parsed_lines(rows, "line", "a int", strict=True).collect()
