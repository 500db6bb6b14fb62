"""Augmentation of recordings: a chain of transforms drawn by seed and key, and features for training."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechloom.operators.audio import RATE, decode, encode, loaded, log_mel, resampled


@dataclass(frozen=True)
class Chain:
    """Ranges and probabilities of the transforms, in their order."""

    stretch: tuple[float, float, float] = (0.8, 1.2, 0.8)
    semitones: tuple[float, float, float] = (-4.0, 4.0, 0.8)
    snr: tuple[float, float] = (16.5, 21.5)
    low_pass: tuple[float, float, float] = (500.0, 4000.0, 0.5)
    gain_db: tuple[float, float, float] = (-2.0, 2.0, 0.5)


def stretched(x: np.ndarray, rate: float, size: int = 1024) -> np.ndarray:
    """rate times as fast at the same pitch: a phase vocoder with a quarter frame's hop."""
    hop = size // 4
    window = np.hanning(size + 1)[:-1]
    padded = np.pad(np.asarray(x, float), (size, size + hop))
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop] * window
    spectrum = np.fft.rfft(frames, axis=1)
    steps = np.arange(0, len(spectrum) - 1, rate)
    at, part = steps.astype(int), (steps % 1)[:, None]
    advance = 2 * np.pi * hop * np.arange(spectrum.shape[1]) / size
    turn = np.angle(spectrum[at + 1]) - np.angle(spectrum[at]) - advance
    turn = advance + turn - 2 * np.pi * np.round(turn / (2 * np.pi))
    phase = np.angle(spectrum[0]) + np.concatenate([np.zeros((1, turn.shape[1])), np.cumsum(turn[:-1], axis=0)])
    level = (1 - part) * np.abs(spectrum[at]) + part * np.abs(spectrum[at + 1])
    made = np.fft.irfft(level * np.exp(1j * phase), axis=1) * window
    out, weight = np.zeros(len(made) * hop + size), np.zeros(len(made) * hop + size)
    for i, f in enumerate(made):
        out[i * hop : i * hop + size] += f
        weight[i * hop : i * hop + size] += window**2
    begin = round(size / rate)
    return (out / np.maximum(weight, 1e-3))[begin : begin + round(len(x) / rate)].astype(np.float32)


def pitched(x: np.ndarray, semitones: float) -> np.ndarray:
    """Another pitch at the same length: stretched, then read faster or slower."""
    factor = 2 ** (semitones / 12)
    longer = stretched(x, 1 / factor)
    at = np.linspace(0, max(0, len(longer) - 1), len(x))
    return np.interp(at, np.arange(len(longer)), longer).astype(np.float32) if len(longer) else x


def with_noise(x: np.ndarray, noise: np.ndarray, snr_db: float) -> np.ndarray:
    """Noise, repeated as long as the recording lasts, so much under its energy."""
    if not len(noise) or not len(x):
        return x
    own, other = float(np.sqrt((x**2).mean())), float(np.sqrt((noise**2).mean()))
    return x if other < 1e-9 else x + np.resize(noise, len(x)) * (own / other / 10 ** (snr_db / 20))


def low_passed(x: np.ndarray, cutoff: float, rate: int = RATE) -> np.ndarray:
    """A windowed sinc of 255 taps."""
    t = np.arange(-127, 128)
    h = np.sinc(2 * cutoff / rate * t) * np.hamming(len(t))
    return np.convolve(x, h / h.sum(), "same").astype(np.float32)


def augmented(x: np.ndarray, key: str, noises: Sequence[np.ndarray], chain: Chain = Chain(), seed: int = 42, rate: int = RATE) -> np.ndarray | None:
    """The chain with draws fixed by seed and key, held to [-1, 1]; None where a result is no number."""
    rng = np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}|{key}".encode()).digest()[:8], "little"))
    pick = lambda r: float(rng.uniform(*r[:2])) if rng.random() < r[2] else None
    if (by := pick(chain.stretch)) is not None:
        x = stretched(x, by)
    if (by := pick(chain.semitones)) is not None:
        x = pitched(x, by)
    if noises:
        noise = noises[int(rng.integers(len(noises)))]
        x = with_noise(x, noise[int(rng.integers(max(1, len(noise)))) :] if len(noise) > len(x) else noise, float(rng.uniform(*chain.snr)))
    if (by := pick(chain.low_pass)) is not None:
        x = low_passed(x, by, rate)
    if (by := pick(chain.gain_db)) is not None:
        x = x * 10 ** (by / 20)
    return np.clip(x, -1, 1) if np.isfinite(x).all() else None


def augment(df: DataFrame, noises: list[bytes], chain: Chain = Chain(), seed: int = 42, audio: str = "content", key: str = "file_name") -> DataFrame:
    """Rows whose aug_status is augmented get their changed audio (mono 16 kHz 16-bit .wav) in place of the old, or the status
    failed and their old audio where that goes wrong; other rows stay as they are. noises: a bounded set of .wav files."""
    spare = [x for n in noises if (x := loaded(n)) is not None]

    def run(batches):
        for pdf in batches:
            made, status = [], []
            for data, name, now in zip(pdf[audio], pdf[key], pdf["aug_status"], strict=True):
                got = decode(data) if now == "augmented" else None
                x = None if got is None or not len(got[0]) else augmented(resampled(*got), str(name), spare, chain, seed)
                made.append(data if x is None else encode(x))
                status.append("failed" if now == "augmented" and x is None else now)
            pdf[audio], pdf["aug_status"] = made, status
            yield pdf

    return df.mapInPandas(run, df.schema)


def with_features(df: DataFrame, audio: str = "content", text: str = "text", bands: int = 80, seconds: float = 30.0) -> DataFrame:
    """Adds input_features (log-mel frames of the first seconds, bands numbers each, one after the other), labels (code points
    of the text) and map_status: ok, or failed with both null where audio can't be read or is empty."""

    def run(batches):
        for pdf in batches:
            found, names = [], []
            for data in pdf[audio]:
                x = loaded(data)
                ok = x is not None and len(x) > 0
                found.append(log_mel(x[: int(seconds * RATE)], RATE, bands, 400, 160).astype(np.float32).ravel() if ok else None)
                names.append("ok" if ok else "failed")
            pdf["input_features"], pdf["map_status"] = found, names
            pdf["labels"] = [[ord(c) for c in t or ""] if s == "ok" else None for t, s in zip(pdf[text], names, strict=True)]
            yield pdf

    extra = T._parse_datatype_string("input_features array<float>, map_status string, labels array<int>").fields
    return df.mapInPandas(run, T.StructType([*df.schema.fields, *extra]))


def usable_features(mapped: DataFrame) -> DataFrame:
    """The rows with features; an error where there is none, so that no empty training set is ever written."""
    from speechloom.operators.checks import assert_some

    assert_some(mapped, F.col("map_status") == "ok", "no row has features")
    return mapped.where("map_status = 'ok'")
