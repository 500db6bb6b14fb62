"""Waveform operators in Arrow batches: decoding, levels, silence, slicing, segmentation, music and speaker tags.

Only what needs samples runs in Python; scores, votes and thresholds are expressions where they can be.
"""

from __future__ import annotations

import io
import math
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 16_000
# Weights and (centre, steepness) of the music score's five features.
MUSIC_WEIGHTS = [0.30, 0.35, 0.25, 0.07, 0.03]
MUSIC_SHAPES = [(0.38, 20.0), (0.68, 14.0), (0.55, -8.0), (16.0, 0.4), (0.50, 3.0)]
MUSIC_FROM = 0.60


def decode(data: bytes | None) -> tuple[np.ndarray, int] | None:
    """Mono samples in [-1, 1] and the rate of a PCM .wav; None where it can't be read."""
    try:
        with wave.open(io.BytesIO(data or b""), "rb") as w:
            width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return None
    if not rate or not channels:
        return None
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        low = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((low[:, 0] << 8 | low[:, 1] << 16 | low[:, 2] << 24) >> 8).astype(np.float32) / float(1 << 23)
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    else:
        return None
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), rate


def loaded(data: bytes | None = None, array=None, path: str | None = None, rate: int | None = None, want: int = RATE) -> np.ndarray | None:
    """Mono samples at the wanted rate: of the bytes, else of an array with its rate, else of a file's path; None for none."""
    got = decode(data) if data else None
    if got is None and array is not None and len(array) and rate:
        got = to_mono(np.asarray(array, np.float32)), rate
    if got is None and path:
        try:
            with open(path, "rb") as f:
                got = decode(f.read())
        except OSError:
            got = None
    return None if got is None else resampled(got[0], got[1], want)


def resampled(x: np.ndarray, rate: int, want: int = RATE, zeros: int = 16) -> np.ndarray:
    """Polyphase resampling: one phase of a windowed sinc (cut off below the lower rate's half) for each output remainder."""
    x = np.asarray(x, np.float32)
    if rate == want or not len(x):
        return x
    g = math.gcd(rate, want)
    up, down = want // g, rate // g
    n = -(-len(x) * up // down)
    # The filter at the upsampled rate, taken apart into its phases.
    reach = zeros * max(up, down)
    t = np.arange(-reach, reach + 1) / max(up, down)
    h = np.sinc(t * 0.95) * 0.95 * np.kaiser(len(t), 8.0) * min(1.0, up / down)
    at = np.arange(n) * down
    out = np.zeros(n, np.float32)
    # So many outputs at once that what is gathered for them stays small, however long the recording is.
    step = up * max(1, (1 << 20) // (2 * reach // up + 2) // up)
    for phase, begin in ((p, b) for p in range(min(up, n)) for b in range(0, n, step)):
        own = np.arange(begin + phase, min(begin + step, n), up)
        if not len(own):
            continue
        first = (at[own] - reach + up - 1) // up
        taps = np.arange(2 * reach // up + 2)
        k = at[own[0]] - (first[0] + taps) * up + reach
        good = (k >= 0) & (k < len(h))
        where = first[:, None] + taps[good][None, :]
        inside = (where >= 0) & (where < len(x))
        out[own] = (np.where(inside, x[np.clip(where, 0, len(x) - 1)], 0) * h[k[good]]).sum(1)
    return out


def standardised_files(df: DataFrame, audio: str = "content", to: str = "wav") -> DataFrame:
    """Adds the recording as mono 16 kHz 16-bit .wav; null for what can't be read."""

    def run(batches):
        for pdf in batches:
            found = [loaded(d) for d in pdf[audio]]
            pdf[to] = [None if x is None else encode(x) for x in found]
            yield pdf

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(to, T.BinaryType())]))


def to_mono(x: np.ndarray) -> np.ndarray:
    """The mean of the channels, whichever axis they are on (the shorter one)."""
    x = np.asarray(x, np.float32)
    if x.ndim < 2:
        return x.reshape(-1)
    return x.mean(axis=int(np.argmin(x.shape)))


def encode(x: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.nan_to_num(x), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def levelled(x: np.ndarray) -> np.ndarray | None:
    """Peak to -3 dB, or, where one click would rule (crest over 12), energy to -20 dB. None for silence."""
    peak, rms = (float(np.abs(x).max()), float(np.sqrt((x**2).mean()))) if len(x) else (0.0, 0.0)
    if peak < 1e-6 or rms < 1e-8:
        return None
    return x * (0.1 / rms if peak / rms > 12 else 10 ** (-3 / 20) / peak)


def frames(x: np.ndarray, length: int, hop: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, length)[::hop] if len(x) >= length else np.zeros((0, length), np.float32)


def snr(x: np.ndarray, rate: int) -> float:
    rms = np.sqrt((frames(x, rate // 50, rate // 100) ** 2).mean(1))
    if not len(rms):
        return 0.0
    signal, noise = float(rms.mean()), float(np.percentile(rms, 10))
    return 0.0 if signal <= 0 else 60.0 if noise <= 0 else round(20 * float(np.log10(signal / noise)), 2)


def silence_ratio(x: np.ndarray, rate: int, threshold_db: float = -40.0) -> float:
    width = max(1, rate // 100)
    n = len(x) // width
    if not n:
        return 0.0
    rms = np.sqrt((x[: n * width].reshape(n, width) ** 2).mean(1))
    return round(float((20 * np.log10(rms + 1e-10) < threshold_db).mean() * 100), 1)


def speech_spans(x: np.ndarray, rate: int, min_silence: float = 0.5, threshold_db: float = -40.0, keep: float = 0.2) -> list[tuple[float, float]]:
    """Spans between silences of at least min_silence, with keep seconds of these on both sides."""
    width = max(1, rate // 100)
    n = -(-len(x) // width)
    padded = np.zeros(n * width, np.float32)
    padded[: len(x)] = x
    loud = 20 * np.log10(np.sqrt((padded.reshape(n, width) ** 2).mean(1)) + 1e-10) >= threshold_db
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(np.int8), [0]]))).reshape(-1, 2)
    joined: list[list[int]] = []
    for begin, end in edges.tolist():
        if joined and (begin - joined[-1][1]) * width < min_silence * rate:
            joined[-1][1] = end
        else:
            joined.append([begin, end])
    return [(max(0.0, b * width / rate - keep), min(len(x) / rate, e * width / rate + keep)) for b, e in joined]


def cut(duration: float, spans: list[tuple[float, float]], shortest: float = 3.0, longest: float = 30.0) -> list[tuple[float, float]]:
    """Segments: nothing of a short recording, all of a middling one, else its speech spans, cut hard at longest, short ones dropped."""
    if duration < shortest:
        return []
    if duration <= longest:
        return [(0.0, duration)]
    parts = [(b + i * longest, min(e, b + (i + 1) * longest)) for b, e in spans for i in range(int(np.ceil((e - b) / longest)))]
    return [(b, e) for b, e in parts if e - b >= shortest]


MEASURES = "snr_score double, silence_ratio double, rms double, samples long, duration double"


def measured(df: DataFrame, audio: str = "content") -> DataFrame:
    """Adds level measurements of a .wav column; -1 for what can't be read, which limits let pass."""

    def run(batches):
        for pdf in batches:
            rows = []
            for data in pdf[audio]:
                got = decode(data)
                if got is None:
                    rows.append((-1.0, -1.0, 0.0, 0, 0.0))
                else:
                    x, rate = got
                    rows.append((snr(x, rate), silence_ratio(x, rate), float(np.sqrt((x**2).mean())) if len(x) else 0.0, len(x), round(len(x) / rate, 3)))
            for i, name in enumerate(("snr_score", "silence_ratio", "rms", "samples", "duration")):
                pdf[name] = [r[i] for r in rows]
            yield pdf

    extra = T._parse_datatype_string(MEASURES).fields
    return df.mapInPandas(run, T.StructType([*df.schema.fields, *extra]))


def segmented(df: DataFrame, audio: str = "content", name: str = "file_name", shortest: float = 3.0, longest: float = 30.0) -> DataFrame:
    """One row a segment: file_name with _seg_001 and so on, start, end, duration, content (16-bit .wav)."""
    def run(batches):
        for pdf in batches:
            out = []
            for file, data in zip(pdf[name], pdf[audio], strict=True):
                got = decode(data)
                if got is None:
                    continue
                x, rate = got
                spans = speech_spans(x, rate) if len(x) / rate > longest else []
                for i, (b, e) in enumerate(cut(len(x) / rate, spans, shortest, longest), 1):
                    out.append((f"{file.rsplit('.', 1)[0]}_seg_{i:03d}.wav", b, e, round(e - b, 3), encode(x[int(b * rate) : int(e * rate)], rate)))
            yield pd.DataFrame(out, columns=["file_name", "start", "end", "duration", "content"])

    return df.select(name, audio).mapInPandas(run, "file_name string, start double, end double, duration double, content binary")


def music_features(x: np.ndarray, rate: int) -> list[float] | None:
    """Harmonic share, its continuity, spread of loud frames, spectral contrast, spread of onsets. The harmonic part is what a
    running median along time leaves in each frequency."""
    length, hop = 2048, 512
    if len(x) < 0.75 * rate or len(x) < length:
        return None
    spectrum = np.abs(np.fft.rfft(frames(x, length, hop) * np.hanning(length), axis=1))
    wide = lambda a, k: np.median(np.lib.stride_tricks.sliding_window_view(np.pad(a, ((k, k), (0, 0)), mode="edge"), 2 * k + 1, axis=0), axis=-1)
    along, across = wide(spectrum, 8), wide(spectrum.T, 8).T
    harmonic = spectrum * (along > across)
    share = harmonic.sum(1) / (spectrum.sum(1) + 1e-8)
    rms = np.sqrt((frames(x, length, hop) ** 2).mean(1))
    loud = rms[20 * np.log10(rms / (rms.max() + 1e-10) + 1e-10) > -30] if rms.max() > 1e-8 else rms
    loud = loud if len(loud) >= 4 else rms
    bands = np.array_split(np.sort(spectrum[:, 1:], axis=1), 6, axis=1)
    contrast = np.mean([20 * np.log10((b[:, -1] + 1e-8) / (b[:, 0] + 1e-8)) for b in bands])
    flux = np.maximum(np.diff(np.log1p(spectrum), axis=0), 0).mean(1)
    return [float(harmonic.sum() / (spectrum.sum() + 1e-8)), float((share > 0.28).mean()), float(loud.std() / (loud.mean() + 1e-8)), float(contrast), float(flux.var()) if len(flux) else 0.0]


def sigmoid(x: Column, centre: float, steep: float) -> Column:
    arg = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), -steep * (x - centre)))
    return 1 / (1 + F.exp(arg))


def music_score(features: Column) -> Column:
    """The weighted score of a feature array, as an expression."""
    parts = [w * sigmoid(F.get(features, i), c, k) for i, (w, (c, k)) in enumerate(zip(MUSIC_WEIGHTS, MUSIC_SHAPES, strict=True))]
    return sum(parts[1:], parts[0])


def music_vote(scores: Column, threshold: float = MUSIC_FROM) -> Column:
    """A strict majority of window scores reaches the threshold."""
    return F.size(F.filter(scores, lambda s: s >= threshold)) * 2 > F.size(scores)


def music_windows(df: DataFrame, audio: str = "content", name: str = "file_name") -> DataFrame:
    """(name, window, features) of one window of recordings under 6 s, else of three: at the start, in the middle, at the end."""
    def run(batches):
        for pdf in batches:
            out = []
            for file, data in zip(pdf[name], pdf[audio], strict=True):
                got = decode(data)
                x = levelled(got[0]) if got else None
                if x is None or len(x) < got[1]:
                    continue
                rate, size = got[1], min(len(x), 6 * got[1])
                for i, begin in enumerate(sorted({0, (len(x) - size) // 2, len(x) - size})):
                    if (f := music_features(x[begin : begin + size], rate)) is not None:
                        out.append((file, i, f))
            yield pd.DataFrame(out, columns=[name, "window", "features"])

    return df.select(name, audio).mapInPandas(run, f"{name} string, window int, features array<double>")


def with_music(df: DataFrame, audio: str = "content", name: str = "file_name") -> DataFrame:
    """Adds has_background_music: a tag, never a reason to drop."""
    scores = music_windows(df, audio, name).groupBy(name).agg(F.collect_list(music_score(F.col("features"))).alias("_scores"))
    return df.join(scores, name, "left").withColumn("has_background_music", F.coalesce(music_vote(F.col("_scores")), F.lit(False))).drop("_scores")


def dbscan(distance: np.ndarray, eps: float, least: int = 2) -> np.ndarray:
    """Labels from a distance matrix; -1 for noise."""
    near = distance <= eps
    core = near.sum(1) >= least
    labels, now = np.full(len(distance), -1), 0
    for i in range(len(distance)):
        if core[i] and labels[i] < 0:
            todo = [i]
            labels[i] = now
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & (labels < 0)):
                    labels[j] = now
                    if core[j]:
                        todo.append(int(j))
            now += 1
    return labels


# Percentile of the distances, and bounds, of each of the three radii; least share of a cluster's points.
RADII = [(25, 0.10, 0.45), (35, 0.15, 0.55), (50, 0.20, 0.65)]
SMALLEST_CLUSTER = 0.15


def two_pitches(voiced: np.ndarray) -> bool:
    """Whether the histogram of log2 pitch (30 bins) has two peaks that stand out: at least a quarter of the highest bin high,
    three bins apart, standing 15 % of it above their surroundings, the lower one over 0.30 of the higher."""
    if len(voiced) < 30:
        return False
    n = np.histogram(np.log2(voiced), bins=30)[0].astype(float)
    most = n.max()
    # A peak may be a plateau; it counts at its middle.
    edges = np.flatnonzero(np.diff(n)) + 1
    begins, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(n)]])
    peaks = [(b + e - 1) // 2 for b, e in zip(begins, ends, strict=True) if b > 0 and e < len(n) and n[b - 1] < n[b] > n[e]]
    peaks = [p for p in peaks if n[p] >= 0.25 * most]
    kept: list[int] = []
    for p in sorted(peaks, key=lambda p: (-n[p], -p)):
        if all(abs(p - q) >= 3 for q in kept):
            kept.append(p)
    heights = []
    for p in kept:
        higher = np.flatnonzero(n > n[p])
        left, right = higher[higher < p].max(initial=-1), higher[higher > p].min(initial=len(n))
        if n[p] - max(n[left + 1 : p + 1].min(), n[p:right].min()) >= 0.15 * most:
            heights.append(n[p])
    top = sorted(heights)[-2:]
    return len(top) == 2 and top[0] / (top[1] + 1e-8) > 0.30


def coherent(labels: np.ndarray, seconds: np.ndarray) -> bool:
    """Whether speakers' stretches are long (a second on average); fewer than four labelled segments tell nothing against it."""
    keep = labels >= 0
    labels, seconds = labels[keep], seconds[keep]
    if len(labels) < 4:
        return True
    starts = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
    return float(np.add.reduceat(seconds, starts).mean()) >= 1.0


def several_speakers(vectors: np.ndarray, seconds: np.ndarray, voiced: np.ndarray | None = None) -> bool:
    """Whether segment embeddings fall into clusters: each of three radii votes; two votes or more are held against the length
    of the stretches of the trial whose nearest centroids lie furthest apart, one vote or none, or fewer than four segments,
    leave it to the pitch."""
    voiced = np.zeros(0) if voiced is None else voiced
    if len(vectors) < 4:
        return len(vectors) >= 2 and two_pitches(voiced)
    sd = vectors.std(0)
    z = (vectors - vectors.mean(0)) / np.where(sd > 0, sd, 1)
    unit = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    distance = np.clip(1 - unit @ unit.T, 0, 2)
    np.fill_diagonal(distance, 0)
    upper = distance[np.triu_indices(len(z), 1)]
    trials = []
    for q, low, high in RADII:
        labels = dbscan(distance, float(np.clip(np.percentile(upper, q), low, high)))
        groups = [np.flatnonzero(labels == k) for k in range(labels.max() + 1)]
        if len(groups) < 2 or min(map(len, groups)) / (labels >= 0).sum() < SMALLEST_CLUSTER:
            continue
        centres = np.stack([z[g].mean(0) for g in groups])
        apart = np.linalg.norm(centres[:, None] - centres[None], axis=-1) + np.where(np.eye(len(groups), dtype=bool), np.inf, 0)
        trials.append((float(apart.min()), -len(trials), labels))
    if len(trials) < 2:
        return two_pitches(voiced)
    return coherent(max(trials, key=lambda t: t[:2])[2], seconds)


def speaker_tags(segments: DataFrame, file: str = "file_name") -> DataFrame:
    """(file, has_multiple_speakers) from (file, idx, seconds, embedding, and voiced, an array of pitches, where there is one):
    the segments of one recording together."""
    extra = ["voiced"] if "voiced" in segments.columns else []

    def tag(key, pdf):
        pdf = pdf.sort_values("idx")
        voiced = np.concatenate([np.zeros(0), *(np.asarray(v, float) for v in pdf["voiced"] if v is not None)]) if extra else None
        found = several_speakers(np.stack(pdf["embedding"].to_numpy()).astype(float), pdf["seconds"].to_numpy(float), voiced)
        return pd.DataFrame([(key[0], bool(found))], columns=[file, "has_multiple_speakers"])

    return segments.select(file, "idx", "seconds", "embedding", *extra).groupBy(file).applyInPandas(tag, f"{file} string, has_multiple_speakers boolean")


def mel_bank(rate: int, size: int, bands: int) -> np.ndarray:
    """Triangles of equal width on the mel scale, over the bins of a real transform, each of area one."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hz = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, size // 2 + 1)
    rise, fall = (f[None] - hz[:-2, None]) / np.diff(hz)[:-1, None], (hz[2:, None] - f[None]) / np.diff(hz)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (hz[2:] - hz[:-2]))[:, None]


def log_mel(x: np.ndarray, rate: int = RATE, bands: int = 80, size: int = 2048, hop: int = 512) -> np.ndarray:
    """Log power (dB, at most 80 below the loudest) of mel bands by frame; a recording shorter than a frame is filled up."""
    x = np.pad(np.asarray(x, np.float32), (0, max(0, size - len(x))))
    power = np.abs(np.fft.rfft(frames(x, size, hop) * np.hanning(size + 1)[:-1], axis=1)) ** 2
    db = 10 * np.log10(np.maximum(power @ mel_bank(rate, size, bands).T, 1e-10))
    return np.maximum(db, db.max() - 80)


def pitch(x: np.ndarray, rate: int = RATE, low: float = 70.0, high: float = 400.0, size: int = 2048, hop: int = 512) -> np.ndarray:
    """Pitch by frame: the first dip under 0.1 of the cumulative mean normalised difference, else its least value."""
    longest, shortest = int(rate / low), max(1, int(rate / high))
    out = []
    for f in frames(np.asarray(x, float), size, hop):
        half = size - longest
        energy = np.concatenate([[0], np.cumsum(f * f)])
        spectrum = np.fft.rfft(f, 2 * size)
        cross = np.fft.irfft(np.conj(np.fft.rfft(f[:half], 2 * size)) * spectrum)[: longest + 1]
        lags = np.arange(longest + 1)
        difference = energy[half] + energy[lags + half] - energy[lags] - 2 * cross
        mean = difference[1:] * lags[1:] / np.maximum(np.cumsum(difference[1:]), 1e-12)
        part = mean[shortest - 1 :]
        dips = np.flatnonzero((part[1:-1] < 0.1) & (part[1:-1] <= part[:-2]) & (part[1:-1] < part[2:]))
        out.append(rate / (shortest + (dips[0] + 1 if len(dips) else int(part.argmin()))))
    return np.array(out)


def voice_segments(x: np.ndarray, rate: int = RATE, top_db: float = 28.0, shortest: float = 0.5) -> list[tuple[int, int]]:
    """Stretches (in samples) within top_db of the loudest frame, of at least shortest seconds."""
    size, hop = 2048, 512
    rms = np.sqrt((frames(np.pad(x, size // 2), size, hop) ** 2).mean(1))
    loud = 20 * np.log10(np.maximum(rms, 1e-10)) > 20 * np.log10(max(float(rms.max(initial=0)), 1e-10)) - top_db
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(np.int8), [0]]))).reshape(-1, 2) * hop
    return [(int(b), min(int(e), len(x))) for b, e in edges if min(e, len(x)) - b >= shortest * rate]


def voice_embedding(x: np.ndarray, rate: int = RATE, kept: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of 20 cepstral coefficients and of log2 pitch (42 numbers), and the voiced pitches."""
    mel = log_mel(x, rate, 128)
    n = mel.shape[1]
    turn = np.cos(np.pi / n * (np.arange(n) + 0.5)[:, None] * np.arange(kept)[None]) * np.where(np.arange(kept) == 0, np.sqrt(1 / n), np.sqrt(2 / n))
    cepstrum = mel @ turn
    f0 = pitch(x, rate)
    voiced = f0[(f0 > 70) & (f0 < 400)]
    tone = [np.log2(voiced).mean(), np.log2(voiced).std()] if len(voiced) else [0.0, 0.0]
    return np.concatenate([cepstrum.mean(0), cepstrum.std(0), tone]), voiced


def has_several_speakers(x: np.ndarray, rate: int) -> bool:
    """From samples, by the first two minutes: speech of less than 2.5 s, or of one stretch, has one speaker."""
    x = levelled(resampled(x[: 121 * rate], rate)[: 120 * RATE])
    if x is None or len(x) < 2.5 * RATE:
        return False
    spans = voice_segments(x)
    if len(spans) < 2:
        return False
    made = [voice_embedding(x[b:e]) for b, e in spans]
    return several_speakers(np.stack([m[0] for m in made]), np.array([(e - b) / RATE for b, e in spans]), np.concatenate([m[1] for m in made]))


def with_speakers(df: DataFrame, audio: str = "content", to: str = "has_multiple_speakers") -> DataFrame:
    """Adds a tag, never a reason to drop; False for what can't be read."""

    def run(batches):
        for pdf in batches:
            found = [decode(d) for d in pdf[audio]]
            pdf[to] = [bool(g is not None and has_several_speakers(*g)) for g in found]
            yield pdf

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(to, T.BooleanType())]))


def word_errors(reference: list[str], guess: list[str]) -> int:
    """Edits between two word lists, a column of the table at a time as the bits of integers (where it rises and falls)."""
    if not reference:
        return len(guess)
    at: dict[str, int] = {}
    for i, x in enumerate(reference):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << len(reference)) - 1, 1 << len(reference) - 1
    rises, falls, edits = full, 0, len(reference)
    for x in guess:
        equal = at.get(x, 0)
        level = ((equal & rises) + rises ^ rises | equal | falls) & full
        up, down = falls | full & ~(level | rises), level & rises
        edits += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        rises, falls = down | full & ~(level | up), up & level
    return edits


def _edits(reference: pd.Series, guess: pd.Series) -> pd.Series:
    return pd.Series([word_errors((a or "").split(), (b or "").split()) for a, b in zip(reference, guess, strict=True)])


def word_error_rate(df: DataFrame, reference: str, guess: str) -> DataFrame:
    """Edits over reference words of the whole set, as written and without case and marks; empty references are left out."""
    edits = F.pandas_udf(_edits, "long")
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w\s']+", ""))
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    rows = df.where(F.trim(reference) != "").select(F.col(reference).alias("r"), F.coalesce(guess, F.lit("")).alias("g"))
    rows = rows.select("r", "g", plain(F.col("r")).alias("rn"), plain(F.col("g")).alias("gn"))
    sums = rows.agg(F.sum(edits("r", "g")).alias("e"), F.sum(words(F.col("r"))).alias("n"), F.sum(F.when(F.col("rn") != "", edits("rn", "gn"))).alias("en"), F.sum(words(F.col("rn"))).alias("nn"))
    return sums.select((F.try_divide(F.col("e") * 100, F.col("n"))).alias("wer_ortho"), (F.try_divide(F.col("en") * 100, F.col("nn"))).alias("wer"))
