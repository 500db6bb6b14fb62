"""Audio columns: bytes kept as 8-bit PCM, and features read from the stored bytes.

Features: polyphase resampling, log-mel filterbanks of overlapped frames, segments by energy with hysteresis. They are
stored as Arrow fixed-shape tensors, each with the time span it covers.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.llm.common import bound_batches, map_columns, written

UNIT, PAD = 192, b" "
STORED_RATE, RATE = 16_000, 8_000
FRAME, HOP, FFT, MELS = 200, 80, 256, 32
#: Frames of a tensor, which overlaps none.
TENSOR_FRAMES = 64
#: A segment begins where a frame's energy is above the text's median by ON dB, and ends where it is below it by OFF dB.
ON_DB, OFF_DB = 1.5, -1.5
TAPS = 16


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 with spaces behind, up to a positive multiple of UNIT; and the length without them."""
    data = text.encode()
    return data + PAD * ((-len(data)) % UNIT or (0 if data else UNIT)), len(data)


def store(payload: bytes) -> bytes:
    """A .wav file of one channel whose 8-bit samples are the payload."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(STORED_RATE)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as w:
        assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
        return w.readframes(w.getnframes()), w.getframerate()


@cache
def low_pass(up: int, down: int) -> np.ndarray:
    """A windowed sinc at the lower of the two rates, TAPS lobes wide."""
    wide = max(up, down)
    n = np.arange(-TAPS * wide // 2, TAPS * wide // 2 + 1)
    h = np.sinc(n / wide) * np.blackman(len(n))
    return (up * h / h.sum()).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase resampling by up / down: only samples that come out are worked out, and no inserted zero is touched."""
    h = low_pass(up, down)
    n_out = -(-len(x) * up // down)
    delay = len(h) // 2
    span = -(-len(h) // up) + 1
    # y[n] = sum over k of h[k * up + phase] * x[base - k], where n * down + delay = base * up + phase.
    padded = np.concatenate([np.zeros(span + down, np.float32), x, np.zeros(span + delay // up + down + 1, np.float32)])
    out = np.empty(n_out, np.float32)
    for first in range(min(up, n_out)):
        base, phase = divmod(first * down + delay, up)
        taps = h[phase::up]
        count = len(range(first, n_out, up))
        total = np.zeros(count, np.float32)
        for j in range(min(down, len(taps))):
            part = taps[j::down]
            begin = base - j + span + down - (len(part) - 1) * down
            lane = padded[begin : begin + (count + len(part) - 2) * down + 1 : down]
            total += np.convolve(np.ascontiguousarray(lane), part, "valid")
        out[first::up] = total
    return out


@cache
def mel_bank() -> np.ndarray:
    """Triangles, equally wide in mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(60), mel(RATE / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * RATE / FFT
    rise = (bins[None, :] - points[:-2, None]) / (points[1:-1] - points[:-2])[:, None]
    fall = (points[2:, None] - bins[None, :]) / (points[2:] - points[1:-1])[:, None]
    return np.maximum(np.minimum(rise, fall), 0).astype(np.float32).T


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies by frame, and each frame's energy in dB. The last frame is filled up with silence."""
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(x)] = x[: len(padded)]
    window = np.hanning(FRAME).astype(np.float32)
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for k in range(0, n, 4096):
        frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[k * HOP : (k + 4095) * HOP + 1 : HOP][: min(4096, n - k)]
        energy[k : k + 4096] = 10 * np.log10((frames * frames).mean(1) + 1e-10)
        spectrum = np.fft.rfft(frames * window, FFT, axis=1)
        mel[k : k + 4096] = np.log10((spectrum.real**2 + spectrum.imag**2) @ mel_bank() + 1e-10)
    return mel, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Spans [begin, end) of frames: on from above the upper threshold until below the lower one."""
    middle = np.median(energy)
    state = np.where(energy > middle + ON_DB, 1, np.where(energy < middle + OFF_DB, 0, -1))
    last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(last >= 0, state[last], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


#: Log energies lie between -10 and about 6: half floats hold them to 1/128.
TENSOR = pa.fixed_shape_tensor(pa.float16(), (TENSOR_FRAMES, MELS))


def tensors(mel: np.ndarray) -> pa.RecordBatch:
    """Tensors of TENSOR_FRAMES x MELS (the last filled up with the floor), each with begin and end in seconds."""
    n = -(-len(mel) // TENSOR_FRAMES)
    full = np.full((n * TENSOR_FRAMES, MELS), -10, np.float32)
    full[: len(mel)] = mel
    begin = np.arange(n) * TENSOR_FRAMES
    end = np.minimum(begin + TENSOR_FRAMES, len(mel))
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1).astype(np.float16)), TENSOR_FRAMES * MELS)
    spans = [pa.array(begin * HOP / RATE), pa.array(((end - 1) * HOP + FRAME) / RATE)]
    return pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(TENSOR, storage), *spans], names=["log_mel", "begin_s", "end_s"])


def to_ipc(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def from_ipc(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def analyse(media: bytes) -> tuple[bytes, np.ndarray, list[tuple[int, int]]]:
    """The payload as read back, log-mel frames, and segments."""
    payload, rate = load(media)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    common = np.gcd(RATE, rate)
    mel, energy = log_mel(resample(x, RATE // int(common), rate // int(common)))
    return payload, mel, segments(energy)


def describe(batch: pa.RecordBatch, spans: list[dict]) -> str:
    """Seconds, tensors, segments, seconds in segments, and a digest of the tensors."""
    values = batch.column(0).storage.values.to_numpy(zero_copy_only=False)
    digest = hashlib.sha1(np.asarray(values, "<f2").tobytes()).hexdigest()[:16]
    active = sum(s["end_s"] - s["begin_s"] for s in spans)
    return f"seconds={batch.column(2)[-1].as_py():.3f};tensors={batch.num_rows};segments={len(spans)};active={active:.3f};mel={digest}"


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's payload as a .wav file, in a table of the shared folder."""
    bound_batches(docs.sparkSession, 512)

    def make(batches):
        for b in batches:
            got = [payload_of(t) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "n_bytes": [n for _, n in got], "media": [store(p) for p, _ in got]}

    return written(map_columns(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id long, n_bytes long, media binary", make), "media")


SEGMENTS = "array<struct<begin_s: double, end_s: double>>"


def media_features(media: DataFrame) -> DataFrame:
    """Per stored row, written to a table of the shared folder: doc_id, n_bytes, what was read back (payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256), tensors (an Arrow IPC stream of fixed-shape tensors, each with
    the span of time it covers) and segments (begin_s, end_s)."""

    def make(batches):
        for b in batches:
            got = [analyse(m) for m in b["media"]]
            yield {
                "doc_id": b["doc_id"],
                "n_bytes": b["n_bytes"],
                "payload_bytes": [len(p) for p, _, _ in got],
                "payload_sha256": [hashlib.sha256(p).hexdigest() for p, _, _ in got],
                "tail_crc32": [zlib.crc32(p[-16:]) for p, _, _ in got],
                "media_bytes": [len(m) for m in b["media"]],
                "media_sha256": [hashlib.sha256(m).hexdigest() for m in b["media"]],
                "tensors": [to_ipc(tensors(mel)) for _, mel, _ in got],
                "segments": [[{"begin_s": s * HOP / RATE, "end_s": ((e - 1) * HOP + FRAME) / RATE} for s, e in spans] for _, _, spans in got],
            }

    fields = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary, segments {SEGMENTS}"
    return written(map_columns(media, fields, make), "media-features")


def media_report(docs: DataFrame) -> DataFrame:
    """What was stored of every text, and a description of its features, from the tables as read back.

    Null and empty texts are one unit of padding; equal texts give equal values; an empty table gives an empty one; other
    columns are left out.
    """
    kept = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")

    def report(batches):
        for b in batches:
            yield {c: b[c] for c in kept} | {"feature": [describe(from_ipc(t), s) for t, s in zip(b["tensors"], b["segments"], strict=True)]}

    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_columns(media_features(stored_media(docs)), fields, report)
