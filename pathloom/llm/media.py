"""Media columns: bytes as WAV samples, their spectrogram, and fingerprints of pairs of spectral peaks.

A payload is kept as an 8-bit mono WAV, written and read by the wave module, so it comes back bit by bit. Its
spectrogram is a short-time Fourier transform with a Hann window. In each frame the strongest bin of each band is a peak
if it's above that band's mean in the whole payload; each peak is paired with the next few peaks in time, and a pair's
fingerprint is (first bin, second bin, frames between them), stored beside the frame of the first peak.
Every payload is transformed on its own, in blocks of fixed size, so equal payloads have equal fingerprints.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, map_rows, texts

RATE, FRAME, HOP, BLOCK = 8000, 512, 256, 2048
#: First bins of the bands, and the end of the last.
BANDS = (1, 11, 21, 41, 81, 161, 257)
FAN, REACH = 3, 63


def to_wav(payload: bytes) -> bytes:
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return f.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono is expected")
        return w.readframes(w.getnframes())


def spectrogram(samples: np.ndarray) -> np.ndarray:
    """Magnitudes, frames x bins, of unsigned 8-bit samples. The last frame is filled with silence."""
    x = (samples.astype(np.float32) - 128) / 128
    n = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    return np.concatenate([np.abs(np.fft.rfft(frames[k : k + BLOCK] * window)) for k in range(0, n, BLOCK)])


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and pair codes, by frame, then by the order of the peaks."""
    s = spectrogram(samples)
    bins = np.stack([a + s[:, a:b].argmax(1) for a, b in zip(BANDS, BANDS[1:], strict=False)], 1)
    height = np.take_along_axis(s, bins, 1)
    at, band = np.nonzero((height >= height.mean(0, keepdims=True)) & (height > 0))
    f = bins[at, band]
    times, codes, order = [], [], []
    for k in range(1, FAN + 1):
        gap = at[k:] - at[:-k]
        near = np.flatnonzero(gap <= REACH)
        times.append(at[near])
        codes.append(f[near] << 15 | f[near + k] << 6 | gap[near])
        order.append(near * FAN + k)
    by = np.argsort(np.concatenate(order), kind="stable")
    return np.concatenate(times)[by].astype(np.int32), np.concatenate(codes)[by].astype(np.int32)


def padded(text: bytes, unit: int = 192) -> bytes:
    return text + b" " * ((-len(text)) % unit if text else unit)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media binary): each row's text as a WAV. Null texts count as empty ones, which are 192 spaces."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return batch(doc_id=b.column(0), media=pa.array([to_wav(padded(t)) for t in b.column(1).to_pylist()], pa.binary()))

    return map_rows(texts(docs, id_col, text_col, as_bytes=True), run, "doc_id long, media binary")


def fingerprints(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, frames array<int>, codes array<int>): time-coded pair fingerprints of WAVs; null ones have none."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        none = np.zeros(0, np.int32)
        found = [fingerprint(np.frombuffer(from_wav(m), np.uint8)) if m else (none, none) for m in b.column(1).to_pylist()]
        kind = pa.list_(pa.int32())
        return batch(doc_id=b.column(0), frames=pa.array([t for t, _ in found], kind), codes=pa.array([c for _, c in found], kind))

    return map_rows(media.select(media[id_col].cast("long").alias("doc_id"), media[media_col].alias("media")), run, "doc_id long, frames array<int>, codes array<int>")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a WAV, reads it back and fingerprints what was read; returns digests of each step, in one row
    for each row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature
    (number of pairs, and SHA-256 of their frames and codes). Null texts count as empty ones, whose payload is 192
    spaces. Repeated rows, null doc_ids and other columns don't matter. Nothing is shuffled."""

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        for t in b.column(1).to_pylist():
            media = to_wav(padded(t))
            back = from_wav(media)
            frames, codes = fingerprint(np.frombuffer(back, np.uint8))
            feature = f"{len(codes)}:{hashlib.sha256(frames.tobytes() + codes.tobytes()).hexdigest()}"
            yield len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, size, sha, tail, stored, stored_sha, feature = zip(*rows(b), strict=True)
        long = pa.int64()
        return batch(doc_id=b.column(0), n_bytes=pa.array(n, long), payload_bytes=pa.array(size, long), payload_sha256=pa.array(sha), tail_crc32=pa.array(tail, long), media_bytes=pa.array(stored, long), media_sha256=pa.array(stored_sha), feature=pa.array(feature))

    return map_rows(texts(docs, id_col, text_col, as_bytes=True), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
