"""Media columns: payloads kept as WAV files in binary columns, and fingerprints of spectral-peak pairs.

Samples are 8-bit mono. The short-time Fourier transform uses Hann windows;
in each frame the strongest local peaks of the spectrum become landmarks, and
each landmark is paired with the next few landmarks of later frames.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.llm.common import fresh, tidy
from wharfline.llm.text import raw, steps

#: Payloads are padded with spaces to a positive multiple of this many samples.
UNIT = 192
RATE = 8000
WINDOW = 384
HOP = 192
PEAKS = 2
FAN_OUT = 3
#: Frames transformed at once; a long recording goes through in such blocks.
BLOCK = 2048
#: Media bytes of a step of a task.
STEP = 1 << 20

_HANN = np.hanning(WINDOW).astype(np.float32)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """The payload, padded, as the samples of an 8-bit mono WAV file."""
    payload += b" " * (-len(payload) % UNIT or UNIT * (not payload))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def landmarks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and frequency bins of the ``PEAKS`` strongest local peaks of each frame with any energy, by frame, then bin."""
    count = max(1, 1 + (len(samples) - WINDOW) // HOP)
    signal = samples.astype(np.float32) - 128
    if len(signal) < WINDOW:
        signal = np.pad(signal, (0, WINDOW - len(signal)))
    frames = np.lib.stride_tricks.sliding_window_view(signal, WINDOW)[::HOP][:count]
    times, bins = [], []
    for at in range(0, count, BLOCK):
        part = frames[at : at + BLOCK]
        power = np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * _HANN, axis=1)).astype(np.float32)
        inner = power[:, 1:-1]
        peak = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > 1e-3), inner, 0)
        top = np.sort(np.argpartition(peak, -PEAKS, axis=1)[:, -PEAKS:], axis=1)
        real = np.take_along_axis(peak, top, axis=1) > 0
        t, k = np.nonzero(real)
        times.append(t + at)
        bins.append(top[t, k] + 1)
    return np.concatenate(times), np.concatenate(bins)


def peak_pairs(samples: np.ndarray) -> np.ndarray:
    """Time-coded fingerprints as longs: frame << 40 | first bin << 32 | second bin << 24 | frames between. Frames stay below 2^23, samples below 2^31."""
    t, f = landmarks(samples)
    codes = []
    for k in range(1, FAN_OUT + 1):
        dt = t[k:] - t[:-k]
        ok = dt >= 1
        codes.append((t[:-k][ok] << 40) | (f[:-k][ok] << 32) | (f[k:][ok] << 24) | dt[ok])
    return np.sort(np.concatenate(codes)).astype(np.int64)


def store_text(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all but the text, by default) with ``n_bytes`` of the text in UTF-8 and ``media``, the text as a WAV file.

    A null text counts as empty; an empty one becomes one unit of spaces. Long
    texts are kept whole. An empty table gives an empty table. Columns named n_bytes or media are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (text, "n_bytes", "media")]
    body = fresh("text")

    def build(batches):
        for batch in steps(batches, body, STEP):
            data, at = raw(batch.column(body))
            whole = data.tobytes()
            media = [to_wav(whole[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.record_batch([*batch.columns[:-1], pa.array(np.diff(at)), pa.array(media, pa.binary())], [*kept, "n_bytes", "media"])

    frame = docs.select(*kept, F.col(text).alias(body))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])
    return frame.mapInArrow(tidy(build), f"{kinds + ', ' if kinds else ''}n_bytes bigint, media binary")


def analyse(recordings: DataFrame, *, media: str = "media") -> DataFrame:
    """Reads the WAV file of each row back: all columns but ``media``, and payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes), media_bytes, media_sha256 and ``fingerprint``, the peak pairs as array<bigint>.

    A null file gives null results. Columns named like the new ones are replaced.
    """
    kept = [c for c in recordings.columns if c not in (media, *FEATURES)]
    file = fresh("media")

    def read(batches):
        for batch in steps(batches, file, STEP):
            rows = []
            for value in batch.column(file):
                if (body := value.as_py()) is None:
                    rows.append((None,) * 6)
                    continue
                payload = from_wav(body)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(body), hashlib.sha256(body).hexdigest(), peak_pairs(np.frombuffer(payload, np.uint8))))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            yield pa.record_batch([*batch.columns[:-1], *[pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]], [*kept, *FEATURES])

    frame = recordings.select(*kept, F.col(media).alias(file))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields[:-1])
    return frame.mapInArrow(tidy(read), kinds + "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, fingerprint array<bigint>")


FEATURES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprint"]
