import hashlib
import io
import wave
import zlib

import numpy as np
from conftest import DATA

from wharfline.llm import media, queries


def brute(text):
    body = (text or "").encode()
    padded = body + b" " * (-len(body) % 192 if body else 192)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, media.RATE, 0, "NONE", ""))
        w.writeframes(padded)
    return len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]), len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest()


def test_query(spark):
    got = queries.queries()["op3_media_fingerprints"](spark, DATA).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(got) == len(texts)
    features = {}
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == brute(texts[r.doc_id])
        assert features.setdefault(texts[r.doc_id], r.feature) == r.feature


def test_odd_documents(odd_docs, no_docs, texts):
    stored = media.store_text(odd_docs)
    assert "media" in stored.columns and "score" in stored.columns
    got = media.analyse(stored).collect()
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256) for r in got) == sorted(brute(t)[:3] for _, t, _ in texts)
    assert media.analyse(media.store_text(no_docs)).count() == 0


def test_tones_are_found():
    t = np.arange(192 * 20)
    for bins in (20, 60):
        tone = (128 + 100 * np.sin(2 * np.pi * bins * t / media.WINDOW)).astype(np.uint8)
        times, found = media.landmarks(tone)
        assert (found == bins).sum() >= len(set(times)) - 1
    pairs = media.peak_pairs(tone)
    assert len(pairs) and ((pairs >> 40) < 20).all() and (np.diff(pairs) >= 0).all()
    assert len(media.peak_pairs(np.full(192, 32, np.uint8))) == 0


def brute_pairs(samples):
    """Peaks of a plain transform, each paired with the next few of later frames."""
    signal, marks = samples.astype(np.float64) - 128, []
    signal = np.pad(signal, (0, max(0, media.WINDOW - len(signal))))
    for t in range(1 + (len(signal) - media.WINDOW) // media.HOP):
        part = signal[t * media.HOP : t * media.HOP + media.WINDOW]
        power = np.abs(np.fft.rfft((part - part.mean()) * np.hanning(media.WINDOW)))
        peaks = [k for k in range(1, len(power) - 1) if power[k] > power[k - 1] and power[k] >= power[k + 1] and power[k] > 1e-3]
        marks += [(t, k) for k in sorted(sorted(peaks, key=lambda k: -power[k])[: media.PEAKS])]
    return sorted((t << 40) | (f << 32) | (g << 24) | (u - t) for i, (t, f) in enumerate(marks) for u, g in marks[i + 1 : i + 1 + media.FAN_OUT] if u > t)


def test_pairs_are_the_brute_force():
    noise = np.random.default_rng(3).integers(0, 256, 192 * 40).astype(np.uint8)
    gap = np.concatenate([noise[: 192 * 3], np.full(192 * 400, 128, np.uint8), noise[-192 * 3 :]])
    for samples in (noise, gap, noise[:192]):
        assert media.peak_pairs(samples).tolist() == brute_pairs(samples)
    assert (media.peak_pairs(gap) & 0xFFFFFF).max() > 255


def test_query_returns_the_arrays(spark):
    for r in queries.queries()["op3_media_fingerprints"](spark, DATA).limit(50).collect():
        assert r.feature == f"{len(r.fingerprint)}:{hashlib.sha256(','.join(map(str, r.fingerprint)).encode()).hexdigest()}"


def test_blocks_change_nothing(monkeypatch):
    samples = np.random.default_rng(0).integers(0, 256, 192 * 50).astype(np.uint8)
    whole = media.peak_pairs(samples)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert (media.peak_pairs(samples) == whole).all()
