import hashlib
import random
import zlib

import numpy as np

from sensorloom.llm import media
from sensorloom.session import table


def test_round_trip(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").limit(60).collect()]
    rows += [(None, None), (-1, ""), (-2, "x" * 192), (-3, "é" * 97), (-4, "x" * 500_000), (-5, rows[0][1]), (-5, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as media", "2 as n_bytes", "3 as id")
    got = media.media_features(media.encode_media(docs))
    out = {}
    for r in got.collect():
        out.setdefault(r.doc_id, r)
    assert got.count() == len(rows)
    for doc, text in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = out[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_bytes == len(payload) + 44
        assert r.feature.split(":")[0] == str(len(r.fingerprint))
    assert out[-5].feature == out[rows[0][0]].feature
    assert media.encode_media(docs.limit(0)).count() == 0


def test_peaks_follow_tones():
    t = np.arange(192 * 40)
    tone = lambda b: np.sin(2 * np.pi * b * t / 256)
    still = (128 + 60 * tone(30)).astype(np.uint8).tobytes()
    bins = media.fingerprint(still) >> 12 & 255
    assert not ((bins >= 20) & (bins < 48)).any()  # a steady tone doesn't move in its band
    moved = (128 + 60 * np.where(t < len(t) // 2, tone(25), tone(40))).astype(np.uint8).tobytes()
    codes = media.fingerprint(moved)
    assert ((codes >> 12 & 255 == 25) & (codes >> 4 & 255 == 40)).any()
    assert (np.diff(codes >> 20) >= 0).all()


def test_chunks_agree(monkeypatch):
    payload = np.random.default_rng(1).integers(0, 256, 192 * 301, np.uint8).tobytes()
    whole = media.fingerprint(payload)
    for chunk in (1, 7, 300, 301):
        monkeypatch.setattr(media, "CHUNK", chunk)
        assert (media.fingerprint(payload) == whole).all()


def test_fingerprint_by_its_definition():
    rng = random.Random(8)
    text = "".join(rng.choices("abc DEF\n.", k=4_000)).encode()
    payload = media.padded(text)
    samples = [b - 128 for b in payload] + [0] * media.FRAME
    peaks = []
    for at in range(0, max(1, len(payload) - media.FRAME + media.UNIT), media.UNIT):
        frame = np.array(samples[at : at + media.FRAME], np.float32) * np.hanning(media.FRAME).astype(np.float32)
        power = np.abs(np.fft.rfft(frame))
        peaks.append([a + int(np.round(np.log1p(power), 3)[a:b].argmax()) for a, b in media.BANDS])
    want = [(k << 20) + (p << 12) + (q << 4) + d for k, own in enumerate(peaks) for d in range(1, media.REACH + 1) if k + d < len(peaks) for p, q in zip(own, peaks[k + d]) if p != q]
    assert media.fingerprint(payload).tolist() == sorted(want)
