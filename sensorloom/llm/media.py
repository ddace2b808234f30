"""Media columns: payloads as 8-bit WAV, and fingerprints of spectral-peak pairs.

A payload is the UTF-8 text (null: empty) with bytes 32 appended up to a positive multiple of ``UNIT``. The wave module
writes it as unsigned 8-bit mono samples into a binary column and reads it back without loss. A short-time Fourier
transform (Hann frames of ``FRAME`` samples, ``UNIT`` apart; the last is filled with silence) gives one spectral peak
for each band of each frame. Each peak is an anchor that pairs with the peaks of the same band in the next ``REACH``
frames; pairs that move at least one bin are kept. A pair is one integer: frame, bin, later bin, distance; the array is
ordered by time.

Each row is a function of its own text, so equal texts give equal values, a null id passes and repeated rows repeat.
There is no shuffle; a task holds one batch of payloads and ``CHUNK`` frames of one payload.
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
from pyspark.sql import functions as F

from sensorloom.llm.text import byte_values, in_slices

UNIT = 192
RATE = 8_000
FRAME = 256
REACH = 2
#: Frames transformed at once.
CHUNK = 1_024
SLICE_BYTES = 4_000_000
#: Bins of each band: first, and one past the last.
BANDS = ((2, 8), (8, 20), (20, 48), (48, 129))


def padded(text: bytes) -> bytes:
    return text + b" " * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if r.getsampwidth() != 1 or r.getnchannels() != 1:
            raise ValueError("not an 8-bit mono recording")
        return r.readframes(r.getnframes())


def _peaks(samples: np.ndarray) -> np.ndarray:
    """The strongest bin of each band of each frame; frames are transformed ``CHUNK`` at a time."""
    n = max(1, -(-(len(samples) - FRAME) // UNIT) + 1)
    window = np.hanning(FRAME).astype(np.float32)
    out = np.empty((n, len(BANDS)), np.int64)
    for first in range(0, n, CHUNK):
        last = min(n, first + CHUNK)
        part = samples[first * UNIT : (last - 1) * UNIT + FRAME].astype(np.float32) - 128
        whole = np.zeros((last - first - 1) * UNIT + FRAME, np.float32)
        whole[: len(part)] = part
        power = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(whole, FRAME)[::UNIT] * window, axis=1))
        level = np.round(np.log1p(power), 3)
        for k, (a, b) in enumerate(BANDS):
            out[first:last, k] = a + level[:, a:b].argmax(1)
    return out


def fingerprint(payload: bytes) -> np.ndarray:
    """Time-coded peak pairs: frame * 2**20 + bin * 2**12 + later bin * 2**4 + distance, ascending in time."""
    peaks = _peaks(np.frombuffer(payload, np.uint8))
    n, pairs = len(peaks), []
    for distance in range(1, REACH + 1):
        if n > distance:
            here, later = peaks[:-distance], peaks[distance:]
            code = (np.arange(n - distance)[:, None] << 20) + (here << 12) + (later << 4) + distance
            pairs.append(code[here != later])
    return np.sort(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (without padding), media (WAV bytes)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_values(batch["text"])
            for a, b in in_slices(texts, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array([to_wav(padded(t)) for t in texts[a:b]], pa.binary())], ["id", "n_bytes", "media"])

    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def media_features(media: DataFrame, id_col: str = "doc_id", arrays: bool = True) -> DataFrame:
    """Reads the media column back. Per row: id, n_bytes, payload and media digests, feature (number of pairs and digest
    of the fingerprint) and, with ``arrays``, the fingerprint itself."""
    kind = media.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", fingerprint array<bigint>" * arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for stored in (x.as_py() for x in batch["media"]):
                payload = from_wav(stored)
                prints = fingerprint(payload)
                said = f"{len(prints)}:{hashlib.sha256(prints.astype('<i8').tobytes()).hexdigest()[:32]}"
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), said, prints)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprint"]
            keep = 7 if arrays else 6
            yield pa.RecordBatch.from_arrays([batch["id"], batch["n_bytes"], *(pa.array(c, t) for c, t in list(zip(out, types, strict=True))[:keep])], ["id", "n_bytes", *names[:keep]])

    return media.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("id", id_col)
