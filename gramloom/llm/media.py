"""Media columns: payloads stored as 8-bit WAV, read by the wave module, fingerprinted by spectral peak pairs.

``encode_wav`` turns a binary payload into the bytes of a mono 8-bit WAV file, a byte a sample;
``read_wav`` and ``fingerprint`` go the other way. A payload's short-time Fourier transform has
frames of ``FRAME`` samples every ``HOP`` samples under a Hann window. In each frame, the largest bin
of each band of ``BANDS`` is a peak if it exceeds the same bin in the frames before and after. Each
peak is paired with the next ``FAN`` peaks at most ``MAX_DT`` frames later. A pair's code is
f1 << 16 | f2 << 8 | dt; it is stored beside the anchor's frame number, as two arrays of equal length.

Defined results: a null text is an empty one, whose payload is 64 zero bytes (no peaks, empty
arrays). Rows are independent, so repeated rows give repeated results, an empty table an empty one,
and extra columns don't matter. Memory is bounded by a batch of texts, their
peaks and the spectra of two chunks of ``CHUNK`` frames.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Store, table, utf8

FRAME, HOP, RATE, BANDS, FAN, MAX_DT, CHUNK, BLOCK = 256, 128, 8000, ((1, 8), (8, 24), (24, 64), (64, 129)), 3, 31, 2048, 64


def payload(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes, padded with zero bytes up to a positive multiple of ``BLOCK``, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % BLOCK or (BLOCK if not raw else 0)), len(raw)


def encode_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("mono 8-bit samples are expected")
        return w.readframes(w.getnframes())


def _spectrum(samples: np.ndarray, first: int, last: int) -> np.ndarray:
    """Magnitudes of the frames first .. last - 1, a frame's row with its bins; what is past the end counts as silence."""
    part = samples[first * HOP : (last - 1) * HOP + FRAME]
    full = np.zeros((last - first - 1) * HOP + FRAME, np.float32)
    full[: len(part)] = part
    full[: len(part)] -= 128
    frames = np.lib.stride_tricks.sliding_window_view(full, FRAME)[::HOP]
    return np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1))


def _peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of each peak, by frame; one chunk of the spectrum and the first frame of the next are held."""
    n = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    times, bins = [], []
    silence = np.zeros((1, FRAME // 2 + 1))
    before, mag = silence, _spectrum(samples, 0, min(CHUNK, n))
    for k in range(0, n, CHUNK):
        follow = _spectrum(samples, k + CHUNK, min(k + 2 * CHUNK, n)) if k + CHUNK < n else silence
        around = np.vstack([before, mag, follow[:1]])
        rows = np.arange(len(mag))[:, None]
        top = np.stack([lo + mag[:, lo:hi].argmax(1) for lo, hi in BANDS], 1)
        high = mag[rows, top]
        t, band = np.nonzero((high > around[rows, top]) & (high > around[rows + 2, top]) & (high > 1.0))
        times.append(t + k)
        bins.append(top[t, band])
        before, mag = mag[-1:], follow
    return np.concatenate(times), np.concatenate(bins)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Anchors' frame numbers and pair codes, by time."""
    t, f = _peaks(np.frombuffer(samples, np.uint8))
    times, codes = [], []
    for k in range(1, FAN + 1):
        if len(t) > k:
            dt = t[k:] - t[:-k]
            near = dt <= MAX_DT
            times.append(t[:-k][near])
            codes.append((f[:-k][near] << 16 | f[k:][near] << 8 | dt[near]))
    if not times:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def with_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as the bytes of a WAV file."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                made = [payload(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([encode_wav(x) for x, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text")).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads the column ``media`` back: payload size and digests, and its fingerprints as time-coded arrays.

    ``feature`` is the number of pairs and the SHA-256 of both arrays (little-endian 32-bit), so equal
    payloads have equal features.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fp_time array<int>, fp_code array<int>"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 64):
                rows = []
                for doc, n, media in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns)):
                    data = read_wav(media)
                    t, c = fingerprint(data)
                    digest = hashlib.sha256(t.astype("<i4").tobytes() + c.astype("<i4").tobytes()).hexdigest()
                    rows.append((doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(t)}:{digest}", t, c))
                yield pa.RecordBatch.from_arrays([pa.array([*x], kind) for x, kind in zip(zip(*rows), types)], [x.split()[0] for x in schema.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, schema)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` written to a stored media column, read back, and fingerprinted; the arrays of time-coded pairs come with it."""
    stored = Store(spark, "media").keep(with_media(table(spark, sf_dir, "documents")), "wav")
    return media_features(stored)
