"""Media columns: texts stored as WAV bytes, and spectral-peak fingerprints read from such a column."""

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

from tidebook.llm.shared import materialize

#: Payloads are padded with zero bytes to a positive multiple of this.
PAD = 64
RATE = 8000
#: Samples of a frame and from one frame to the next.
FRAME, HOP = 256, 128
#: Frames transformed at once, so that long media need little memory.
BLOCK_FRAMES = 4096
#: A peak is paired with so many of the peaks after it, at most so many frames away.
FAN_OUT, REACH = 2, 63

_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    """A mono WAV file with 8-bit samples; each byte of the payload is one sample."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setparams((1, 1, RATE, 0, "NONE", "not compressed"))
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and frequency bins of spectral peaks: in each frame the strongest bin, if it is stronger than those of
    the frames beside it.  Frames of silence have none."""
    wave_ = np.frombuffer(samples, np.uint8)
    if len(wave_) < FRAME:
        wave_ = np.concatenate([wave_, np.full(FRAME - len(wave_), 128, np.uint8)])
    rest = -(len(wave_) - FRAME) % HOP
    if rest:
        wave_ = np.concatenate([wave_, np.full(rest, 128, np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(wave_, FRAME)[::HOP]
    bins, power = [], []
    for at in range(0, len(frames), BLOCK_FRAMES):
        block = frames[at : at + BLOCK_FRAMES].astype(np.float32) - 128
        spectrum = np.fft.rfft((block - block.mean(axis=1, keepdims=True)) * _WINDOW, axis=1)[:, 1:]
        loud = spectrum.real**2 + spectrum.imag**2
        best = loud.argmax(axis=1)
        bins.append(best + 1)
        power.append(loud[np.arange(len(best)), best])
    bin_, loud = np.concatenate(bins), np.concatenate(power)
    ring = np.concatenate([[-1], loud, [-1]])
    is_peak = (loud > 1e-3) & (loud >= ring[:-2]) & (loud > ring[2:])
    at = np.flatnonzero(is_peak)
    return at, bin_[at]


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded codes of peak pairs, ascending by time: frame << 32 | bin << 20 | second bin << 8 | frames between."""
    at, bin_ = peaks(samples)
    codes = []
    for step in range(1, FAN_OUT + 1):
        between = at[step:] - at[:-step]
        near = between <= REACH
        codes.append((at[:-step].astype(np.int64) << 32 | bin_[:-step] << 20 | bin_[step:] << 8 | between)[near])
    return np.sort(np.concatenate(codes))


def with_wav(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes (null: none), padded with zeros, as a WAV file."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).fill_null(b"")
            media, sizes = [], []
            for text in texts.to_pylist():
                sizes.append(len(text))
                media.append(to_wav(text + bytes(-len(text) % PAD or (0 if text else PAD))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Features of a column `media` of WAV files; the other columns but `media` are kept.

    Adds payload_bytes, payload_sha256, tail_crc32 (of the last 64 samples), media_bytes, media_sha256 and codes
    (see fingerprint).  Media that are null or no 8-bit mono WAV give nulls.
    """
    keep = [c for c in media.columns if c != "media"]
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codes array<long>"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]

    def features(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        try:
            payload = from_wav(data)
        except (wave.Error, EOFError):
            return (None, None, None, len(data), hashlib.sha256(data).hexdigest(), None)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), fingerprint(payload)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x.as_py()) for x in batch.column("media")]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + columns, keep + [x.split()[0] for x in added.split(", ")])

    schema = ", ".join(f"`{c}` {t}" for c, t in media.dtypes if c != "media")
    return media.mapInArrow(read, f"{schema}, {added}" if schema else added)


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    """Texts of whole `documents` as WAV media, and what the stored bytes give when read back."""
    out = media_features(materialize(with_wav(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media"))
    feature = F.sha2(F.array_join(F.col("codes").cast("array<string>"), ","), 256)
    return out.withColumn("n_pairs", F.size("codes")).withColumn("feature", feature).drop("codes")
