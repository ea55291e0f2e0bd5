"""Media columns: texts stored as 8-bit WAV, read by the wave module, with spectral-peak pair fingerprints.

`to_wav` turns a text column into a media column: the UTF-8 bytes, padded with bytes 255 to a positive multiple of
576, are the samples of a mono 8-bit WAV file. `fingerprint` reads such a column with the wave module alone and
computes a short-time Fourier transform (576 samples, half overlapping, Hann window). A peak is a bin above its
neighbours in frequency and not below those in time; the two strongest of a frame stay. Each peak is paired with the
next three in time order, up to 31 frames on, and a pair is stored as time << 24 | first bin << 15 | second bin << 6
| distance: an array coded by time. Slabs of whole files of about `slab` samples bound the memory; a file longer than
that is transformed in overlapping runs of frames, which gives the same values.

Nulls and empty texts give one block of bytes 255, whose spectrum is flat: no landmarks. Equal texts give equal
values. Repeated rows stay; other columns are ignored; an empty table gives an empty table.
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

from plansheet.llm._common import table

BLOCK, HOP, RATE, KEPT, FAN, REACH = 576, 288, 8000, 2, 3, 31


def wav_bytes(text: bytes | None) -> bytes:
    data = text or b""
    data += b"\xff" * (-len(data) % BLOCK or (0 if data else BLOCK))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def to_wav(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (of the text) and media, the WAV file."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for at in range(0, len(batch), 512):  # files of some rows at a time
                part = texts.slice(at, 512).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, 512), pa.array([len(t or b"") for t in part], pa.int64()), pa.array(map(wav_bytes, part), pa.binary())], ["id", "n_bytes", "media"])

    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_bytes bigint, media binary")
    return out.withColumnRenamed("id", id_col)


_WINDOW = np.hanning(BLOCK + 1)[:-1].astype(np.float32)


def _spectrum(samples: np.ndarray) -> np.ndarray:
    """Squared magnitudes, a row for each half-overlapping frame."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, BLOCK)[::HOP]
    z = np.fft.rfft((frames.astype(np.float32) - np.float32(128)) * _WINDOW, axis=1)
    return z.real**2 + z.imag**2


def _peaks(power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of the strongest local maxima, by frame and bin."""
    mid = power[:, 1:-1]
    top = (mid > power[:, :-2]) & (mid > power[:, 2:]) & (mid > np.float32(1.0))
    top[1:] &= mid[1:] >= mid[:-1]
    top[:-1] &= mid[:-1] >= mid[1:]
    top[:, :3] = False  # the window's skirt of the constant part
    t, f = np.nonzero(top)
    if not len(t):
        return t, f
    order = np.lexsort((f, -mid[t, f], t))
    t, f = t[order], f[order]
    first = np.searchsorted(t, t)
    keep = np.arange(len(t)) - first < KEPT
    t, f = t[keep], f[keep] + 1
    order = np.lexsort((f, t))
    return t[order], f[order]


def landmarks(samples: np.ndarray, slab: int = 1 << 20) -> np.ndarray:
    """Time-coded peak pairs of one file; frames are transformed in runs of about slab samples with a frame's overlap."""
    n, step = (len(samples) - BLOCK) // HOP + 1, max(4, slab // HOP)
    ts, fs = [], []
    for lo in range(0, n, step):
        a, b = max(0, lo - 1), min(n, lo + step + 1)
        t, f = _peaks(_spectrum(samples[a * HOP : (b - 1) * HOP + BLOCK]))
        t = t + a
        own = (t >= lo) & (t < min(n, lo + step))
        ts.append(t[own])
        fs.append(f[own])
    t, f = np.concatenate(ts).astype(np.int64), np.concatenate(fs).astype(np.int64)
    made = []
    for k in range(1, FAN + 1):
        dt = t[k:] - t[:-k]
        ok = dt <= REACH
        made.append((t[:-k] << 24 | f[:-k] << 15 | f[k:] << 6 | dt)[ok])
    return np.sort(np.concatenate(made)) if made else np.empty(0, np.int64)


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def fingerprint(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = (), slab: int = 1 << 20) -> DataFrame:
    """Figures of each file as it is read back, its landmarks, and a digest of these as feature."""
    src = df.select(F.col(id_col).alias("id"), *keep, F.col(media_col).alias("media"))
    kept = ["id", *keep]
    schema = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("landmarks", pa.list_(pa.int64()))])

    def one(media: bytes) -> tuple:
        data = read_wav(media)
        marks = landmarks(np.frombuffer(data, np.uint8), slab)
        frames = (len(data) - BLOCK) // HOP + 1
        feature = f"{frames}:{len(marks)}:{hashlib.sha256(marks.astype('<i8').tobytes()).hexdigest()[:32]}"
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*[one(m.as_py()) for m in batch.column("media")])) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(list(v), f.type) for v, f in zip(rows, schema))], [*kept, *schema.names])

    kinds = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in kept)
    out = src.mapInArrow(run, f"{kinds}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, landmarks array<bigint>")
    return out.withColumnRenamed("id", id_col)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(to_wav(table(spark, sf_dir, "documents")), keep=("n_bytes",))
