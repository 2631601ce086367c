"""Media columns: WAV payloads with audio features as tensors of a fixed shape and time spans.

A text's bytes are stored as unsigned 8-bit mono samples. The stored form is read back; its samples are resampled by a
polyphase filter, seen through overlapped frames as log-mel energies and split by energy with hysteresis into spans.
Each span has one tensor of frames x bands. A document is worked on by itself, in blocks of bounded size, so equal texts
have equal features whatever else is in the batch.

Null or empty text: the payload is 192 blanks. Null doc_id stays null; repeated rows give repeated results; an empty table
gives none. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import io
import json
import wave
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_back, with_ids

RATE, UP, DOWN, TAPS = 8000, 2, 3, 8
FRAME, HOP, BANDS = 128, 64, 16
#: Frames of a span's tensor: a longer span is averaged in equal parts.
SHAPE = (8, BANDS)
#: A span starts above HIGH and ends below LOW times a document's mean energy.
HIGH, LOW = 1.05, 0.95
UNIT = 192
BLOCK = 1 << 18


def stored(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def read_back(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def payload_of(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


@cache
def _filter() -> np.ndarray:
    """The phases of a windowed-sinc low-pass filter: one row of taps for each place between input samples."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    taps = np.sinc(n / max(UP, DOWN)) * np.hanning(UP * TAPS + 2)[1:-1]
    return (taps.reshape(TAPS, UP).T / taps.sum() * UP).astype(np.float32)


@cache
def _mel() -> np.ndarray:
    """Triangles over the spectrum's lines, equally wide on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    rate = RATE * UP / DOWN
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), BANDS + 2) / 2595) - 1)
    lines = np.arange(FRAME // 2 + 1) * rate / FRAME
    up = (lines[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - lines[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def resampled(samples: np.ndarray) -> np.ndarray:
    """UP / DOWN times as many samples: output n is the phase n * DOWN % UP of the filter at input n * DOWN // UP."""
    x = np.concatenate([np.zeros(TAPS // 2, np.float32), samples.astype(np.float32) / 128 - 1, np.zeros(TAPS, np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    out = np.empty(len(samples) * UP // DOWN, np.float32)
    phases = _filter()
    for p in range(UP):
        for at in range(p, len(out), UP * BLOCK):
            n = np.arange(at, min(len(out), at + UP * BLOCK), UP)
            out[n] = views[n * DOWN // UP] @ phases[p * DOWN % UP][::-1]
    return out


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies of overlapped frames, and the frames' energies."""
    if len(samples) < FRAME:
        samples = np.concatenate([samples, np.zeros(FRAME - len(samples), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    mels, energy = [], []
    for at in range(0, len(frames), BLOCK // FRAME):
        block = frames[at : at + BLOCK // FRAME]
        power = np.abs(np.fft.rfft(block * window)).astype(np.float32) ** 2
        mels.append(np.log(power @ _mel() + np.float32(1e-6)))
        energy.append((block * block).mean(1))
    return np.concatenate(mels), np.concatenate(energy)


def spans(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames that start above the higher and end below the lower threshold."""
    mean = energy.mean()
    state = np.where(energy > HIGH * mean, 1, np.where(energy < LOW * mean, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(known >= 0, state[known], 0) == 1
    edges = np.flatnonzero(np.diff(on.astype(np.int8), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist())) or [(0, len(energy))]


def tensor(mels: np.ndarray) -> np.ndarray:
    """A span's frames as a tensor of SHAPE: the means of equal parts; frames of short spans repeat."""
    at = np.linspace(0, len(mels), SHAPE[0] + 1)
    first = np.minimum(at[:-1].astype(int), len(mels) - 1)
    last = np.maximum(first + 1, at[1:].astype(int))
    total = np.concatenate([np.zeros((1, BANDS)), np.cumsum(mels, 0, dtype=np.float64)])
    return ((total[last] - total[first]) / (last - first)[:, None]).astype(np.float32)


def features(media: bytes) -> tuple[list[tuple[float, float]], np.ndarray]:
    """Time spans in seconds of the stored samples, and their tensors."""
    mels, energy = log_mel(resampled(np.frombuffer(read_back(media), np.uint8)))
    seconds = HOP * DOWN / (RATE * UP)
    found = spans(energy)
    return [(a * seconds, b * seconds) for a, b in found], np.stack([tensor(mels[a:b]) for a, b in found])


#: Arrow's type of a span's tensor, and what a schema's field says of a list of them: Spark and its files keep it, so a
#: reader gets the shape with the column.
TENSOR = pa.fixed_shape_tensor(pa.float32(), SHAPE)
TENSOR_FIELD = {"ARROW:extension:name": TENSOR.extension_name, "ARROW:extension:metadata": json.dumps({"shape": list(SHAPE)})}


def tensor_array(flat: pa.Array, field: dict[str, str] = TENSOR_FIELD) -> pa.FixedShapeTensorArray:
    """Stored tensors as an Arrow array of the type that their field names."""
    if field["ARROW:extension:name"] != TENSOR.extension_name:
        raise ValueError("not a column of tensors")
    shape = json.loads(field["ARROW:extension:metadata"])["shape"]
    return pa.FixedShapeTensorArray.from_numpy_ndarray(flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, *shape))


def media_columns(docs: DataFrame, batch: int = 64) -> DataFrame:
    """doc_id, n_bytes, media (WAV), starts, ends (seconds), tensors (one for each span; TENSOR_FIELD says their shape)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                raw = [x.encode() for x in b.column(1).slice(at, batch).to_pylist()]
                media = [stored(payload_of(x)) for x in raw]
                found = [features(x) for x in media]
                shaped = pa.FixedShapeTensorArray.from_numpy_ndarray(np.concatenate([t for _, t in found]))
                offsets = np.concatenate([[0], np.cumsum([len(s) for s, _ in found])])
                tensors = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), shaped.storage.cast(pa.list_(pa.float32())))  # Spark's tasks pass on storage only
                times = [pa.array([[t[k] for t in s] for s, _ in found], pa.list_(pa.float64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, batch), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary()), *times, tensors], names=["doc_id", "n_bytes", "media", "starts", "ends", "tensors"])

    out = with_ids(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary, starts array<double>, ends array<double>, tensors array<array<float>>")
    return out.withColumn("doc_id", id_back()).withMetadata("tensors", TENSOR_FIELD)


def described(starts: np.ndarray, ends: np.ndarray, tensors: np.ndarray) -> str:
    """Number of spans, seconds in them and a digest of spans and tensors."""
    digest = hashlib.sha256(np.round(np.stack([starts, ends], 1), 6).tobytes() + np.round(tensors, 3).tobytes()).hexdigest()
    return f"spans={len(starts)} seconds={sum((ends - starts).tolist()):.3f} frames={'x'.join(map(str, SHAPE))} sha256={digest}"


def media_digests(docs: DataFrame, batch: int = 256) -> DataFrame:
    """The media columns of each document as sizes, checksums and a description of the features, from media_columns' rows."""
    columns = media_columns(docs)
    field = columns.schema["tensors"].metadata
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def one(media: bytes, starts: pa.Scalar, ends: pa.Scalar, tensors: pa.Scalar) -> tuple:
        back = read_back(media)
        shaped = tensor_array(tensors.values, field).to_numpy_ndarray()
        feature = described(starts.values.to_numpy(zero_copy_only=False), ends.values.to_numpy(zero_copy_only=False), shaped)
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                rows = list(zip(*(one(m.as_py(), *x) for m, *x in zip(*(part.column(i) for i in range(2, 6))))))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, rows, kinds)], names=names)

    return columns.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
