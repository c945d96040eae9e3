"""Media columns: lossless 8-bit audio of a byte payload, and its features.

A payload is written as the samples of a mono 8-bit PCM WAV file and read back
from the stored bytes. Features: polyphase resampling by a rational factor,
overlapped log-mel filterbanks, and energy segmentation with hysteresis (a
segment begins above the upper threshold and lasts until energy falls below the
lower one). Filterbanks are cut into tiles of a fixed shape (frames x bands,
the last tile padded) and stored as fixed-shape Arrow tensors, each with its time
span and the active segments that begin in it, in Arrow's stream format.

Defined results: null is empty text, and an empty text is one block of zero
bytes; repeated rows give equal values; a payload of any length is resampled and
analysed in slices; an empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map


@dataclass(frozen=True)
class AudioConfig:
    rate: int = 16_000  # of the stored samples
    up: int = 3
    down: int = 8
    taps: int = 8  # filter taps on each side, in units of max(up, down)
    frame: int = 256
    hop: int = 128
    bands: int = 16
    tile: int = 64  # frames in a tensor
    high: float = 0.55  # thresholds as shares of the way from quiet (10 %) to loud (90 %)
    low: float = 0.35


BLOCK = 64


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and these padded with zeros to a positive multiple of BLOCK."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def to_wav(samples: bytes, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


@cache
def low_pass(c: AudioConfig) -> np.ndarray:
    """Windowed sinc split into its `up` phases."""
    reach = c.taps * max(c.up, c.down)
    n = np.arange(-reach, reach + 1)
    h = np.sinc(n / max(c.up, c.down)) * np.hanning(len(n) + 2)[1:-1]
    h *= c.up / h.sum()
    padded = np.concatenate([h, np.zeros(-len(h) % c.up)])
    return padded.reshape(-1, c.up).T.astype(np.float32).copy()


#: Outputs of one phase that are computed at once.
OUTPUTS_AT_ONCE = 1 << 15


def samples(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """Samples a..b as numbers around zero (8-bit ones are shifted and scaled), zeros beyond the ends."""
    part = x[max(0, a) : max(0, b)]
    part = (part.astype(np.float32) - np.float32(128)) / np.float32(128) if x.dtype == np.uint8 else part.astype(np.float32)
    return np.concatenate([np.zeros(min(b, 0) - min(a, 0), np.float32), part, np.zeros(max(0, b - max(a, len(x), 0)), np.float32)])


def resample(x: np.ndarray, c: AudioConfig) -> np.ndarray:
    """Output j is phase (j*down + reach) mod up of the filter over the samples up to (j*down + reach) div up; no zero is ever multiplied in.

    Outputs of one phase lie `down` samples apart, so each is a product of
    strided windows with that phase, a slice at a time.
    """
    phases = low_pass(c)
    width, reach = phases.shape[1], c.taps * max(c.up, c.down)
    out = np.zeros(-(-len(x) * c.up // c.down), np.float32)
    for first in range(min(c.up, len(out))):
        last, phase = divmod(first * c.down + reach, c.up)
        number = len(range(first, len(out), c.up))
        for a in range(0, number, OUTPUTS_AT_ONCE):
            n = min(OUTPUTS_AT_ONCE, number - a)
            begin = last + a * c.down - width + 1
            windows = np.lib.stride_tricks.sliding_window_view(samples(x, begin, begin + (n - 1) * c.down + width), width)[:: c.down]
            out[first + a * c.up : first + (a + n - 1) * c.up + 1 : c.up] = windows @ phases[phase][::-1]
    return out


@cache
def mel_bank(c: AudioConfig) -> np.ndarray:
    rate = c.rate * c.up / c.down
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, c.bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, c.frame // 2 + 1)[:, None]
    up = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@cache
def window(n: int) -> np.ndarray:
    return np.hanning(n + 1)[:-1].astype(np.float32)


FRAMES_AT_ONCE = 4096


def log_mel(x: np.ndarray, c: AudioConfig) -> tuple[np.ndarray, np.ndarray]:
    """(frames x bands log energies, energy of each frame); at least one frame, the last one padded."""
    n = 1 + max(0, -(-(len(x) - c.frame) // c.hop))
    x = np.concatenate([x, np.zeros(max(0, (n - 1) * c.hop + c.frame - len(x)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, c.frame)[:: c.hop][:n]
    mels, energy = [], []
    for a in range(0, n, FRAMES_AT_ONCE):
        part = frames[a : a + FRAMES_AT_ONCE]
        power = np.abs(np.fft.rfft(part * window(c.frame), axis=1).astype(np.complex64)) ** 2
        mels.append(np.log10(power @ mel_bank(c) + np.float32(1e-6)))
        energy.append(np.log10(np.einsum("ij,ij->i", part, part) / c.frame + np.float32(1e-9)))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray, c: AudioConfig) -> list[tuple[int, int]]:
    """Frames [start, end) of the active segments."""
    quiet, loud = np.quantile(energy, [0.1, 0.9])
    if not loud > quiet:
        return []
    state = np.where(energy >= quiet + c.high * (loud - quiet), 1, np.where(energy < quiet + c.low * (loud - quiet), -1, 0))
    known = np.flatnonzero(state)  # between the thresholds the state before holds; at the start it is off
    held = np.zeros(len(state), bool)
    if len(known):
        before = np.searchsorted(known, np.arange(len(state)), "right") - 1
        held = (before >= 0) & (state[known[before]] > 0)
    steps = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]])))
    return list(zip(steps[::2].tolist(), steps[1::2].tolist(), strict=True))


def analyse(payload: bytes, c: AudioConfig) -> tuple[np.ndarray, list[tuple[int, int]]]:
    mel, energy = log_mel(resample(np.frombuffer(payload, np.uint8), c), c)
    return mel, segments(energy, c)


def tiles(mel: np.ndarray, c: AudioConfig) -> list[np.ndarray]:
    pad = np.zeros((-len(mel) % c.tile, c.bands), mel.dtype)
    return list(np.concatenate([mel, pad]).reshape(-1, c.tile, c.bands))


def seconds(frame: int, c: AudioConfig) -> float:
    return frame * c.hop * c.down / (c.rate * c.up)


SPAN = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])


def tile_schema(c: AudioConfig) -> pa.Schema:
    return pa.schema([("tile", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", pa.fixed_shape_tensor(pa.float32(), (c.tile, c.bands))), ("segments", pa.list_(SPAN))])


def to_tensors(mel: np.ndarray, active: list[tuple[int, int]], c: AudioConfig) -> bytes:
    """One row per tile (its time span, its log-mel tensor of tile x bands, the active segments that begin in it), as an Arrow stream."""
    own = tiles(mel, c)
    schema = tile_schema(c)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(own).ravel(), pa.float32()), c.tile * c.bands)
    begins: list[list] = [[] for _ in own]
    for a, b in active:
        begins[a // c.tile].append({"start_s": seconds(a, c), "end_s": seconds(b, c)})
    spans = [(seconds(k * c.tile, c), seconds(min(len(mel), (k + 1) * c.tile), c)) for k in range(len(own))]
    columns = [pa.array(range(len(own)), pa.int32()), *(pa.array(x, pa.float64()) for x in zip(*spans, strict=True)), pa.ExtensionArray.from_storage(schema.field("log_mel").type, flat), pa.array(begins, pa.list_(SPAN))]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
    return sink.getvalue().to_pybytes()


def from_tensors(stored: bytes) -> pa.Table:
    with pa.ipc.open_stream(stored) as reader:
        return reader.read_all()


FEATURES = pa.schema([("doc_id", pa.int64()), ("n_tiles", pa.int64()), ("tensors", pa.binary())])


def features(docs: DataFrame, config: AudioConfig = AudioConfig()) -> DataFrame:
    """Per document: the number of its tiles and their tensors with time spans (``from_tensors`` reads them)."""
    c = config

    def rows(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mel, active = analyse(from_wav(to_wav(payload_of(text)[1], c.rate)), c)
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([-(-len(mel) // c.tile)], pa.int64()), pa.array([to_tensors(mel, active, c)], pa.binary())], schema=FEATURES)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "doc_id long, n_tiles long, tensors binary")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int64()), ("n_segments", pa.int64()), ("tensor_bytes", pa.int64()), ("tensor_sha256", pa.string())])
DIGEST_SQL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_segments long, tensor_bytes long, tensor_sha256 string"


def digest_row(doc: int | None, text: str | None, c: AudioConfig) -> tuple:
    """The feature is read from the stored tensors: frames, means of the bands, and the active segments."""
    n, payload = payload_of(text)
    media = to_wav(payload, c.rate)
    back = from_wav(media)
    mel, active = analyse(back, c)
    stored = to_tensors(mel, active, c)
    read = from_tensors(stored).combine_chunks().to_batches()[0]
    own = read.column(3).storage.flatten().to_numpy().reshape(-1, c.bands)[: len(mel)]
    means = "".join(f"{round(20 * float(x)):+d}" for x in own.mean(axis=0, dtype=np.float64))
    spans = read.column(4).flatten()
    at = ",".join(f"{a:.6f}:{b:.6f}" for a, b in zip(spans.field(0).to_pylist(), spans.field(1).to_pylist(), strict=True))
    feature = f"frames={len(own)};mel={means};segments={len(spans)};active={sum(b - a for a, b in active)};spans={hashlib.sha256(at.encode()).hexdigest()[:16]}"
    return doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(mel), len(active), len(stored), hashlib.sha256(stored).hexdigest()


def digests(docs: DataFrame, config: AudioConfig = AudioConfig()) -> DataFrame:
    """Per document: sizes and digests of what is stored and read back, and a short form of the features."""

    def rows(batches):
        for batch in batches:
            out = [digest_row(doc, text, config) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = zip(*out, strict=True) if out else [[] for _ in DIGEST]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, DIGEST.types, strict=True)], schema=DIGEST)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, DIGEST_SQL)
