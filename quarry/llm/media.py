"""Media columns: WAV files in a column, their spectra and fingerprints of pairs of spectral peaks."""

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

from .base import columns, portions, utf8

RATE, FRAME, HOP, BLOCK = 8000, 256, 128, 4096
#: Frequency bins of a frame are searched for one peak in each of these ranges.
BANDS = ((1, 16), (16, 48), (48, 129))
#: A peak is paired with those of the next frames up to so many.
AHEAD = 2


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """One channel of 8-bit samples, each a byte of the payload."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if r.getnchannels() != 1 or r.getsampwidth() != 1:
            raise ValueError("one channel of 8-bit samples is asked for")
        return r.readframes(r.getnframes())


def padded(text: bytes, unit: int = 64) -> bytes:
    """Bytes 0 are appended up to a positive multiple of the unit."""
    return text + bytes(-len(text) % unit if text else unit)


_window = np.hanning(FRAME).astype(np.float32)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(codes, times) of pairs of spectral peaks, by time.

    The short-time Fourier transform takes frames of FRAME samples every HOP, the last padded with the zero level, a
    block of frames at a time, so memory stays bounded however long the sound is. Each frame has its strongest bin in
    each of BANDS; a bin counts as a peak if its magnitude is above the frame's mean. A peak pairs with the peaks in
    the same band up to AHEAD frames later, and with that of the next higher band in its own frame, so that sounds of
    one frame have pairs too: code = (bin, other bin, frames between) and time = the earlier frame.
    """
    n = len(samples)
    frames = max(1, -(-max(0, n - FRAME) // HOP) + 1)
    raw = np.frombuffer(samples, np.uint8)
    bins, strong = [], []
    for lo in range(0, frames, BLOCK):
        hi = min(frames, lo + BLOCK)
        x = np.full((hi - lo - 1) * HOP + FRAME, 128, np.float32)
        part = raw[lo * HOP : lo * HOP + len(x)]
        x[: len(part)] = part
        x -= 128
        view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        size = np.abs(np.fft.rfft(view * _window, axis=1)).astype(np.float32)
        mean = size.mean(axis=1)
        top = np.stack([size[:, a:b].argmax(axis=1) + a for a, b in BANDS], axis=1)
        bins.append(top.astype(np.int32))
        strong.append(np.take_along_axis(size, top, 1) > mean[:, None])
    peak, ok = np.concatenate(bins), np.concatenate(strong)
    t, k = np.nonzero(ok[:, :-1] & ok[:, 1:])
    codes, times = [(peak[t, k] << 16) | (peak[t, k + 1] << 4)], [t.astype(np.int32)]
    for d in range(1, AHEAD + 1):
        if frames <= d:
            break
        t, k = np.nonzero(ok[:-d] & ok[d:])
        codes.append((peak[t, k] << 16) | (peak[t + d, k] << 4) | d)
        times.append(t.astype(np.int32))
    code, time = np.concatenate(codes).astype(np.int32), np.concatenate(times)
    order = np.lexsort((code, time))
    return code[order], time[order]


def media_columns(docs: DataFrame, media: bool = False) -> DataFrame:
    """Store every whole text as a WAV and describe what is read back.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, and the time-coded arrays
    fingerprint_code and fingerprint_time; with `media`, the WAV itself in a binary column. Row by row without a
    shuffle. A null or empty text is 64 bytes 0; equal texts have equal values in every column; repeated rows and null
    ids are stored as any other; an empty table gives an empty result; other columns are not read.
    """
    kept = columns(docs, ["doc_id", "text"])
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprint_code", "fingerprint_time"]
    id_type = kept.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, fingerprint_code array<int>, fingerprint_time array<int>" + ", media binary" * media

    def lists(parts: list[np.ndarray]) -> pa.Array:
        at = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            data, at = utf8(batch.column("text"))
            rows: list[tuple] = []
            codes, times, stored = [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                wav = to_wav(padded(data[a:b].tobytes()))
                back = from_wav(wav)
                code, time = fingerprint(back)
                rows.append((b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(wav), hashlib.sha256(wav).hexdigest()))
                codes.append(code)
                times.append(time)
                if media:
                    stored.append(wav)
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            cols = [batch.column("doc_id"), *cols, lists(codes), lists(times)] + [pa.array(stored, pa.binary())] * media
            yield pa.RecordBatch.from_arrays(cols, [*names, *["media"] * media])

    return kept.mapInArrow(run, schema)


def described(media: DataFrame) -> DataFrame:
    """The fingerprint arrays as one string: the number of pairs and a digest of codes and times."""
    arrays = F.to_json(F.struct("fingerprint_code", "fingerprint_time"))
    return media.withColumn("feature", F.concat(F.size("fingerprint_code").cast("string"), F.lit(":"), F.md5(arrays)))
