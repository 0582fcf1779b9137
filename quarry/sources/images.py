"""Pixels of PNG images, without a library for images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Samples of each colour type of the format.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _unfiltered(raw: np.ndarray, size: int) -> np.ndarray:
    """Rows of bytes from filtered ones (a filter number, then the row); `size`: bytes of a pixel."""
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    above = np.zeros(raw.shape[1] - 1, np.int32)
    for y, row in enumerate(raw):
        kind, x = row[0], row[1:].astype(np.int32)
        if kind == 1:
            for k in range(size):
                x[k::size] = np.cumsum(x[k::size])
        elif kind == 2:
            x += above
        elif kind in (3, 4):
            for k in range(len(x)):
                a, b, c = (x[k - size] if k >= size else 0), above[k], (above[k - size] if k >= size else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                x[k] = (x[k] + guess) & 255
        elif kind:
            raise ValueError(f"filter {kind}")
        above = x & 255
        out[y] = above
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Height x width x 3 bytes; transparent pixels lie on white. Eight bits a sample, not interlaced."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, palette, alpha = 8, [], None, b""
    w = h = depth = kind = lace = 0
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        at += n + 12
        if name == b"IHDR":
            w, h, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            alpha = body
        elif name == b"IDAT":
            parts.append(body)
    if depth != 8 or lace or kind not in SAMPLES:
        raise ValueError("only eight bits a sample, not interlaced")
    n = SAMPLES[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, w * n + 1)
    px = _unfiltered(raw, n).reshape(h, w, n).astype(np.int32)
    if kind == 3:
        if palette is None:
            raise ValueError("no palette")
        seen = np.full(256, 255)
        seen[: len(alpha)] = np.frombuffer(alpha, np.uint8)
        rgb, a = palette[px[..., 0]].astype(np.int32), seen[px[..., 0]][..., None]
    else:
        rgb = np.repeat(px[..., :1], 3, axis=2) if n < 3 else px[..., :3]
        a = px[..., n - 1 :] if n in (2, 4) else np.full((h, w, 1), 255)
    return ((rgb * a + 255 * (255 - a) + 127) // 255).astype(np.uint8)


def pixels(files: DataFrame, content: str = "content") -> DataFrame:
    """`files` with height, width, px (rows of three bytes a pixel) and error instead of the content.

    An image that cannot be read has its error and no pixels; a null content is one of no bytes.
    """
    names = [c for c in files.columns if c not in (content, "height", "width", "px", "error")]
    schema = ", ".join([f"`{c}` {files.schema[c].dataType.simpleString()}" for c in names] + ["height int, width int, px binary, error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for data in batch.column(content).to_pylist():
                try:
                    px = decode_png(data or b"")
                    found.append((px.shape[0], px.shape[1], px.tobytes(), None))
                except (ValueError, zlib.error, struct.error) as e:
                    found.append((None, None, None, str(e)))
            cols = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + cols, [*names, "height", "width", "px", "error"])

    return files.select(*names, content).mapInArrow(run, schema)
