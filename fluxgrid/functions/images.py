"""Pictures in Arrow batches: decoding, grey values, resampling and difference hashes.

Portable grey and colour maps and PNG (8 bits, not interlaced) are decoded here;
other formats need the ``PIL`` package where it is installed.  Grey values and
resampling are those of common imaging libraries: fixed-point luma, a bicubic
kernel widened to the reduction, rounded to bytes after each direction.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of red, green and blue in 1/65536, fraction bits of the kernel, its sharpness.
LUMA, FRACTION_BITS, SHARPNESS = (19595, 38470, 7471), 22, -0.5
_PNM = re.compile(rb"^P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")
_PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Lines of a PNG with their filters undone; each line's first byte names its filter."""
    if len(raw) < height * (stride + 1):
        raise ValueError("image data is cut off")
    lines = np.frombuffer(raw, np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + step), np.uint8)  # a line above and a pixel before are zero
    for y in range(height):
        kind, line, above, own = lines[y, 0], lines[y, 1:], out[y], out[y + 1]
        if kind == 0:
            own[step:] = line
        elif kind == 1:
            own[step:] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            own[step:] = line + above[step:]
        elif kind in (3, 4):
            before, up, corner = [0] * step, above[step:].tolist(), above[:-step].tolist()
            done = before
            for k, value in enumerate(line.tolist()):
                a, b = done[k], up[k]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = corner[k]
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if p <= q and p <= r else b if q <= r else c
                done.append((value + guess) & 255)
            own[step:] = done[step:]
        else:
            raise ValueError(f"unknown line filter {kind}")
    return out[1:, step:]


def _png(data: bytes) -> np.ndarray:
    at, palette, parts, head = len(_PNG), None, [], None
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = (int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), body[8], body[9], body[12])
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += size + 12
    if head is None or not parts or head[2] != 8 or head[4] or head[3] not in _CHANNELS:
        raise ValueError("no PNG of 8 bits without interlacing")
    width, height, _, kind, _ = head
    n = _CHANNELS[kind]
    pixels = _unfiltered(zlib.decompress(b"".join(parts)), height, width * n, n).reshape(height, width, n)
    return palette[pixels[:, :, 0]] if kind == 3 else pixels[:, :, : 3 if n > 2 else 1]


def pixels(data: bytes) -> np.ndarray:
    """Height x width x 1 or 3 bytes of an encoded picture; transparency is left out."""
    if data[:8] == _PNG:
        return _png(data)
    if m := _PNM.match(data):
        width, height, most, n = int(m[2]), int(m[3]), int(m[4]), 1 if m[1] == b"5" else 3
        body = data[m.end() : m.end() + width * height * n]
        if most != 255 or len(body) < width * height * n:
            raise ValueError("no portable map of 8 bits, or cut off")
        return np.frombuffer(body, np.uint8).reshape(height, width, n)
    try:
        from PIL import Image
    except ImportError:
        raise ValueError("unknown picture format") from None
    with Image.open(io.BytesIO(data)) as image:
        return np.asarray(image.convert("RGB"))


def luma(picture: np.ndarray) -> np.ndarray:
    if picture.shape[2] == 1:
        return picture[:, :, 0]
    return ((picture.astype(np.int64) @ np.array(LUMA) + (1 << 15)) >> 16).astype(np.uint8)


def _kernel(x: np.ndarray) -> np.ndarray:
    x, a = np.abs(x), SHARPNESS
    return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, (((x - 5) * x + 8) * x - 4) * a, 0.0))


def _weights(size: int, target: int) -> np.ndarray:
    """Target x size whole weights: the kernel about each target cell's centre."""
    scale = size / target
    wide = max(scale, 1.0)
    out = np.zeros((target, size), np.int64)
    for k in range(target):
        centre = (k + 0.5) * scale
        a, b = max(int(centre - 2 * wide + 0.5), 0), min(int(centre + 2 * wide + 0.5), size)
        w = _kernel((np.arange(a, b) - centre + 0.5) / wide)
        w = w / w.sum() * (1 << FRACTION_BITS)
        out[k, a:b] = np.trunc(w + np.where(w < 0, -0.5, 0.5))
    return out


def resized(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """The grey picture at another size: along lines first, then along columns, bytes after each."""
    for size, axis in ((width, 1), (height, 0)):
        if grey.shape[axis] != size:
            w = _weights(grey.shape[axis], size)
            sums = np.tensordot(grey.astype(np.int64), w, axes=(axis, 1))
            sums = sums if axis == 1 else sums.T
            grey = np.clip((sums + (1 << (FRACTION_BITS - 1))) >> FRACTION_BITS, 0, 255).astype(np.uint8)
    return grey


def difference_bits(data: bytes) -> int:
    """64 bits, as a signed number: whether a cell of the 9 x 8 picture is brighter than its right one, highest first."""
    small = resized(luma(pixels(data)), 9, 8)
    return int.from_bytes(np.packbits(small[:, :-1] > small[:, 1:]).tobytes(), "big", signed=True)


def _hashed(contents: pd.Series) -> pd.DataFrame:
    rows = []
    for data in contents:
        try:
            rows.append((hashlib.sha256(data).hexdigest(), difference_bits(data), None))
        except Exception as fault:  # a corrupt picture is a row of the report, not the end of the audit
            rows.append((None, None, str(fault) or type(fault).__name__))
    # whole numbers with gaps: through floats they would lose their last bits
    return pd.DataFrame({"sha256": [r[0] for r in rows], "dhash64": pd.array([r[1] for r in rows], dtype="Int64"), "fault": [r[2] for r in rows]})


def picture_hashes(content: Column) -> Column:
    """struct<sha256, dhash64, fault> of encoded pictures; a picture that cannot be decoded has only a fault."""
    return F.pandas_udf(_hashed, "sha256 string, dhash64 bigint, fault string")(content)
