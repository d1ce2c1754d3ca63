"""Byte payloads as PNG pictures in binary columns, and their low-frequency hashes.

``encode`` writes an 8-bit grey PNG: signature, IHDR, one IDAT chunk of zlib
data, IEND, each chunk with its CRC. ``decode`` reads any non-interlaced 8-bit
PNG without a palette: it tests signature, every chunk's checksum, the sizes and
zlib's own Adler sum, and undoes the five line filters in numpy. ``low_hash`` is
the usual 64-bit hash: the mean-reduced picture's cosine transform, its 8 x 8
lowest frequencies without the constant, each set against their median.

A null or empty payload is one block of padding; a very long one is a taller
picture. Equal payloads give equal pictures and hashes. Damaged pictures raise
``Damaged``. An empty table gives an empty result. Columns of the input with the
name of a result are replaced, others and null or repeated ids are kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import small_batches

#: A picture's width, and so the unit that payloads are padded to.
WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel, by PNG colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
_SIDE, _LOW = 32, 8
#: Compression level of the IDAT data.
LEVEL = 1


class Damaged(ValueError):
    """The bytes are not a PNG that this module reads."""


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, width: int = WIDTH) -> bytes:
    """payload, whose length is a positive multiple of width, as a grey PNG, row by row."""
    height, rest = divmod(len(payload), width)
    if rest or not height:
        raise ValueError("the payload must fill whole rows, one at least")
    raw = np.frombuffer(payload, np.uint8).reshape(height, width)
    left, above = np.zeros_like(raw), np.zeros_like(raw)
    left[:, 1:], above[1:] = raw[:, :-1], raw[:-1]
    # each line as it is, or less its left or upper neighbours: what leaves the least differences
    forms = np.stack([raw, raw - left, raw - above])
    kinds = np.abs(forms.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0)
    rows = np.concatenate([kinds[:, None].astype(np.uint8), forms[kinds, np.arange(height)]], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The chunks up to IEND, each tested against its CRC."""
    if png[:8] != SIGNATURE:
        raise Damaged("no PNG signature")
    at = 8
    while at + 12 <= len(png):
        (size,) = struct.unpack_from(">I", png, at)
        if at + 12 + size > len(png):
            break
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(png[at + 4 : at + 8 + size]):
            raise Damaged(f"the checksum of {kind!r} is wrong")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise Damaged("the picture ends early")


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Undo the line filters. lines: uint8, the first column names each line's filter; step: bytes a pixel."""
    kinds, raw = lines[:, 0], lines[:, 1:]
    if not kinds.any():
        return raw
    if kinds.max() > 4:
        raise Damaged("unknown line filter")
    out = np.zeros_like(raw)
    width = raw.shape[1]
    above = np.zeros(width, np.uint8)
    for y, kind in enumerate(kinds):
        line = raw[y]
        if kind == 1:
            pixels = line.reshape(-1, step)
            line = np.cumsum(pixels, axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            line = _left_to_right(line, above, step, int(kind))
        out[y] = above = line
    return out


def _left_to_right(line: np.ndarray, above: np.ndarray, step: int, kind: int) -> np.ndarray:
    """Filters whose guess needs the pixel just decoded: one pixel at a time, its samples together."""
    raw, up = line.astype(np.int16).reshape(-1, step), above.astype(np.int16).reshape(-1, step)
    out = np.empty_like(raw)
    left = corner = np.zeros(step, np.int16)
    for x in range(len(raw)):
        if kind == 3:
            guess = (left + up[x]) >> 1
        else:
            to_left, to_up, to_corner = np.abs(up[x] - corner), np.abs(left - corner), np.abs(left + up[x] - 2 * corner)
            guess = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up[x], corner))
        left = out[x] = (raw[x] + guess) & 255
        corner = up[x]
    return out.astype(np.uint8).reshape(-1)


def decode(png: bytes) -> np.ndarray:
    """Samples as an array of height, width and channels."""
    head, data = None, []
    for kind, body in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[2] != 8 or head[3] not in CHANNELS or any(head[4:]):
        raise Damaged("only 8-bit pictures without palette or interlace")
    width, height, step = head[0], head[1], CHANNELS[head[3]]
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise Damaged(str(e)) from e
    if len(raw) != height * (1 + width * step):
        raise Damaged("the samples do not fill the picture")
    lines = np.frombuffer(raw, np.uint8).reshape(height, 1 + width * step)
    return unfilter(lines, step).reshape(height, width, step)


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


_TRANSFORM = _cosines(_SIDE, _LOW)


def _reduced(grey: np.ndarray, side: int) -> np.ndarray:
    """side rows and columns of area means; a smaller picture repeats its samples."""
    for axis in (0, 1):
        n = grey.shape[axis]
        edges = np.arange(side) * n // side
        if n >= side:
            size = np.diff(edges, append=n)
            total = np.add.reduceat(grey, edges, axis=axis, dtype=np.float64)
            grey = total / (size[:, None] if axis == 0 else size[None])
        else:
            grey = np.take(grey, edges, axis=axis)
    return grey


def low_hash(samples: np.ndarray) -> bytes:
    """Eight bytes: bit i is set where the i-th low frequency lies above the median."""
    grey = samples[..., 0] if samples.shape[2] < 3 else samples[..., :3].mean(axis=2)
    low = (_TRANSFORM @ _reduced(grey, _SIDE) @ _TRANSFORM.T).reshape(-1)
    low = np.round(low, 6)
    return np.packbits(np.concatenate([[False], low[1:] > np.median(low[1:])])).tobytes()


def stored(df: DataFrame, column: str = "text", width: int = WIDTH, media: bool = True) -> DataFrame:
    """df without column, with its UTF-8 bytes as a picture and what reading it back gives.

    n_bytes; payload_bytes, payload_sha256 and tail_crc32 (of the last 32 bytes)
    of the payload read back; media_bytes and media_sha256 of the stored form;
    low_hash binary. media: also the picture itself, as binary column ``media``.
    """
    names = [("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("low_hash", "binary")]
    names += [("media", "binary")] * media
    kept = [c for c in df.columns if c not in (column, "media", *(n for n, _ in names))]
    schema = df.select(*kept).schema
    for name, kind in names:
        schema = schema.add(name, kind)

    def one(text: bytes) -> tuple:
        pad = -len(text) % width or (0 if text else width)
        png = encode(text + b"\xff" * pad, width)
        samples = decode(png)
        back = samples.tobytes()
        out = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(png), hashlib.sha256(png).hexdigest(), low_hash(samples))
        return (*out, png) if media else out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        for batch in batches:
            column_ = batch.column(column)
            for lo in range(0, batch.num_rows, 500):
                texts = column_.slice(lo, 500).fill_null("" if pa.types.is_string(column_.type) else b"").cast(pa.binary()).to_pylist()
                made = list(zip(*map(one, texts), strict=True))
                columns = [batch.column(c).slice(lo, 500) for c in kept] + [pa.array(v, t) for v, t in zip(made, arrow, strict=False)]
                yield pa.record_batch(columns, [*kept, *(n for n, _ in names)])

    return small_batches(df).select(*kept, column).mapInArrow(rows, schema)
