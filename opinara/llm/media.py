"""Media columns: losslessly stored 8-bit images (PNG) in binary columns, and hashes of their content.

``encode_images`` writes PNG: scanlines filtered by the least sum of residuals, one zlib stream
cut into IDAT chunks with their checksums.  ``read_images`` parses any non-interlaced 8-bit grey
PNG, tests every chunk's CRC and the zlib checksum, undoes all five filters with numpy and
hashes the low frequencies of the picture's cosine transform.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
LEVEL = 1
IDAT_BYTES = 1 << 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Rows and columns that a picture is averaged to, and of its transform those that are hashed.
GRID, LOW = 32, 8
#: Output rows of a batch carry at most about this many bytes, whatever the texts' lengths.
BATCH_BYTES = 8 << 20

_k, _n = np.arange(GRID)[:, None], np.arange(GRID)[None, :]
_COSINES = np.cos(np.pi * (2 * _n + 1) * _k / (2 * GRID))[:LOW]


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(samples: np.ndarray, level: int = LEVEL) -> bytes:
    """A grey 8-bit PNG of a (height, width) array; each row takes the filter (none, left, up) of least residual."""
    height, width = samples.shape
    left = samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up = samples.copy()
    up[1:] -= samples[:-1]
    residual = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in (samples, left, up)])
    best = residual.argmin(axis=0)
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = np.where((best == 1)[:, None], left, np.where((best == 2)[:, None], up, samples))
    packed = zlib.compress(lines.tobytes(), level)
    out = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))]
    out += [_chunk(b"IDAT", packed[i:i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join(out) + _chunk(b"IEND", b"")


def _predicted(lines: np.ndarray, above: np.ndarray, kind: int) -> np.ndarray:
    """Rows filtered by average (3) or Paeth (4), undone along diagonals: those pixels don't need each other."""
    height, width = lines.shape
    out = np.zeros((height + 1, width + 1), np.int32)
    out[0, 1:] = above
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            pa_, pb, pc_ = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
            guess = np.where((pa_ <= pb) & (pa_ <= pc_), a, np.where(pb <= pc_, b, c))
        out[y + 1, x + 1] = (lines[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Samples of filtered scanlines; rows of one filter in a row are undone together."""
    out = lines.copy()
    is_left = kinds == 1
    if is_left.any():
        out[is_left] = np.cumsum(lines[is_left], axis=1, dtype=np.uint8)
    edges = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1], [True]]))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        kind = kinds[i]
        if kind < 2:
            continue
        above = out[i - 1] if i else np.zeros(lines.shape[1], np.uint8)
        if kind == 2:
            if j == i + 1:
                np.add(lines[i], above, out=out[i])
            else:
                np.cumsum(lines[i:j], axis=0, dtype=np.uint8, out=out[i:j])
                out[i:j] += above
        elif kind in (3, 4):
            out[i:j] = _predicted(lines[i:j], above, kind)
        else:
            raise ValueError(f"filter {kind} is not defined")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG; raises ValueError for a wrong signature, checksum, order or size."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        size, kind = struct.unpack(">I4s", data[at:at + 8])
        body = data[at + 8:at + 8 + size]
        if len(data) < at + 12 + size:
            raise ValueError("a chunk is cut off")
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", data[at + 8 + size:at + 12 + size])[0]:
            raise ValueError(f"checksum of {kind!r} differs")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey PNG without interlacing")
    width, height = header[:2]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as error:
        raise ValueError(str(error)) from error
    if len(raw) != height * (width + 1):
        raise ValueError("scanlines have another size than the header says")
    lines = raw.reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def _averaged(samples: np.ndarray, axis: int) -> np.ndarray:
    """Means of ``GRID`` equal stretches along an axis; a shorter axis repeats its samples."""
    n = samples.shape[axis]
    edge = np.arange(GRID) * n // GRID
    size = np.maximum((np.arange(GRID) + 1) * n // GRID - edge, 1)
    if n >= GRID:
        total = np.add.reduceat(samples, edge, axis=axis, dtype=np.int64 if samples.dtype == np.uint8 else np.float64)
    else:
        total = samples.take(edge, axis=axis)
    return total / (size[:, None] if axis == 0 else size[None, :])


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies lie above their median; equal pictures, equal bits."""
    small = _averaged(_averaged(samples, 0), 1)
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def _flush(ids: list, columns: list[list], names: list[str], types: list) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))],
                                       ["doc_id", *names])
    for c in (ids, *columns):
        c.clear()
    return batch


def encode_images(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each whole text's UTF-8 bytes as the samples of a picture 64 wide.

    The bytes are filled with 0 up to the next positive multiple of 64; a null text counts as
    empty.  Repeated rows give repeated rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, media, held = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                payload = text.as_buffer().to_pybytes() if text.is_valid else b""
                rows = max(1, -(-len(payload) // WIDTH))
                ids.append(doc_id)
                sizes.append(len(payload))
                media.append(encode_png(np.frombuffer(payload.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)))
                held += len(media[-1])
                if held > BATCH_BYTES:
                    yield _flush(ids, [sizes, media], ["n_bytes", "media"], [pa.int64(), pa.binary()])
                    held = 0
        if ids:
            yield _flush(ids, [sizes, media], ["n_bytes", "media"], [pa.int64(), pa.binary()])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, media binary")


def read_images(images: DataFrame) -> DataFrame:
    """``images(doc_id, n_bytes, media)`` with ``payload``, ``hash`` (binary), ``width``, ``height`` and ``intact``.

    A null or damaged picture is not intact; its payload, hash and sizes are null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "media", "payload", "hash", "width", "height", "intact"]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()]
        ids: list = []
        columns: list[list] = [[] for _ in names]
        held = 0
        for batch in batches:
            for doc_id, size, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = media.as_py()
                try:
                    samples = decode_png(data or b"")
                    row = (size, data, samples.tobytes(), cosine_hash(samples), samples.shape[1], samples.shape[0], True)
                except ValueError:
                    row = (size, data, None, None, None, None, False)
                ids.append(doc_id)
                for column, value in zip(columns, row):
                    column.append(value)
                held += len(row[2] or b"") + len(data or b"")
                if held > BATCH_BYTES:
                    yield _flush(ids, columns, names, types)
                    held = 0
        if ids:
            yield _flush(ids, columns, names, types)
    return images.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, media binary, payload binary, hash binary, width int, height int, intact boolean")
