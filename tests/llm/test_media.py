from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from opinara.llm import media

from .cases import ODD_ROWS, odd_docs


def _paeth(a, b, c):
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa <= pb and pa <= pc else b if pb <= pc else c


def _filtered(samples, kinds):
    """Scanlines filtered pixel by pixel, as the format defines it."""
    out = np.zeros_like(samples)
    for y, row in enumerate(samples.astype(int)):
        for x, v in enumerate(row):
            a = row[x - 1] if x else 0
            b = int(samples[y - 1, x]) if y else 0
            c = int(samples[y - 1, x - 1]) if x and y else 0
            out[y, x] = (v - (0, a, b, (a + b) // 2, _paeth(a, b, c))[kinds[y]]) % 256
    return out


def test_all_five_filters_are_undone():
    rng = np.random.default_rng(1)
    for height, width in ((1, 1), (7, 5), (40, 64), (3, 100)):
        samples = rng.integers(0, 256, (height, width)).astype(np.uint8)
        kinds = rng.integers(0, 5, height).astype(np.uint8)
        assert (media.unfilter(kinds, _filtered(samples, kinds)) == samples).all()
    with pytest.raises(ValueError):
        media.unfilter(np.array([7], np.uint8), np.zeros((1, 4), np.uint8))


@pytest.mark.parametrize("size", [1, 2, 31, 33, 5000])
def test_round_trip(size):
    samples = np.random.default_rng(size).integers(0, 256, (size, 64)).astype(np.uint8)
    assert (media.decode_png(media.encode_png(samples)) == samples).all()


def test_every_flipped_bit_is_noticed():
    data = media.encode_png(np.arange(256, dtype=np.uint8).reshape(4, 64))
    for at in range(0, len(data)):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            media.decode_png(bytes(broken))
    for cut in (0, 7, 20, len(data) - 5):
        with pytest.raises(ValueError):
            media.decode_png(data[:cut])


def test_hash_keeps_low_frequencies():
    rng = np.random.default_rng(3)
    y, x = (np.cos(np.pi * (2 * np.arange(n) + 1)[:, None] * np.arange(8) / (2 * n)) for n in (256, 64))
    smooth = y @ rng.normal(0, 8, (8, 8)) @ x.T + 128
    near = np.clip(smooth + rng.normal(0, 3, smooth.shape), 0, 255)
    other = rng.integers(0, 256, smooth.shape)

    def bits(x):
        return np.unpackbits(np.frombuffer(media.cosine_hash(x.astype(np.uint8)), np.uint8))
    assert (bits(smooth) != bits(near)).sum() <= 10 < (bits(smooth) != bits(other)).sum()


def test_odd_rows(spark):
    read = media.read_images(media.encode_images(odd_docs(spark, "media"))).collect()
    assert len(read) == len(ODD_ROWS)
    by = {}
    for r in read:
        by.setdefault(r.doc_id, []).append(r)
    for doc_id, text, *_ in ODD_ROWS:
        payload = (text or "").encode()
        payload = payload.ljust(max(64, -(-len(payload) // 64) * 64), b"\0")
        assert any(bytes(r.payload) == payload and r.intact and r.n_bytes == len((text or "").encode()) for r in by[doc_id])
    assert len({bytes(r.hash) + bytes(r.media) for r in by[1]}) == 1
    empty = media.encode_images(odd_docs(spark, "media").where("false"))
    assert media.read_images(empty).count() == 0


def test_damaged_pictures_are_reported(spark):
    rows = spark.createDataFrame([(1, 5, b"no picture"), (2, None, None)], "doc_id long, n_bytes long, media binary")
    assert [(r.payload, r.hash, r.intact) for r in media.read_images(rows).collect()] == [(None, None, False)] * 2


def test_query_digests(spark):
    from opinara.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in QUERIES["op1_media_columns"](spark, "/root/testdata/sf0.001").collect():
        payload = (texts[r.doc_id] or "").encode()
        padded = payload.ljust(max(64, -(-len(payload) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (
            len(payload), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
