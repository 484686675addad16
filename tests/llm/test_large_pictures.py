"""Pictures of many pixels are folded as they are read, and still meet their copies."""

import numpy as np

from spanloom.llm import media


def test_strips_are_the_whole_picture(monkeypatch):
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (61, 47))
    whole = media.decode(media.encode_png(grey))
    assert (whole == grey).all()
    monkeypatch.setattr(media, "STRIP_BYTES", 200)
    assert (media.decode(media.encode_png(grey)) == grey).all()
    monkeypatch.setattr(media, "LARGEST", 61 * 47 // 4)
    k = media._fold(47, 61)
    want = grey[: 61 // k * k, : 47 // k * k].reshape(61 // k, k, 47 // k, k).mean(axis=(1, 3))
    assert k > 1 and np.allclose(media.decode(media.encode_png(grey)), want, atol=1e-3)
    assert np.allclose(media.decode(b"P5 47 61 255\n" + grey.astype(np.uint8).tobytes()), want, atol=1e-3)
    assert media.decode(media.encode_png(grey)[:-60]) is None


def test_rows_may_refer_to_the_strip_above(monkeypatch):
    """Rows that are differences to the row above (filter 2), cut into strips of three."""
    import struct
    import zlib

    rng = np.random.default_rng(2)
    grey = rng.integers(0, 256, (20, 30)).astype(np.uint8)
    rows = np.hstack([np.full((20, 1), 2, np.uint8), np.diff(grey, axis=0, prepend=np.zeros((1, 30), np.uint8)).astype(np.uint8)])
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 30, 20, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")
    monkeypatch.setattr(media, "STRIP_BYTES", 93)
    assert (media.decode(png) == grey).all()


def test_more_pixels_than_before_are_read(spark):
    """67 million pixels and more: a crop of such a picture is linked to it."""
    rng = np.random.default_rng(3)
    small = np.kron(rng.integers(30, 226, (41, 41)), np.ones((5, 5)))  # fields of five by five, then blown up
    big = np.kron(small, np.ones((40, 40))).astype(np.uint8)
    assert big.size > 1 << 26
    pictures = [(1, media.encode_png(big)), (2, media.encode_png(big[600:, 900:])), (3, media.encode_png(np.kron(np.kron(rng.integers(30, 226, (41, 41)), np.ones((5, 5))), np.ones((4, 4)))))]
    assert media.decode(pictures[0][1]).size <= media.LARGEST
    frame = spark.createDataFrame([(i, bytearray(p)) for i, p in pictures], "id long, image binary")
    out = {r["id"]: r for r in media.picture_copies(frame, key="id").collect()}
    assert out[1].class_id == out[2].class_id != out[3].class_id
