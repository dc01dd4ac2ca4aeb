import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm.media import LOW, SIDE, SIGNATURE, cosine_hash, decode_png, decode_pngs, encode_png, encode_pngs, filter_rows, op7_media, payload_image, read_media, read_png, to_media, unfilter_rows

SCHEMA = "doc_id long, text string, lang string, media string, feature string"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32 - 1), st.lists(st.integers(0, 4), min_size=9, max_size=9))
def test_round_trip_with_every_filter(height, width, seed, kinds):
    pixels = np.random.default_rng(seed).integers(0, 256, (height, width), dtype=np.uint8)
    assert (decode_png(encode_png(pixels, np.array(kinds[:height]))) == pixels).all()
    assert (decode_png(encode_png(pixels)) == pixels).all()


def plain_unfilter(rows, kinds):
    """Sample by sample, as the format's text has it."""
    out = [[0] * rows.shape[1] for _ in rows]
    for y, (row, kind) in enumerate(zip(rows.tolist(), kinds.tolist())):
        for x, v in enumerate(row):
            a, b, c = (out[y][x - 1] if x else 0), (out[y - 1][x] if y else 0), (out[y - 1][x - 1] if x and y else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out[y][x] = (v + (0, a, b, (a + b) // 2, paeth)[kind]) % 256
    return np.array(out, np.uint8)


def test_unfiltering_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        heights = rng.integers(1, 12, 4)
        rows, kinds = rng.integers(0, 256, (heights.sum(), rng.integers(1, 9)), dtype=np.uint8), rng.integers(0, 5, heights.sum(), dtype=np.uint8)
        parts = np.split(np.arange(len(rows)), np.cumsum(heights)[:-1])
        want = np.concatenate([plain_unfilter(rows[i], kinds[i]) for i in parts])
        assert (unfilter_rows(rows, kinds, heights) == want).all()
        assert (filter_rows(want, kinds, heights)[0] == rows).all()


def test_many_images_equal_one_by_one():
    texts = [b"", b"a", bytes(range(256)) * 3, "Ünder the hill. ".encode() * 90, b"z" * 64]
    files = encode_pngs([payload_image(t) for t in texts])
    assert files == [encode_png(payload_image(t)) for t in texts]
    assert all((a == b).all() and (a == payload_image(t)).all() for a, b, t in zip(decode_pngs(files), map(decode_png, files), texts))
    assert {k for f in files for k in read_png(f)[:, 0].tolist()} - {0}  # filters are in use


def test_hash_equals_plain_cosines():
    rng = np.random.default_rng(6)
    image = rng.integers(0, 256, (96, 64)).astype(np.uint8)
    small = image.reshape(SIDE, 3, SIDE, 2).astype(float).mean(axis=(1, 3))
    wave = lambda k, i: np.cos(np.pi * k * (2 * i + 1) / (2 * SIDE))
    low = [sum(small[i, j] * wave(u, i) * wave(v, j) for i in range(SIDE) for j in range(SIDE)) for u in range(LOW) for v in range(LOW)]
    middle = np.median(low[1:])
    assert cosine_hash(image) == "%016x" % int("".join("1" if x > middle else "0" for x in low), 2)


def test_known_file():
    """One black and one white sample, put together by hand."""
    raw = zlib.compress(b"\0\x00\xff")
    put = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = put(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 0, 0, 0, 0))
    file = SIGNATURE + head + put(b"tEXt", b"k\0v") + put(b"IDAT", raw[:5]) + put(b"IDAT", raw[5:]) + put(b"IEND", b"")
    assert decode_png(file).tolist() == [[0, 255]]


def test_broken_files_raise():
    good = encode_png(np.arange(128, dtype=np.uint8).reshape(2, 64))
    for bad in (b"", b"GIF89a" + good, good[:-4], good[:40] + bytes([good[40] ^ 1]) + good[41:], good.replace(b"IDAT", b"IDAX"), good[:-12]):
        with pytest.raises(ValueError):
            decode_png(bad)


def test_hash_follows_coarse_shapes():
    rng = np.random.default_rng(0)
    shape = lambda n, k: np.cos(np.pi * np.arange(k)[:, None] * (2 * np.arange(n) + 1) / (2 * n))
    shades = [shape(128, 8).T @ rng.normal(0, 12, (8, 8)) @ shape(64, 8) + 128 for _ in range(2)]
    shade, other = (np.clip(s, 0, 255).astype(np.uint8) for s in shades)
    near = np.clip(shade.astype(int) + rng.integers(-3, 4, shade.shape), 0, 255).astype(np.uint8)
    far = lambda a, b: bin(int(cosine_hash(a), 16) ^ int(cosine_hash(b), 16)).count("1")
    assert far(shade, near) <= 6 and far(shade, other) >= 20
    assert cosine_hash(shade[:3]) and len(cosine_hash(shade)) == 16


def test_edge_rows(spark):
    rows = [(1, None, "x", "m", "f"), (2, "", None, "m", "f"), (3, "a" * 64, None, "m", "f"), (4, "é" * 150_000, None, "m", "f"), (4, "é" * 150_000, None, "m", "f"), (None, "b", None, None, None)]
    got = read_media(to_media(spark.createDataFrame(rows, SCHEMA))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and (by[1].n_bytes, by[1].payload_bytes, by[3].payload_bytes, by[4].payload_bytes) == (0, 64, 64, 300_032)
    assert by[1].feature == by[2].feature and by[1].media_sha256 == by[2].media_sha256
    assert read_media(to_media(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op7_media(spark, "/root/testdata/sf0.001").collect():
        raw = docs.pop(r.doc_id)
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert not docs
