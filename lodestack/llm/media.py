"""Media columns: PNG files in binary columns, read back with every checksum tested, and perceptual hashes.

The codec knows 8-bit greyscale, non-interlaced PNG. A file is a signature and
chunks (length, type, data, CRC-32); pixel rows stand in one zlib stream, each
after a filter byte. The encoder filters each row by whichever of the five filters
leaves the least sum of differences; the reader undoes them with numpy along
diagonals, many images at a time, as a sample needs those to its left, above it
and between the two. The hash of an image is the sign pattern of its lowest
cosine-transform frequencies.

Defined results: a null payload counts as empty and is stored as one row of
zero samples; broken files raise ``ValueError``; an empty table gives an empty
table; equal payloads give equal files and hashes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: The side of the square that hashes are taken from, and of its corner of low frequencies.
SIDE, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _first_rows(heights: np.ndarray) -> np.ndarray:
    return np.cumsum(heights) - heights


def filter_rows(pixels: np.ndarray, kinds: np.ndarray | None = None, heights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The filtered rows of images that stand one above the other, and each row's filter: 0 none, 1 sub, 2 up, 3 average, 4 Paeth.

    Without ``kinds`` a row takes the filter with the least sum of differences.
    """
    heights = np.array([len(pixels)]) if heights is None else heights
    here = pixels.astype(np.int16)
    left = np.zeros_like(here)
    left[:, 1:] = here[:, :-1]
    up = np.zeros_like(here)
    up[1:] = here[:-1]
    up[_first_rows(heights)[heights > 0]] = 0
    corner = np.zeros_like(here)
    corner[:, 1:] = up[:, :-1]
    guess = left + up - corner
    to_left, to_up, to_corner = abs(guess - left), abs(guess - up), abs(guess - corner)
    paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
    out = np.empty((len(here), here.shape[1]), np.uint8)
    if kinds is None:
        least, kinds = np.full(len(here), np.iinfo(np.int64).max), np.zeros(len(here), np.uint8)
        for kind, by in enumerate((np.int16(0), left, up, (left + up) >> 1, paeth)):
            now = (here - by).astype(np.uint8)
            total = abs(now.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
            less = total < least
            least[less], kinds[less], out[less] = total[less], kind, now[less]
        return out, kinds
    for kind, by in enumerate((np.zeros_like(here), left, up, (left + up) >> 1, paeth)):
        own = kinds == kind
        out[own] = (here[own] - by[own]).astype(np.uint8)
    return out, kinds


def unfilter_rows(rows: np.ndarray, kinds: np.ndarray, heights: np.ndarray | None = None) -> np.ndarray:
    """Undoes ``filter_rows``: all samples of a diagonal, in all images, at once."""
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown filter type")
    if not kinds.any():
        return rows.copy()
    heights = np.array([len(rows)]) if heights is None else heights
    n, width = rows.shape
    # One column of zeros to the left, and one row of zeros that stands above every image.
    out = np.zeros((n + 1, width + 1), np.int16)
    flat, raw = out.ravel(), np.ascontiguousarray(rows).ravel()
    first = np.repeat(_first_rows(heights), heights)
    y = np.arange(n) - first
    above = np.where(y == 0, n, np.arange(n) - 1)
    order = np.argsort(y, kind="stable")
    upto = np.r_[0, np.cumsum(np.bincount(y))]
    most = len(upto) - 1
    for d in range(most + width - 1):
        r = order[upto[max(0, d - width + 1)] : upto[min(most, d + 1)]]
        x = d - y[r]
        at, over, kind = r * (width + 1) + x, above[r] * (width + 1) + x, kinds[r]
        left, corner, up = flat[at], flat[over], flat[over + 1]
        p, q = up - corner, left - corner  # how far the guess left + up - corner is from left, and from up
        a, b, c = abs(p), abs(q), abs(p + q)
        guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.choose(kind, (np.int16(0), left, up, (left + up) >> 1, guess))
        flat[at + 1] = (raw[r * width + x] + guess) & 255
    return out[:-1, 1:].astype(np.uint8)


def _file(rows: np.ndarray, kinds: np.ndarray, level: int) -> bytes:
    height, width = rows.shape
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(np.column_stack([kinds.astype(np.uint8), rows]).tobytes(), level)) + _chunk(b"IEND", b"")


def encode_png(pixels: np.ndarray, kinds: np.ndarray | None = None, level: int = 1) -> bytes:
    """A greyscale PNG of a (height, width) array of 8-bit samples; ``kinds``: filter type by row, the best unless given."""
    if not pixels.size:
        raise ValueError("an image has at least one sample")
    return _file(*filter_rows(pixels, kinds), level)


def encode_pngs(images: list[np.ndarray], level: int = 1) -> list[bytes]:
    """``encode_png`` of images of one width, filtered together."""
    heights = np.array([len(i) for i in images])
    rows, kinds = filter_rows(np.concatenate(images), heights=heights)
    return [_file(rows[a:b], kinds[a:b], level) for a, b in zip(_first_rows(heights), np.cumsum(heights))]


def read_png(data: bytes) -> np.ndarray:
    """The rows of a greyscale PNG, as stored, with the filter in front; every chunk's checksum and the stream's own are tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, size, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (length,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + length]
        if at + 12 + length > len(data):
            raise ValueError("a chunk is cut off")
        if zlib.crc32(data[at + 4 : at + 8 + length]) != struct.unpack_from(">I", data, at + 8 + length)[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            if (depth, colour, *rest) != (8, 0, 0, 0, 0):
                raise ValueError("only 8-bit greyscale without interlace is read")
            size = height, width
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + length
    if size is None or not ended:
        raise ValueError("header or end is missing")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != size[0] * (size[1] + 1):
        raise ValueError("wrong number of samples")
    return np.frombuffer(raw, np.uint8).reshape(size[0], size[1] + 1)


def decode_png(data: bytes) -> np.ndarray:
    """The samples of a greyscale PNG."""
    rows = read_png(data)
    return unfilter_rows(rows[:, 1:], rows[:, 0])


def decode_pngs(files: list[bytes]) -> list[np.ndarray]:
    """``decode_png`` of files whose images have one width, unfiltered together."""
    stored = [read_png(f) for f in files]
    heights = np.array([len(r) for r in stored])
    rows = np.concatenate(stored)
    pixels = unfilter_rows(rows[:, 1:], rows[:, 0], heights)
    return np.split(pixels, np.cumsum(heights)[:-1])


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * np.arange(k)[:, None] * (2 * np.arange(n) + 1) / (2 * n))


_LOW = _cosines(SIDE, LOW)


def _resized(pixels: np.ndarray, n: int, axis: int) -> np.ndarray:
    """Means of ``n`` stretches of an axis; a short axis repeats its samples."""
    size = pixels.shape[axis]
    if size < n:
        return np.take(pixels, np.arange(n) * size // n, axis=axis)
    edges = np.arange(n + 1) * size // n
    sums = np.add.reduceat(pixels, edges[:-1], axis=axis)
    counts = np.diff(edges)
    return sums / (counts[:, None] if axis == 0 else counts)


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits in hexadecimal: which of the 8 by 8 lowest frequencies lie above their median (the constant one aside)."""
    small = _resized(_resized(pixels.astype(np.float64), SIDE, 0), SIDE, 1)
    low = np.round(_LOW @ small @ _LOW.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def payload_image(payload: bytes) -> np.ndarray:
    """The payload as rows of 64 samples, filled up with zeros to one whole row at least."""
    height = max(1, -(-len(payload) // WIDTH))
    return np.frombuffer(payload.ljust(height * WIDTH, b"\0"), np.uint8).reshape(height, WIDTH)


MEDIA = "doc_id long, n_bytes long, media binary"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _runs(sizes: list[int], most: int = 4 << 20) -> Iterator[slice]:
    """Runs of neighbouring rows of at most so many bytes, or one row."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if sizes:
        yield slice(at, len(sizes))


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        raw = [(t or "").encode() for t in batch["text"]]
        sizes = [len(x) for x in raw]
        for run in _runs(sizes):
            yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[run], "n_bytes": sizes[run], "media": encode_pngs([payload_image(x) for x in raw[run]])})


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        files = list(batch["media"])
        for run in _runs([len(f) for f in files], 1 << 20):
            rows = []
            for media, pixels in zip(files[run], decode_pngs(files[run])):
                payload = pixels.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(pixels)))
            part = batch[["doc_id", "n_bytes"]].iloc[run]
            out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], index=part.index)
            yield pd.concat([part, out], axis=1)


def to_media(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and the text's bytes as a PNG file in the binary column ``media``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_encoded, MEDIA)


def read_media(media: DataFrame) -> DataFrame:
    """Digests and hash of each stored file, from its bytes alone."""
    return media.select("doc_id", "n_bytes", "media").mapInPandas(_read_back, DIGEST)


def op7_media(spark, sf_dir: str) -> DataFrame:
    return read_media(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
