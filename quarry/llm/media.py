"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized, tiled and hashed.

``decode_image`` reads Netpbm (P1 to P6, 1 to 8 bits) and uncompressed 8, 24 and 32 bit BMP into ``uint8`` arrays of
shape (height, width, channels). ``area_resize`` averages source areas with an integral image, fractional borders
included. ``difference_hash`` compares neighbours of the 9 by 8 grey reduction. ``tiles`` writes an image as NPY
tiles and ``join_tiles`` reads them back. ``text_media_digest`` takes a text through all of it: its bytes are the
samples of a PPM, which is decoded and stored as NPY tiles one after another; what is read back from them is the
payload and the image whose difference hashes, of the whole and of each tile, are the feature. All are exact in integers up to the last division, so equal bytes give equal results on any machine.

Defined results: a null payload is the empty one; an empty payload is padded to one row; undecodable media give null
columns in ``describe``; repeated rows and null ids are handled row by row; an empty table gives an empty result;
columns other than the id and the payload are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map, field, utf8

#: A row of 64 RGB pixels: the unit that payloads are padded to.
ROW_BYTES, WIDTH, CHANNELS = 192, 64, 3
#: Pixels of a tile's sides.
TILE = 64
#: Rows of pixels that the resize adds up at once; bounds the integral image of very tall images.
BAND = 4096
_HEADER = re.compile(rb"(?:\s+|#[^\n\r]*[\n\r])*(\d+)")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at = data[1:2], 2
    numbers = []
    for _ in range(2 if kind in b"14" else 3):
        m = _HEADER.match(data, at)
        if m is None:
            raise ValueError("bad Netpbm header")
        numbers.append(int(m[1]))
        at = m.end()
    width, height = numbers[:2]
    top = numbers[2] if len(numbers) > 2 else 1
    if not 0 < top < 256 or width < 1 or height < 1:
        raise ValueError("unsupported Netpbm size or depth")
    channels = 3 if kind in b"36" else 1
    n = width * height * channels
    if kind in b"123":
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        values = np.array(list(re.sub(rb"\s", b"", body)[:n]) if kind == b"1" else body.split()[:n], dtype=np.int64)
        values = values - 48 if kind == b"1" else values
        if values.size != n or (n and (values.min() < 0 or values.max() > top)):
            raise ValueError("bad Netpbm samples")
        samples = values.astype(np.uint8)
    elif kind == b"4":
        stride = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        samples = np.unpackbits(raw, axis=1)[:, :width].reshape(-1)
    else:
        samples = np.frombuffer(data, np.uint8, n, at + 1)
    if kind in b"14":
        samples = 1 - samples
    image = samples.reshape(height, width, channels)
    return image if top == 255 else (image.astype(np.uint16) * 255 // top).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    offset, header = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height = struct.unpack_from("<ii", data, 18)
    bits, compression = struct.unpack_from("<H", data, 28)[0], struct.unpack_from("<I", data, 30)[0]
    if header < 40 or compression != 0 or bits not in (8, 24, 32) or width < 1 or height == 0:
        raise ValueError("unsupported BMP")
    rows, stride = abs(height), (width * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)
    raw = raw if height < 0 else raw[::-1]
    pixels = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(colours, 4)
        return palette[:, 2::-1][pixels[:, :, 0]]
    return pixels[:, :, 2::-1]


def decode_image(data: bytes) -> np.ndarray:
    """The image as (height, width, channels) ``uint8``; ValueError for anything else."""
    try:
        if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (struct.error, ValueError, IndexError) as e:
        raise ValueError(f"undecodable image: {e}") from e
    raise ValueError("neither Netpbm nor BMP")


def encode_ppm(image: np.ndarray) -> bytes:
    """Binary PPM (P6) or, with one channel, PGM (P5)."""
    height, width, channels = image.shape
    return b"P%d\n%d %d\n255\n" % (6 if channels == 3 else 5, width, height) + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit BMP, bottom row first."""
    height, width, _ = image.shape
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, width * 3)
    size = 54 + rows.size
    return struct.pack("<2sIHHI", b"BM", size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole part and numerator (over ``parts``) of the borders of ``parts`` equal areas of ``n`` samples."""
    at = np.arange(parts + 1, dtype=np.int64) * n
    return at // parts, at % parts


def _cumulative(values: np.ndarray, n: int, parts: int) -> np.ndarray:
    """``parts`` times the integral up to each border, from integral ``values`` (n + 1 along axis 0)."""
    whole, rest = _edges(n, parts)
    after = np.minimum(whole + 1, n)
    rest = rest.reshape(-1, *[1] * (values.ndim - 1))
    return values[whole] * (parts - rest) + values[after] * rest


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target pixel's source area (enlarging included), rounded half up; exact integer arithmetic.

    The integral image is made in bands of rows, so that very tall images need no second copy of their own size.
    """
    h, w, c = image.shape
    columns = np.zeros((h + 1, width, c), np.int64)
    for lo in range(0, h, BAND):
        band = np.zeros((min(BAND, h - lo), w + 1, c), np.int64)
        np.cumsum(image[lo : lo + BAND], axis=1, out=band[:, 1:])
        columns[lo + 1 : lo + 1 + len(band)] = np.diff(_cumulative(band.swapaxes(0, 1), w, width), axis=0).swapaxes(0, 1)
    np.cumsum(columns, axis=0, out=columns)
    sums = np.diff(_cumulative(columns, h, height), axis=0)
    area = h * w
    return ((2 * sums + area) // (2 * area)).astype(np.uint8)


def grey(image: np.ndarray) -> np.ndarray:
    """Integer luma of an RGB image; one channel as it is."""
    if image.shape[2] == 1:
        return image[:, :, 0]
    return ((image[:, :, 0].astype(np.int64) * 299 + image[:, :, 1].astype(np.int64) * 587 + image[:, :, 2].astype(np.int64) * 114 + 500) // 1000).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: is each pixel of the 8 x 9 grey reduction darker than its right neighbour?"""
    small = grey(area_resize(image, 8, 9))
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def tiles(image: np.ndarray, tile: int = TILE) -> list[tuple[int, int, bytes]]:
    """``(row, column, NPY bytes)`` of each tile; tiles at the right and lower border may be smaller."""
    h, w, _ = image.shape
    return [(y // tile, x // tile, npy(image[y : y + tile, x : x + tile])) for y in range(0, h, tile) for x in range(0, w, tile)]


def store_tiles(image: np.ndarray, tile: int = TILE) -> bytes:
    """All tiles as NPY files, one after another."""
    return b"".join(raw for _, _, raw in tiles(image, tile))


def read_tiles(stored: bytes) -> list[np.ndarray]:
    """The arrays of NPY files that stand one after another."""
    data, out = io.BytesIO(stored), []
    while data.tell() < len(stored):
        out.append(np.load(data, allow_pickle=False))
    return out


def join_tiles(parts: list[np.ndarray], width: int) -> np.ndarray:
    """The image of that width whose tiles these are, row by row."""
    rows, row, at = [], [], 0
    for part in parts:
        row.append(part)
        at += part.shape[1]
        if at >= width:
            rows.append(row[0] if len(row) == 1 else np.hstack(row))
            row, at = [], 0
    return rows[0] if len(rows) == 1 else np.vstack(rows)


def pack_payload(payload: bytes) -> tuple[bytes, bytes]:
    """The payload padded with blanks to a positive multiple of 192, and the PPM that stores it."""
    padded = payload + b" " * (-len(payload) % ROW_BYTES if payload else ROW_BYTES)
    return padded, b"P6\n%d %d\n255\n" % (WIDTH, len(padded) // ROW_BYTES) + padded


def describe(media: DataFrame, id_col: str, media_col: str, thumb: int = 32) -> DataFrame:
    """``(id, height, width, channels, dhash, thumbnail)``; the thumbnail is an NPY array of at most ``thumb`` squared."""

    def fn(batch: pa.RecordBatch) -> list:
        rows = []
        for data in batch.column(1).to_pylist():
            try:
                image = decode_image(data or b"")
            except ValueError:
                rows.append((None,) * 5)
                continue
            h, w, c = image.shape
            scale = max(h, w, thumb)
            small = area_resize(image, max(1, h * thumb // scale), max(1, w * thumb // scale))
            rows.append((h, w, c, difference_hash(image), npy(small)))
        return [batch.column(0), *([r[k] for r in rows] for k in range(5))]

    names = [("height", T.IntegerType()), ("width", T.IntegerType()), ("channels", T.IntegerType()), ("dhash", T.StringType()), ("thumbnail", T.BinaryType())]
    return arrow_map(media.select(id_col, media_col), fn, T.StructType([field(media, id_col), *(T.StructField(*x) for x in names)]), at_once=64)


def tile_rows(media: DataFrame, id_col: str, media_col: str, tile: int = TILE) -> DataFrame:
    """One row per tile: ``(id, tile_row, tile_col, npy, dhash)``, to be written by any sink. Undecodable media give none."""

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1)):
                try:
                    image = decode_image(data.as_py() or b"")
                except ValueError:
                    continue
                for y, x, raw in tiles(image, tile):
                    part = image[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()], batch.schema.field(0).type), pa.array([y], pa.int32()), pa.array([x], pa.int32()), pa.array([raw], pa.binary()), pa.array([difference_hash(part)])],
                        names=[id_col, "tile_row", "tile_col", "npy", "dhash"],
                    )

    from .common import ship

    ship(media.sparkSession)
    names = [("tile_row", T.IntegerType()), ("tile_col", T.IntegerType()), ("npy", T.BinaryType()), ("dhash", T.StringType())]
    return media.select(id_col, media_col).mapInArrow(run, T.StructType([field(media, id_col), *(T.StructField(*x) for x in names)]))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, media)``: each text as the PPM that ``pack_payload`` makes."""

    def fn(batch: pa.RecordBatch) -> list:
        return [batch.column(0), [pack_payload(b)[1] for b in utf8(batch.column(1))]]

    return arrow_map(docs.select(id_col, text_col), fn, T.StructType([field(docs, id_col), T.StructField("media", T.BinaryType())]))


def text_media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)`` of every text.

    The stored form is the PPM's image as NPY tiles; payload and feature come from what is read back from it. The
    feature is ``dhash:`` and the whole image's hash, then the hash of each tile, joined by colons.
    """

    def fn(batch: pa.RecordBatch) -> list:
        rows = []
        for data in utf8(batch.column(1)):
            stored = store_tiles(decode_image(pack_payload(data)[1]))
            parts = read_tiles(stored)
            image = join_tiles(parts, WIDTH)
            back = image.tobytes()
            whole = difference_hash(image)
            marks = [whole] if len(parts) == 1 else [difference_hash(t) for t in parts]
            rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), ":".join(["dhash", whole, *marks])))
        return [batch.column(0), *([r[k] for r in rows] for k in range(7))]

    names = [
        ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()),
        ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()),
    ]
    return arrow_map(docs.select(id_col, text_col), fn, T.StructType([field(docs, id_col), *(T.StructField(*x) for x in names)]))
