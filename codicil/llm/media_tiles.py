"""Media columns: Netpbm and BMP images as arrays, area resizing, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Bytes of one image row of a payload: 64 RGB pixels.
ROW_BYTES = 192
TILE = (8, 9)


class MediaError(ValueError):
    """Bytes that are not an image this module reads."""


_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([^\s#]+)")
#: Digits of the greatest number that a header or a sample may have.
_DIGITS = 9


def _number(token: bytes) -> int:
    digits = token.lstrip(b"0")
    if not token.isdigit() or len(digits) > _DIGITS:
        raise MediaError("bad Netpbm number")
    return int(digits or b"0")


def _header(data: bytes, at: int, count: int) -> tuple[list[int], int]:
    values = []
    for _ in range(count):
        m = _TOKEN.match(data, at)
        if not m:
            raise MediaError("bad Netpbm header")
        values.append(_number(m[1]))
        at = m.end()
    return values, at


def _netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """Samples as they are stored, and the greatest one that the header allows (255 for bitmaps)."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise MediaError("not Netpbm")
    bitmap, channels = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    (width, height, *top), at = _header(data, 2, 2 if bitmap else 3)
    top = top[0] if top else 1
    if not 0 < top < 65536:
        raise MediaError("bad Netpbm maximum")
    shape = (height, width, 3) if channels == 3 else (height, width)
    count = width * height * channels
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\r\n]*", b"", data[at:])
        tokens = re.findall(rb"[01]", body) if bitmap else body.split()
        values = np.array([_number(t) for t in tokens[:count]], np.int64)
    elif kind == b"P4":
        stride = -(-width // 8)
        raster = data[at + 1 : at + 1 + height * stride]
        if len(raster) < height * stride:
            raise MediaError("short Netpbm raster")
        values = np.unpackbits(np.frombuffer(raster, np.uint8).reshape(height, stride), axis=1)[:, :width].ravel()
    else:
        step = 2 if top > 255 else 1
        body = data[at + 1 : at + 1 + count * step]
        values = np.frombuffer(body[: len(body) // step * step], ">u2" if step == 2 else np.uint8)
    if len(values) < count:
        raise MediaError("short Netpbm raster")
    if count and values.max() > top:
        raise MediaError("a Netpbm sample is over the maximum")
    values = values.reshape(shape)
    if bitmap:
        return np.where(values, 0, 255).astype(np.uint8), 255
    return values.astype(np.uint16 if top > 255 else np.uint8), top


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 (uint16 where the maximum is over 255): height x width, or x 3."""
    return _netpbm(data)[0]


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 1, 4, 8, 24 and 32 bit BMP as height x width x 3 uint8, top row first."""
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("not BMP")
    (start,) = struct.unpack_from("<I", data, 10)
    head, width, height, _, depth, packing = struct.unpack_from("<IiiHHI", data, 14)
    upward, height = height > 0, abs(height)
    if packing or depth not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise MediaError("BMP form not supported")
    stride = -(-width * depth // 32) * 4
    if len(data) < start + stride * height:
        raise MediaError("short BMP raster")
    rows = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)
    rows = rows[::-1] if upward else rows
    if depth >= 24:
        return np.ascontiguousarray(rows[:, : width * depth // 8].reshape(height, width, depth // 8)[:, :, 2::-1])
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << depth
    palette = np.zeros((1 << depth, 4), np.uint8)
    given = data[14 + head : 14 + head + 4 * min(colours, 1 << depth)]
    if len(given) < 4 * min(colours, 1 << depth):
        raise MediaError("short BMP palette")
    given = np.frombuffer(given, np.uint8).reshape(-1, 4)
    palette[: len(given)] = given
    bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
    index = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.int64)[:, :width]
    return np.ascontiguousarray(palette[index][:, :, 2::-1])


def _image(data: bytes) -> tuple[np.ndarray, int]:
    return (decode_bmp(data), 255) if data[:2] == b"BM" else _netpbm(data)


def decode_image(data: bytes) -> np.ndarray:
    return _image(data)[0]


def encode_ppm(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (width, height) + pixels.astype(np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    stride = -(-width * 3 // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


#: Samples of the rows of which an integral image is held at once.
_STRIP = 1 << 18


def _integral_rows(grey: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows `at` (ascending) of the integral image, which is made in strips, each upon the last row of the one before."""
    height, width, channels = grey.shape
    kind = np.int64 if grey.dtype.kind in "iu" else np.float64
    out, carry = np.zeros((len(at), width + 1, channels), kind), np.zeros((width + 1, channels), kind)
    step = max(1, _STRIP // (width * channels))
    for start in range(0, height, step):
        strip = np.zeros((min(step, height - start) + 1, width + 1, channels), kind)
        strip[1:, 1:] = np.cumsum(np.cumsum(grey[start : start + step], 0, dtype=kind), 1)
        strip += carry
        own = np.flatnonzero((at >= start) & (at < start + len(strip)))
        out[own] = strip[at[own] - start]
        carry = strip[-1]
    return out


def _areas(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Sums over each target pixel's area, height x width times as great: four corners of the integral image, which within a pixel is bilinear."""

    def grid(target: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(target + 1) * n
        low = np.minimum(edge // target, n - 1)
        return low, edge - low * target

    (row, down), (column, right) = grid(height, grey.shape[0]), grid(width, grey.shape[1])
    wanted = np.unique(np.concatenate([row, row + 1]))
    sums = _integral_rows(grey, wanted)
    upper, lower = (sums[np.searchsorted(wanted, r)] for r in (row, row + 1))
    lines = upper * height + (lower - upper) * down[:, None, None]
    corners = lines[:, column] * width + (lines[:, column + 1] - lines[:, column]) * right[None, :, None]
    return corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]


def _channels(pixels: np.ndarray) -> np.ndarray:
    """The image as height x width x channels, also if it has no pixels."""
    return pixels[:, :, None] if pixels.ndim == 2 else pixels


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target pixel's area; of whole numbers the areas are exact."""
    grey = _channels(pixels)
    if not grey.size:
        return np.zeros((height, width, grey.shape[2]))
    return _areas(grey, height, width) / (grey.shape[0] * grey.shape[1])


def thumbnail(pixels: np.ndarray, top: int = 255) -> np.ndarray:
    """Grey 8 x 9 tile of samples up to `top`, rounded from exact fractions."""
    grey = _channels(pixels)
    if not grey.size:
        return np.zeros(TILE, np.uint8)
    return np.rint(_areas(grey, *TILE).sum(2) * 255 / (top * grey.size)).clip(0, 255).astype(np.uint8)


def difference_hash(tile: np.ndarray) -> str:
    """16 hex digits: whether each pixel of the 8 x 9 tile is darker than its right neighbour."""
    return np.packbits(tile[:, :-1] < tile[:, 1:]).tobytes().hex()


def to_npy(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(pixels), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def payload(text: bytes) -> bytes:
    """A text with spaces up to a positive multiple of a row's bytes."""
    return text.ljust(max(ROW_BYTES, -(-len(text) // ROW_BYTES) * ROW_BYTES), b" ")


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("tile", pa.binary())])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.slices(whole):
            media, tiles, sizes = [], [], []
            for value in batch.column("text").cast(pa.large_binary()):
                text = value.as_py() or b""
                source = np.frombuffer(payload(text), np.uint8).reshape(-1, ROW_BYTES // 3, 3)
                # By the text's length, so that both readers are used and equal texts are treated alike.
                pixels = decode_image(encode_bmp(source) if len(source) % 2 else encode_ppm(source))
                sizes.append(len(text))
                media.append(to_npy(pixels))
                tiles.append(to_npy(thumbnail(pixels)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(tiles, pa.binary())], schema=_STORED)


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height long, width long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _FEATURES.split(", ")]
    for batch in batches:
        rows = []
        for doc, size, media, tile in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "media", "tile")), strict=True):
            stored = media.as_py()
            pixels = from_npy(stored)
            back = pixels.tobytes()
            rows.append((doc.as_py(), size.as_py(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(from_npy(tile.as_py())), *pixels.shape[:2]))
        kinds = [pa.string() if " string" in f else pa.int64() for f in _FEATURES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)


def store_text_media(docs: DataFrame) -> DataFrame:
    """Render each text (null: empty) as an image and store it: doc_id, n_bytes, media (NPY array), tile (NPY thumbnail).

    The text's bytes, padded with spaces, are the pixels of an image 64 wide; the
    array read from it is kept at full size, so the payload comes back unchanged.
    Repeated rows are kept, other columns ignored; an empty table stays empty.
    """
    return common.save(docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary, tile binary"), "media")


def media_features(stored: DataFrame) -> DataFrame:
    """Sizes, digests and the difference hash, from the stored bytes."""
    return stored.mapInArrow(_read, _FEATURES)


def _convert(tile: tuple[int, int]):
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value in zip(batch.column("media_id"), batch.column("content"), strict=True):
                data = value.as_py()
                try:
                    pixels, top = _image(data or b"")
                    full = np.iinfo(pixels.dtype).max
                    small = np.rint(area_resize(pixels, *tile) * (full / top)).clip(0, full).astype(pixels.dtype)
                    rows.append((key.as_py(), *pixels.shape[:2], to_npy(small.reshape(*tile, *pixels.shape[2:])), difference_hash(thumbnail(pixels, top)), None))
                except MediaError as e:
                    rows.append((key.as_py(), None, None, None, None, str(e)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()]
            names = ["media_id", "height", "width", "tile", "dhash", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)

    return convert


def tiles(media: DataFrame, height: int = 32, width: int = 32) -> DataFrame:
    """Images in a binary column (media_id long, content binary) to NPY tiles of one size with difference hashes.

    Samples are scaled from the image's maximum to that of the tile's type. Null or
    unreadable content gives a row with `error` set and nulls elsewhere; an image
    without pixels a black tile. Repeated rows are kept, other columns ignored.
    """
    return media.select("media_id", "content").mapInArrow(_convert((height, width)), "media_id long, height long, width long, tile binary, dhash string, error string")
