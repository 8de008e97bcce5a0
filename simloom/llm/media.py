"""Media columns (op10): Netpbm and BMP images, integral-image resizing, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from simloom.llm import common

#: Bytes of one row of stored samples: 64 pixels of three channels.
ROW_BYTES, ROW_PIXELS = 192, 64
#: Texts of more rows than this are kept as BMP, the others as PPM.
PPM_ROWS = 8
#: Side of a tile, and tiles that a resized image has at most.
TILE, MOST_TILES = 64, 4
#: Rows that are integrated at once.
BAND_ROWS = 16384


def _netpbm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    want = 2 if data[:2] in (b"P1", b"P4") else 3
    while len(fields) < want:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and not data[end : end + 1].isspace() and data[end : end + 1] != b"#":
            end += 1
        fields.append(int(data[at:end]))
        at = end
    at += 1
    width, height, kind = fields[0], fields[1], data[:2]
    top = 1 if want == 2 else fields[2]
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    if kind == b"P4":
        stride = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride), axis=1)
        return ((1 - bits[:, :width]) * 255).astype(np.uint8)
    if kind == b"P1":
        bits = np.frombuffer(bytes(c for c in data[at:] if c in b"01"), np.uint8)[:n] - 48
        return ((1 - bits) * 255).astype(np.uint8).reshape(height, width)
    if kind in (b"P2", b"P3"):
        samples = np.array(data[at:].split()[:n], np.int64)
    else:
        samples = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at)
    if top != 255:
        samples = (samples.astype(np.int64) * 255 + top // 2) // top
    pixels = samples.astype(np.uint8, copy=False)
    return pixels.reshape((height, width, 3) if channels == 3 else (height, width))


def _bmp(data: bytes) -> np.ndarray:
    start, head, width, height, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or depth not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP of {depth} bits, compression {packed}, is not supported")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if depth >= 24:
        pixels = raw[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]
    else:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1]
        if depth == 8:
            index = raw[:, :width]
        elif depth == 4:
            index = np.stack([raw >> 4, raw & 15], 2).reshape(rows, -1)[:, :width]
        else:
            index = np.unpackbits(raw, axis=1)[:, :width]
        pixels = palette[index]
    return np.ascontiguousarray(pixels[::-1] if height > 0 else pixels)


def decode_image(data: bytes) -> np.ndarray:
    """A Netpbm (P1 to P6) or BMP image as 8-bit samples: height x width, or height x width x 3."""
    if data[:2] == b"BM":
        return _bmp(data)
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_ppm(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    return b"P6\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed BMP of 24 bits, bottom row first."""
    height, width = pixels.shape[:2]
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma by integer weights out of 256, as 64-bit integers."""
    if pixels.ndim == 2:
        return pixels.astype(np.int64)
    p = pixels.astype(np.int64)
    return (77 * p[..., 0] + 150 * p[..., 1] + 29 * p[..., 2]) >> 8


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean luma of the area under each target pixel, edges weighted by their share, from an integral image.

    The integral image is made in bands of BAND_ROWS rows; of it, only the rows at the target's edges are kept.
    """
    rows, cols = pixels.shape[:2]

    def at(edges, size):
        low = np.minimum(edges.astype(np.int64), size - 1)
        return low, edges - low

    y, fy = at(np.linspace(0, rows, height + 1), rows)
    x, fx = at(np.linspace(0, cols, width + 1), cols)
    upper, lower, so_far = np.zeros((height + 1, cols + 1)), np.zeros((height + 1, cols + 1)), np.zeros(cols + 1)
    for top in range(0, rows, BAND_ROWS):
        plane = grey(pixels[top : top + BAND_ROWS])
        total = np.zeros((len(plane) + 1, cols + 1))
        np.cumsum(np.cumsum(plane, 0, dtype=np.float64), 1, out=total[1:, 1:])
        total += so_far
        mine = np.flatnonzero((y >= top) & (y < top + len(plane)))
        upper[mine], lower[mine] = total[y[mine] - top], total[y[mine] - top + 1]
        so_far = total[-1].copy()
    by_row = upper * (1 - fy)[:, None] + lower * fy[:, None]
    both = by_row[:, x] * (1 - fx) + by_row[:, x + 1] * fx
    return np.diff(np.diff(both, axis=0), axis=1) * (height * width / (rows * cols))


def difference_hash(pixels: np.ndarray, size: int = 8) -> int:
    """Bits of a size x size comparison of neighbours in a row, the first in the highest bit; equal neighbours give 0."""
    small = np.round(area_resize(pixels, size, size + 1), 6)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def npy_tiles(pixels: np.ndarray, side: int = 64) -> list[bytes]:
    """The image cut into tiles of side x side (smaller at the edges), row by row, each as an NPY file."""
    out = []
    for y in range(0, pixels.shape[0], side):
        for x in range(0, pixels.shape[1], side):
            np.save(buffer := io.BytesIO(), np.ascontiguousarray(pixels[y : y + side, x : x + side]), allow_pickle=False)
            out.append(buffer.getvalue())
    return out


def store(text: str) -> tuple[bytes, int]:
    """(PPM or BMP file of a text's padded UTF-8 bytes as rows of 64 pixels, unpadded size)."""
    data = text.encode("utf-8")
    rows = max(1, -(-len(data) // ROW_BYTES))
    pixels = np.frombuffer(data.ljust(rows * ROW_BYTES, b" "), np.uint8).reshape(rows, ROW_PIXELS, 3)
    return (encode_ppm if rows <= PPM_ROWS else encode_bmp)(pixels), len(data)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, with_files: bool = False) -> DataFrame:
    """Store each whole text as a PPM or BMP image, read it back, and derive digests, NPY tiles and a difference hash.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and tiles (the
    luma, area-resized to at most tile columns and MOST_TILES times tile rows, as NPY files of at most tile x tile), and
    with_files also media (the file). A null or empty text is one row of blanks; repeated rows give equal values; null ids
    stay; an empty table gives an empty one. A text takes a few times its size in memory, one text at a time.
    """

    def run(batches):
        for part, texts in common.text_slices(batches):
            out: list[list] = [[] for _ in kinds]
            for text in texts:
                media, n = store(text)
                pixels = decode_image(media)
                payload = pixels.tobytes()
                small = area_resize(pixels, min(MOST_TILES * tile, pixels.shape[0]), min(tile, pixels.shape[1]))
                row = [
                    n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(),
                    f"dhash:{difference_hash(pixels):016x}", npy_tiles(np.rint(small).astype(np.uint8), tile), media,
                ]
                for column, x in zip(out, row, strict=False):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", *names])

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tiles"] + ["media"] * with_files
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.binary())] + [pa.binary()] * with_files
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tiles array<binary>"
    return common.id_text(docs, id_col, text_col).mapInArrow(run, schema + ", media binary" * with_files)
