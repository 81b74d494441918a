"""Media columns: Netpbm and BMP files as binary values, read back as arrays."""

from __future__ import annotations

import hashlib
import io
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.shared import slices, utf8

FORMATS = ("pgm", "ppm", "bmp")
#: Payloads are padded to a multiple of this: whole rows of 24 pixels of 1 or 3 samples.
UNIT, WIDTH, PAD = 576, 24, 255


def encode_netpbm(samples: np.ndarray) -> bytes:
    """A raw PGM (2-d) or PPM (3-d) file of 8-bit samples."""
    high, wide = samples.shape[:2]
    return b"%s\n%d %d\n255\n" % (b"P6" if samples.ndim == 3 else b"P5", wide, high) + samples.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """The samples of a raw or plain PGM or PPM file of at most 8 bits; ValueError for anything else."""
    fields: list[bytes] = []
    at = 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at)
            if at < 0:
                raise ValueError("a Netpbm comment has no end")
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace() and data[end : end + 1] != b"#":
            end += 1
        if end == at:
            raise ValueError("a Netpbm header ends early")
        fields.append(data[at:end])
        at = end
        if fields[0] not in (b"P2", b"P3", b"P5", b"P6") or not all(x.isdigit() for x in fields[1:]):
            raise ValueError("no Netpbm header")
    kind, wide, high, top = fields[0], *map(int, fields[1:])
    if not 0 < top < 256 or wide < 1 or high < 1:
        raise ValueError(f"unsupported Netpbm file: {wide} x {high}, {top}")
    shape = (high, wide, 3) if kind in (b"P3", b"P6") else (high, wide)
    n = math.prod(shape)
    if kind in (b"P2", b"P3"):
        words = data[at:].split()[:n]
        if len(words) < n or any(not x.isdigit() or int(x) > top for x in words):
            raise ValueError("Netpbm samples are missing or out of range")
        out = np.array([int(x) for x in words], np.uint8)
    else:
        if len(data) - at - 1 < n:
            raise ValueError("a Netpbm file ends early")
        out = np.frombuffer(data, np.uint8, n, at + 1)
    return out.reshape(shape)


#: The palette of an 8-bit grey BMP.
_GREYS = bytes(v for k in range(256) for v in (k, k, k, 0))


def encode_bmp(samples: np.ndarray) -> bytes:
    """A 24-bit BMP (3-d samples, RGB) or 8-bit grey BMP (2-d): rows bottom up, padded to 4 bytes."""
    high, wide = samples.shape[:2]
    depth = 24 if samples.ndim == 3 else 8
    palette = b"" if depth == 24 else _GREYS
    row = wide * depth // 8
    lines = np.zeros((high, (row + 3) // 4 * 4), np.uint8)
    lines[:, :row] = (samples[..., ::-1] if depth == 24 else samples).reshape(high, row)
    body = lines[::-1].tobytes()
    start = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start)
    head += struct.pack("<IiiHHIIiiII", 40, wide, high, 1, depth, 0, len(body), 2835, 2835, len(palette) // 4, 0)
    return head + palette + body


def decode_bmp(data: bytes) -> np.ndarray:
    """The samples of an uncompressed 8-bit grey or 24-bit BMP, rows in either order; ValueError for anything else."""
    if len(data) < 54:
        raise ValueError("a BMP header ends early")
    magic, _, _, _, start = struct.unpack_from("<2sIHHI", data)
    _, wide, high, _, depth, packing = struct.unpack_from("<IiiHHI", data, 14)
    if magic != b"BM" or packing or depth not in (8, 24):
        raise ValueError("unsupported BMP file")
    row = wide * depth // 8
    if wide < 1 or high == 0 or start < 54 or len(data) - start < abs(high) * ((row + 3) // 4 * 4):
        raise ValueError("a BMP file ends early")
    if depth == 8 and data[54:start][: 4 * 256] != _GREYS[: start - 54]:
        raise ValueError("a BMP palette that is not grey")
    lines = np.frombuffer(data, np.uint8, abs(high) * ((row + 3) // 4 * 4), start).reshape(abs(high), -1)[:, :row]
    lines = lines[::-1] if high > 0 else lines
    return lines.reshape(abs(high), wide, 3)[..., ::-1] if depth == 24 else lines


def encode_media(payload: bytes, kind: str) -> bytes:
    """A payload of whole rows as a file of the given format; lossless."""
    samples = np.frombuffer(payload, np.uint8)
    if kind == "pgm":
        return encode_netpbm(samples.reshape(-1, WIDTH))
    pixels = samples.reshape(-1, WIDTH, 3)
    return encode_netpbm(pixels) if kind == "ppm" else encode_bmp(pixels)


def decode_media(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(grey: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Means over the areas that the target's cells cover, exact for fractional edges.

    One integral image serves every cell: its value at a fractional place is the bilinear mix of
    the four around it, which is the exact integral of the step function the samples define.
    """
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = grey.cumsum(0, dtype=np.float64).cumsum(1)
    y = np.linspace(0, h, high + 1)
    x = np.linspace(0, w, wide + 1)

    def mix(table: np.ndarray, at: np.ndarray) -> np.ndarray:
        low = np.minimum(at.astype(np.int64), len(table) - 2)
        part = (at - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    at = mix(mix(total, y).T, x).T
    cells = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    return cells / (h / high * w / wide)


def npy_tile(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def difference_hash(tile: np.ndarray) -> str:
    """16 hex digits: whether each cell of an 8 x 9 tile is darker than its right neighbour."""
    return np.packbits(tile[:, :-1] < tile[:, 1:]).tobytes().hex()


def text_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): every text, padded with bytes 255 to a positive multiple of 576, as a file.

    The format follows from the payload's CRC, so equal texts give equal files.  Null text: empty,
    a payload of padding alone.  Empty table: no rows.  Null keys and repeated rows: one row each.
    A very long text is one file, held whole.  Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, at = utf8(batch.column(1))
            for a in range(0, batch.num_rows, 256):  # few files at a time
                files, sizes = [], []
                b = min(batch.num_rows, a + 256)
                for p, q in zip(at[a:b].tolist(), at[a + 1 : b + 1].tolist(), strict=True):
                    n = q - p
                    payload = raw[p:q].tobytes() + bytes([PAD]) * (max(UNIT, -(-n // UNIT) * UNIT) - n)
                    files.append(encode_media(payload, FORMATS[zlib.crc32(payload) % len(FORMATS)]))
                    sizes.append(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=[key, "n_bytes", "media"])

    source = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return source.mapInArrow(run, f"`{key}` {dict(source.dtypes)[key]}, n_bytes long, media binary")


def media_features(files: DataFrame, media: str = "media") -> DataFrame:
    """``files`` with the digests of what its media column holds, an 8 x 9 NPY tile and its difference hash.

    Columns added: payload_bytes, payload_sha256, tail_crc32 (last 32 bytes), media_bytes,
    media_sha256, tile_npy, feature, media_error.  A null file gives nulls.  A file that is cut short,
    malformed or of a kind that isn't read has its media_bytes and media_sha256, the reason as
    media_error, and nulls otherwise: it never stops the job.  Columns of ``files`` that have one of
    these names are replaced.  Empty table: no rows.  Very long files are held whole, one at a time.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tile_npy", "feature", "media_error"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()]
    others = [c for c in files.columns if c != media and c.lower() not in names]

    def features(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(names)
        stored = len(data), hashlib.sha256(data).hexdigest()
        try:
            samples = decode_media(data)
        except ValueError as e:
            return (None, None, None, *stored, None, None, str(e))
        payload = np.ascontiguousarray(samples).tobytes()
        grey = samples if samples.ndim == 2 else samples.mean(2)
        tile = area_resize(grey, 8, 9)
        tile = np.rint(tile.round(6)).astype(np.uint8)  # so that a mean of one half is no matter of the sums' order
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
            *stored, npy_tile(tile), difference_hash(tile), None,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = batch.column(len(others))
            found = list(zip(*[features(x.as_py()) for x in column], strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *[pa.array(x, t) for x, t in zip(found, kinds, strict=True)]], names=[*others, *names])

    source = files.select(*others, media)
    schema = "".join(f"`{c}` {t}, " for c, t in source.dtypes if c != media)
    return source.mapInArrow(run, schema + "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile_npy binary, feature string, media_error string")
