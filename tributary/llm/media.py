"""Media columns: Netpbm and BMP pictures decoded to numpy arrays, area-resized by integral images, tiled as NPY, with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, utf8

#: The payload of a text is a whole number of rows of UNIT / TILE samples: pictures are TILE wide.
UNIT, TILE, FILL = 576, 24, 255


def pgm(picture: np.ndarray) -> bytes:
    """A grey (H, W) uint8 array as binary Netpbm (P5), losslessly."""
    return b"P5\n%d %d\n255\n" % (picture.shape[1], picture.shape[0]) + np.ascontiguousarray(picture).tobytes()


def bmp(picture: np.ndarray) -> bytes:
    """A grey (H, W) uint8 array as an 8-bit BMP with a grey palette, rows bottom-up and padded to four bytes."""
    h, w = picture.shape
    rows = np.zeros((h, -(-w // 4) * 4), np.uint8)
    rows[:, :w] = picture[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    head = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return b"BM" + struct.pack("<IHHI", 14 + 40 + 1024 + rows.size, 0, 0, 14 + 40 + 1024) + head + palette.tobytes() + rows.tobytes()


_NETPBM = re.compile(rb"(P[1-6])((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)(?:((?:\s+|#[^\n]*\n)+)(\d+))?\s")


def decode(media: bytes) -> np.ndarray | None:
    """(H, W) or (H, W, 3) uint8 samples of a Netpbm (P1-P6, 8 bits) or an uncompressed 8- or 24-bit BMP picture; None where it is neither, or broken."""
    try:
        if media[:2] == b"BM":
            at, size, w, h, _, depth, packed = struct.unpack_from("<IIiiHHI", media, 10)
            if packed or depth not in (8, 24) or w <= 0 or h == 0:
                return None
            width = -(-w * depth // 32) * 4
            rows = np.frombuffer(media, np.uint8, width * abs(h), at).reshape(abs(h), width)
            rows = rows[::-1] if h > 0 else rows
            if depth == 24:
                return rows[:, : 3 * w].reshape(abs(h), w, 3)[:, :, ::-1]
            used = struct.unpack_from("<I", media, 46)[0] or 256
            palette = np.frombuffer(media, np.uint8, 4 * used, 14 + size).reshape(-1, 4)[:, 2::-1]
            if (palette == palette[:, :1]).all():
                return palette[:, 0][rows[:, :w]]
            return palette[rows[:, :w]]
        bitmap = media[:2] in (b"P1", b"P4")
        m = re.match(rb"(P[14])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s", media) if bitmap else _NETPBM.match(media)
        if not m:
            return None
        w, h, most = (int(m[2]), int(m[3]), 1) if bitmap else (int(m[3]), int(m[5]), int(m[7] or 0))
        kind, body = m[1], media[m.end() :]
        if not 0 < most < 256:
            return None
        depth = 3 if kind in (b"P3", b"P6") else 1
        if kind == b"P4":
            bits = np.unpackbits(np.frombuffer(body, np.uint8, -(-w // 8) * h).reshape(h, -1), axis=1)[:, :w]
            return (1 - bits) * np.uint8(255)
        if kind == b"P1":
            return (1 - np.array([int(chr(c)) for c in body if c in b"01"], np.uint8).reshape(h, w)) * np.uint8(255)
        flat = np.frombuffer(body, np.uint8, w * h * depth) if kind in (b"P5", b"P6") else np.array(body.split(), np.uint8)[: w * h * depth]
        if most != 255:
            flat = (flat.astype(np.uint32) * 255 // most).astype(np.uint8)
        return flat.reshape((h, w, 3) if depth == 3 else (h, w))
    except (ValueError, struct.error, IndexError):
        return None


def resize_area(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each target sample covers, from an integral image with linear parts at the borders; uint8, rounded."""
    if picture.ndim == 3:
        return np.stack([resize_area(picture[:, :, c], height, width) for c in range(picture.shape[2])], 2)
    h, w = picture.shape
    total = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(picture, 0, out=total[1:, 1:], dtype=np.int64)
    np.cumsum(total[1:, 1:], 1, out=total[1:, 1:])

    def at(n: int, parts: int):
        x = np.arange(parts + 1) * n / parts
        low = np.minimum(x.astype(np.int64), n - 1)
        return low, x - low

    y, fy = at(h, height)
    x, fx = at(w, width)
    rows = total[y] * (1 - fy)[:, None] + total[y + 1] * fy[:, None]
    grid = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    sums = np.diff(np.diff(grid, axis=0), axis=1)
    return np.clip(np.rint(sums * (height * width) / (h * w)), 0, 255).astype(np.uint8)


def difference_hash(picture: np.ndarray) -> int:
    """64 bits: of an 8 x 9 area-resized grey picture, whether each sample is darker than the one to its right."""
    grey = picture if picture.ndim == 2 else picture.mean(2).astype(np.uint8)
    small = resize_area(grey, 8, 9)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(tile), allow_pickle=False)
    return out.getvalue()


def text_media(docs: DataFrame, form: str = "pgm", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each text's UTF-8 bytes, filled with 255 to a positive multiple of UNIT, as a picture TILE samples wide.

    Null counts as empty; other columns are ignored; an empty table gives an empty result.
    """
    write = {"pgm": pgm, "bmp": bmp}[form]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, at = utf8(batch.column(1))
            media, n, first, held = [], [], 0, 0
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                payload = np.full(max(1, -(-(b - a) // UNIT)) * UNIT, FILL, np.uint8)
                payload[: b - a] = data[a:b]
                media.append(write(payload.reshape(-1, TILE)))
                n.append(b - a)
                held += len(payload)
                if held > 1 << 22 or k == len(at) - 2:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(n)), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])
                    media, n, first, held = [], [], k + 1, 0

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def media_features(media: DataFrame, media_col: str = "media", tile: int = TILE) -> DataFrame:
    """``media`` plus height, width, channels, dhash (hex), tile (NPY of the picture resized to tile x tile),
    samples_bytes, samples_sha256 and samples_tail_crc32 (of the last 32 decoded samples).

    A null, empty or broken picture has nulls in all of these.
    """
    from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

    names = ["height", "width", "channels", "dhash", "tile", "samples_bytes", "samples_sha256", "samples_tail_crc32"]
    kinds = [IntegerType(), IntegerType(), IntegerType(), StringType(), BinaryType(), LongType(), StringType(), LongType()]
    media = media.drop(*names)
    schema = StructType([*media.schema.fields, *(StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    place = media.columns.index(media_col)

    def features(raw: bytes | None):
        picture = decode(raw) if raw else None
        if picture is None:
            return (None,) * len(names)
        small = npy(resize_area(picture, tile, tile))
        flat = np.ascontiguousarray(picture).tobytes()
        return (*picture.shape[:2], picture.shape[2] if picture.ndim == 3 else 1, f"{difference_hash(picture):016x}", small, len(flat), hashlib.sha256(flat).hexdigest(), zlib.crc32(flat[-32:]))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                found = list(zip(*(features(raw.as_py()) for raw in part.column(place)), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, t) for x, t in zip(found, types, strict=True))], schema.fieldNames())

    return media.mapInArrow(run, schema)


def stored(media: DataFrame, name: str = "media") -> DataFrame:
    """The table of pictures or NPY tiles as it is read back from Parquet files in the shared folder."""
    return materialize(media, name)
