"""Pictures as arrays of bytes: storage form, turning, thumbnails, orientation tags."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.functions.text import plain_base64

#: One picture: rows of pixels of so many bytes each.
IMAGE = T.StructType([T.StructField("rows", T.IntegerType()), T.StructField("cols", T.IntegerType()), T.StructField("elem_size", T.IntegerType()), T.StructField("data", T.BinaryType())])


def image_from_json(image: Column) -> Column:
    """Picture from its stored form, whose data is base64."""
    return F.struct(image["rows"].alias("rows"), image["cols"].alias("cols"), image["elemSize"].alias("elem_size"), F.unbase64(image["data"]).alias("data"))


def image_to_json(image: Column) -> Column:
    return F.struct(image["rows"].alias("rows"), image["cols"].alias("cols"), image["elem_size"].alias("elemSize"), (image["rows"] * image["cols"]).alias("total"), plain_base64(image["data"]).alias("data"))


def best_image(images: Column, best: Column, original: Column) -> Column:
    """The rectified picture by its place, else the original one; null if neither place exists."""
    return F.coalesce(F.get(images, best), F.get(images, original))


def _pixels(row) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(row["rows"], row["cols"], row["elem_size"])


def _packed(pixels: np.ndarray) -> dict:
    return {"rows": pixels.shape[0], "cols": pixels.shape[1], "elem_size": pixels.shape[2], "data": np.ascontiguousarray(pixels).tobytes()}


#: Kinds of colour in PNG files by bytes of a pixel: grey, blue-green-red, the same with transparency.
COLOURS = {1: 0, 3: 2, 4: 6}


def png_bytes(pixels: np.ndarray) -> bytes:
    """A PNG file of rows of pixels, which have 1 byte, 3 (blue, green, red) or 4 (and how opaque they are)."""
    rows, cols, size = pixels.shape
    if size not in COLOURS or not rows or not cols:
        raise ValueError(f"no picture: {rows} x {cols} pixels of {size} bytes")
    if size > 1:
        pixels = pixels[:, :, [2, 1, 0, 3][:size]]
    lines = np.zeros((rows, 1 + cols * size), np.uint8)  # each begins with the number of its filter, none
    lines[:, 1:] = pixels.reshape(rows, cols * size)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", cols, rows, 8, COLOURS[size], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


@F.pandas_udf(T.BinaryType())
def png(images: pd.DataFrame) -> pd.Series:
    """The picture as a PNG file; null stays null."""
    return pd.Series([None if r["data"] is None else png_bytes(_pixels(r)) for r in images.to_dict("records")], dtype=object)


def _mapped(images: pd.DataFrame, change) -> pd.DataFrame:
    rows = [None if r["data"] is None else _packed(change(_pixels(r))) for r in images.to_dict("records")]
    none = {"rows": None, "cols": None, "elem_size": None, "data": None}
    return pd.DataFrame([none if r is None else r for r in rows], columns=list(none))


def rotated(image: Column, quarters: int) -> Column:
    """The picture turned clockwise by quarters."""

    @F.pandas_udf(IMAGE)
    def turn(images: pd.DataFrame) -> pd.DataFrame:
        return _mapped(images, lambda p: np.rot90(p, -quarters))

    return turn(image)


def oriented(pixels: np.ndarray, tag: int) -> np.ndarray:
    """Pixels as an orientation tag (1 to 8) says they are to be seen."""
    if tag in (2, 4, 5, 7):
        pixels = pixels[:, ::-1]
    return np.rot90(pixels, {3: 2, 4: 2, 5: 1, 6: -1, 7: -1, 8: 1}.get(tag, 0))


def apply_orientation(image: Column, tag: Column) -> Column:
    @F.pandas_udf(IMAGE)
    def turn(images: pd.DataFrame, tags: pd.Series) -> pd.DataFrame:
        left = iter(tags.fillna(1).astype(int).tolist())
        rows = [None if r["data"] is None else _packed(oriented(_pixels(r), t)) for r, t in zip(images.to_dict("records"), left, strict=True)]
        none = {"rows": None, "cols": None, "elem_size": None, "data": None}
        return pd.DataFrame([none if r is None else r for r in rows], columns=list(none))

    return turn(image, tag)


def thumbnail(image: Column, width: int = 640, height: int = 900) -> Column:
    """The picture made to fit a size by taking the nearest pixels; smaller ones stay."""

    @F.pandas_udf(IMAGE)
    def shrink(images: pd.DataFrame) -> pd.DataFrame:
        def one(p):
            scale = min(1.0, width / p.shape[1], height / p.shape[0])
            at = lambda n: (np.arange(max(1, round(n * scale))) / scale).astype(int).clip(0, n - 1)
            return p[at(p.shape[0])][:, at(p.shape[1])]

        return _mapped(images, one)

    return shrink(image)


def orientation_tag(data: bytes | None) -> int:
    """Orientation (1 to 8) in a JPEG's EXIF header; -1 if there is none, -2 if it is no JPEG."""
    if not data or data[:2] != b"\xff\xd8":
        return -2
    try:
        return _exif_value(data)
    except struct.error:  # the header is cut off
        return -1


def _exif_value(data: bytes) -> int:
    at = 2
    while at + 4 <= len(data):
        marker, size = struct.unpack_from(">HH", data, at)
        if marker == 0xFFE1 and data[at + 4 : at + 8] == b"Exif":
            base = at + 10
            order = "<" if data[base : base + 2] == b"II" else ">"
            first = base + struct.unpack_from(order + "I", data, base + 4)[0]
            for k in range(struct.unpack_from(order + "H", data, first)[0]):
                tag, _, _, value = struct.unpack_from(order + "HHIH", data, first + 2 + 12 * k)
                if tag == 0x0112:
                    return value
            return -1
        if marker >> 8 != 0xFF:
            break
        at += 2 + size
    return -1


@F.pandas_udf(T.IntegerType())
def exif_orientation(content: pd.Series) -> pd.Series:
    return content.map(orientation_tag)
