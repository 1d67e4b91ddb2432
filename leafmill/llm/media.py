"""Operator 5: media columns of Netpbm and BMP images.

An image is a binary cell.  ``decode`` reads PGM (P5), PPM (P6) and uncompressed 8- or 24-bit BMP
into numpy arrays, ``area_resize`` averages exact areas with an integral image, and ``tiles`` cuts
images into strips, resizes each to a square, and stores it as an NPY file's bytes with its
difference hash.  Everything is a map over rows: no shuffle, a batch of rows in memory at a time.

``payload_images`` stores a text's bytes as the samples of an image, which ``query`` reads back.
Defined cases: a null or empty text is 576 padding bytes; a text of any length is one image of as many rows as it
takes; equal texts give equal images; repeated rows and rows with a null id are each kept; an image that cannot be
decoded has null tiles and hash; areas that are equally dark count as not darker; an empty table gives no rows;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table, text_or_empty

UNIT, PAD = 576, b"\xff"
#: 576 bytes are 24 x 24 grey samples or 16 x 12 colour ones; a row of either is a multiple of 4 bytes.
GREY_WIDTH, COLOUR_WIDTH = 24, 16
FORMATS = ("pgm", "ppm", "bmp8", "bmp24")
STRIP_ROWS, TILE = 1536, 16


def encode(samples: np.ndarray, kind: str) -> bytes:
    """An image file of (height, width) or (height, width, 3) samples."""
    h, w = samples.shape[:2]
    if kind == "pgm":
        return b"P5\n%d %d\n255\n" % (w, h) + samples.tobytes()
    if kind == "ppm":
        return b"P6\n%d %d\n255\n" % (w, h) + samples.tobytes()
    row = samples.shape[1] * (3 if samples.ndim == 3 else 1)
    body = np.zeros((h, (row + 3) // 4 * 4), np.uint8)  # rows from below, padded to 4 bytes, blue first
    body[:, :row] = (samples[::-1, :, ::-1] if samples.ndim == 3 else samples[::-1]).reshape(h, row)
    palette = b"" if samples.ndim == 3 else np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).tobytes()
    start = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24 if samples.ndim == 3 else 8, 0, body.size, 2835, 2835, 0 if samples.ndim == 3 else 256, 0)
    return head + info + palette + body.tobytes()


def _netpbm(raw: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:  # numbers apart by blanks, and comments to the end of a line
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        fields.append(int(raw[at:end]))
        at = end
    w, h, most = fields
    if not 0 < most < 256:
        raise ValueError("only 8-bit samples")
    shape = (h, w, 3) if raw[:2] == b"P6" else (h, w)
    return np.frombuffer(raw, np.uint8, int(np.prod(shape)), at + 1).reshape(shape)


def _bmp(raw: bytes) -> np.ndarray:
    start, size, w, h, _, bits, packed = struct.unpack_from("<10xIIiiHHI", raw)
    if packed or bits not in (8, 24):
        raise ValueError("only plain 8- and 24-bit BMP")
    row = w * bits // 8
    body = np.frombuffer(raw, np.uint8, (row + 3) // 4 * 4 * abs(h), start).reshape(abs(h), -1)[:, :row]
    body = body[::-1] if h > 0 else body
    if bits == 24:
        return body.reshape(abs(h), w, 3)[:, :, ::-1]
    palette = np.frombuffer(raw, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)
    if len(palette) == 256 and (palette[:, 0] == np.arange(256)).all() and (palette[:, :3] == palette[:, :1]).all():
        return body  # grey samples stand for themselves
    return palette[body][:, :, 2::-1]


def decode(raw: bytes) -> np.ndarray:
    """Samples of a PGM, PPM or BMP file: (height, width), or with 3 colours."""
    if raw[:2] in (b"P5", b"P6"):
        return _netpbm(raw)
    if raw[:2] == b"BM":
        return _bmp(raw)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, edges weighted by their share: differences of the integral image."""
    for axis, n in ((0, height), (1, width)):
        whole = np.zeros(grey.shape[:axis] + (grey.shape[axis] + 1,) + grey.shape[axis + 1 :])
        np.cumsum(grey, axis=axis, dtype=np.float64, out=whole[1:] if axis == 0 else whole[:, 1:])
        edges = np.arange(n + 1) * (grey.shape[axis] / n)
        low = np.minimum(edges.astype(np.int64), grey.shape[axis] - 1)
        share = (edges - low).reshape((-1, 1) if axis == 0 else (1, -1))
        at = np.take(whole, low, axis) * (1 - share) + np.take(whole, low + 1, axis) * share
        grey = np.diff(at, axis=axis) / (whole.shape[axis] - 1) * n
    return grey


def grey_of(samples: np.ndarray) -> np.ndarray:
    """Integer luma, the same on every machine."""
    if samples.ndim == 2:
        return samples
    s = samples.astype(np.uint32)
    return ((s[:, :, 0] * 299 + s[:, :, 1] * 587 + s[:, :, 2] * 114) // 1000).astype(np.uint8)


def difference_hash(grey: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 areas is darker than its right neighbour."""
    small = np.rint(area_resize(grey, 8, 9) * 256).astype(np.int64)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def npy(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(samples), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def strips(raw: bytes, rows: int = STRIP_ROWS, side: int = TILE) -> list[tuple[bytes, int]]:
    """(NPY bytes, difference hash) of each strip of an image."""
    grey = grey_of(decode(raw))
    out = []
    for top in range(0, grey.shape[0], rows):
        part = grey[top : top + rows]
        out.append((npy(np.rint(area_resize(part, side, side)).astype(np.uint8)), difference_hash(part)))
    return out


def tiles(images: DataFrame, rows: int = STRIP_ROWS, side: int = TILE) -> DataFrame:
    """id, tile, npy, dhash for each strip of the images (id, media)."""
    kind = dict(images.dtypes)["id"].replace("bigint", "long")

    def one(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"id": [], "tile": [], "npy": [], "dhash": []}
        for key, raw in zip(batch.column("id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            try:
                cut = strips(raw or b"", rows, side)
            except (ValueError, struct.error, IndexError):
                cut = [(None, None)]
            for i, (data, mark) in enumerate(cut):
                for name, v in zip(out, (key, i, data, None if mark is None else f"{mark:016x}"), strict=True):
                    out[name].append(v)
        return out

    return map_arrow(images.select("id", "media"), one, f"id {kind}, tile int, npy binary, dhash string")


def image_of(payload: bytes) -> bytes:
    """The payload as an image's samples; the format follows from the payload."""
    kind = FORMATS[zlib.crc32(payload) % len(FORMATS)]
    flat = np.frombuffer(payload, np.uint8)
    return encode(flat.reshape(-1, COLOUR_WIDTH, 3) if kind in ("ppm", "bmp24") else flat.reshape(-1, GREY_WIDTH), kind)


def padded(raw: bytes) -> bytes:
    return raw + PAD * (-len(raw) % UNIT if raw else UNIT)


def payload_images(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as an image."""
    kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")

    def one(batch: pa.RecordBatch) -> dict:
        raws = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(r) for r in raws], "media": [image_of(padded(r)) for r in raws]}

    return map_arrow(docs.select("doc_id", text_or_empty().alias("text")), one, f"doc_id {kind}, n_bytes long, media binary")


def digest(images: DataFrame) -> DataFrame:
    """What is read back from the stored images, and their features."""
    kind = dict(images.dtypes)["doc_id"].replace("bigint", "long")

    def one(batch: pa.RecordBatch) -> dict:
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        rows = []
        for raw in batch.column("media").to_pylist():
            back = np.ascontiguousarray(decode(raw)).tobytes()
            cut = strips(raw)
            mark = hashlib.sha256(b"".join(data for data, _ in cut)).hexdigest()[:16]
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), ":".join([mark, *(f"{m:016x}" for _, m in cut)])))
        return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")} | {n: list(v) for n, v in zip(names, zip(*rows, strict=True), strict=True)}

    return map_arrow(images, one, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(payload_images(table(spark, sf_dir, "documents")))
