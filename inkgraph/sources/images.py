"""Pages from image files. PNG, PNM and TIFF are decoded here; Spark's own `image` source serves other formats it knows."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster
from .tiff import decode_tiff

PAGES = "doc_id long, path string, page_no int, width int, height int, gray binary, adaptive boolean, inverted boolean, error string"


def sniff(data: bytes) -> str | None:
    """The type of a file by its first bytes; null if it is none that is known."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if data[:1] == b"P" and data[1:2] in b"123456" and data[1:2] and data[2:3].isspace():
        return "pnm"
    return {b"\xff\xd8": "jpeg", b"II": "tiff", b"MM": "tiff", b"GI": "gif", b"BM": "bmp", b"%P": "pdf", b"%!": "ps"}.get(data[:2])


#: Passes of an interlaced PNG: first column, first row, step of columns, step of rows. Fixed values of the format.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Samples a pixel of each PNG colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def unfiltered(kinds: np.ndarray, rows: np.ndarray, unit: int) -> np.ndarray:
    """Bytes of filtered rows (height, width in bytes); `unit` bytes are a pixel.

    A byte hangs on those left of it and above it, so where a row's guess needs both, whole diagonals are taken at a time.
    """
    height, width = rows.shape
    out = rows.copy()
    if not np.isin(kinds, (3, 4)).any():
        for y in range(height):
            if kinds[y] == 1:
                out[y] = np.cumsum(rows[y].reshape(-1, unit), axis=0, dtype=np.uint8).ravel()
            elif kinds[y] == 2 and y:
                out[y] += out[y - 1]
        return out
    if width == unit:  # a second column, so that a diagonal has a stride
        return unfiltered(kinds, np.pad(rows, ((0, 0), (0, unit))), unit)[:, :unit]
    m = width // unit
    flat = out.reshape(height * m, unit)
    last, older, new = (np.zeros((height + 1, unit), np.int16) for _ in range(3))  # row y is at y + 1; what is outside the image stays 0
    for t in range(height + m - 1):
        lo, hi = max(0, t - m + 1), min(height - 1, t)
        at = slice(lo * m + t - lo, hi * m + t - hi + 1, m - 1)
        left, up, corner = last[lo + 1 : hi + 2], last[lo : hi + 1], older[lo : hi + 1]
        from_left, from_up, from_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((from_left <= from_up) & (from_left <= from_corner), left, np.where(from_up <= from_corner, up, corner))
        guess = np.choose(kinds[lo : hi + 1, None], (np.zeros_like(left), left, up, (left + up) >> 1, nearest))
        flat[at] += guess.astype(np.uint8)
        new[lo + 1 : hi + 2] = flat[at]
        last, older, new = new, last, older
    return out


def samples(packed: np.ndarray, n: int, depth: int) -> np.ndarray:
    """The first n samples of `depth` bits of each row of bytes; those of 16 bits are rounded to 8."""
    if depth == 8:
        return packed[:, :n]
    if depth == 16:
        wide = packed[:, : 2 * n].reshape(len(packed), n, 2).astype(np.uint32)
        return ((wide[..., 0] * 256 + wide[..., 1] + 128) // 257).astype(np.uint8)
    bits = np.unpackbits(packed, axis=1)[:, : n * depth].reshape(len(packed), n, depth)
    return (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)


def on_white(shade: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    a = alpha[..., None] / 255.0
    return np.round(shade * a + 255 * (1 - a)).astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """PNGs of all colour types and depths, interlaced or not; what is transparent is laid on white."""
    at, parts, palette, clear = 8, [], None, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    n, raw, at = CHANNELS[colour], np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8), 0
    out = np.zeros((height, width, n), np.uint8)
    for x, y, dx, dy in PASSES if interlace else ((0, 0, 1, 1),):
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w <= 0 or h <= 0:
            continue
        line = (w * n * depth + 7) // 8
        rows = raw[at : at + h * (line + 1)].reshape(h, line + 1)
        at += h * (line + 1)
        out[y::dy, x::dx] = samples(unfiltered(rows[:, 0], rows[:, 1:], max(1, n * depth // 8)), w * n, depth).reshape(h, w, n)
    if colour == 3:
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        return on_white(palette[out[..., 0]], alpha[out[..., 0]]) if clear else palette[out[..., 0]]
    hidden = None
    if clear:  # one shade or colour is transparent
        key = np.frombuffer(clear, ">u2")
        hidden = (out == (key if depth < 16 else (key.astype(np.uint32) + 128) // 257)).all(axis=2)
    if depth < 8:
        out = (out * (255 // ((1 << depth) - 1))).astype(np.uint8)
    if colour in (4, 6):
        out = on_white(out[..., :-1], out[..., -1])
    if hidden is not None:
        out = np.where(hidden[..., None], np.uint8(255), out)
    return out[..., 0] if out.shape[2] == 1 else out


def decode_pnm(data: bytes) -> list[np.ndarray]:
    """All images of a PBM, PGM or PPM file, plain or binary, of up to 16 bits; binary files may hold several, one after another."""
    out, at = [], 0
    while at < len(data):
        kind, fields = data[at : at + 2], []
        at += 2
        while len(fields) < (2 if kind in (b"P1", b"P4") else 3):
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            if end == at:
                raise ValueError("no PNM header")
            fields.append(int(data[at:end]))
            at = end
        w, h, top = (*fields, 1)[:3]
        n = 3 if kind in (b"P3", b"P6") else 1
        if kind in (b"P1", b"P2", b"P3"):
            text = re.sub(rb"#[^\n]*", b" ", data[at:])
            digits = re.findall(rb"[01]" if kind == b"P1" else rb"[0-9]+", text)[: w * h * n]
            a, at = np.array(digits, np.int64), len(data)
        elif kind == b"P4":
            line = (w + 7) // 8
            a = samples(np.frombuffer(data, np.uint8, line * h, at + 1).reshape(h, line), w, 1).astype(np.int64)
            at += 1 + line * h
        else:
            a = np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * n, at + 1).astype(np.int64)
            at += 1 + w * h * n * (1 if top < 256 else 2)
        a = 1 - a if kind in (b"P1", b"P4") else a  # one is ink there
        a = ((a * 510 + top) // (2 * top)).astype(np.uint8).reshape(h, w, n)
        out.append(a[..., 0] if n == 1 else a)
        while data[at : at + 1].isspace():
            at += 1
    return out


def encode_png(gray: np.ndarray) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w = gray.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), gray.astype(np.uint8)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode(data: bytes) -> list[np.ndarray]:
    kind = sniff(data)
    if kind == "png":
        return [decode_png(data)]
    if kind == "pnm":
        return decode_pnm(data)
    if kind == "tiff":
        return decode_tiff(data)
    raise ValueError(f"image type {kind or 'unknown'} is not decoded")


def pages_of(files: DataFrame, invert: bool = False, adaptive: bool = False) -> DataFrame:
    """PAGES of files (path, content): a row a page. A file that cannot be read has one row with its error and no pixels.

    doc_id is a hash of the path, so it does not depend on the order of files.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for f in pdf.itertuples():
                try:
                    for k, image in enumerate(decode(bytes(f.content))):
                        gray, a, i = raster.to_gray(image, invert, adaptive)
                        rows.append((f.doc_id, f.path, k, gray.shape[1], gray.shape[0], gray.tobytes(), a, i, None))
                except Exception as e:  # one bad file does not end the job; its row says why
                    rows.append((f.doc_id, f.path, 0, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["doc_id", "path", "page_no", "width", "height", "gray", "adaptive", "inverted", "error"])
            for c in ("width", "height"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content").mapInPandas(run, PAGES)


def read_pages(spark: SparkSession, path: str, glob: str = "*", invert: bool = False, adaptive: bool = False) -> DataFrame:
    """PAGES of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return pages_of(files.select("path", "content"), invert, adaptive)


def pages_of_cells(cells: DataFrame, width: int, height: int) -> DataFrame:
    """doc_id, page_no, width, height, gray, adaptive: pages drawn from cells of ink (doc_id, page_no, x, y), black on white; repeated cells and those outside change nothing.

    A page is a row, so its pixels come together in one task: it is bounded by its size, as cells are made distinct first.
    """

    def run(batches):
        for pdf in batches:
            gray = []
            for at in pdf["at"]:
                a = np.full(width * height, 255, np.uint8)
                a[np.asarray(at, np.int64)] = 0
                gray.append(a.tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "page_no": pdf["page_no"], "width": width, "height": height, "gray": gray, "adaptive": False})

    inside = cells.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    at = inside.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), (F.col("y") * width + F.col("x")).cast("long").alias("at"))
    pages = at.groupBy("doc_id", "page_no").agg(F.collect_set("at").alias("at"))
    return pages.mapInPandas(run, "doc_id long, page_no int, width int, height int, gray binary, adaptive boolean")


def page_count(pages: DataFrame) -> DataFrame:
    return pages.where("error IS NULL").groupBy("doc_id").agg(F.count("*").alias("pages"))
