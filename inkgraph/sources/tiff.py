"""Pages of TIFF files: strips or tiles, plain, PackBits, LZW or Deflate, of 1 to 16 bits a sample. Fax and JPEG compression are not read."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Tags that are read, and bytes of the field types that they come in. Fixed values of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, SHADES, OFFSETS, CHANNELS, ROWS, SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANES, PREDICTOR, PALETTE, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, EXTRA = 284, 317, 320, 322, 323, 324, 325, 338
TYPES = {1: "B", 3: "H", 4: "I"}


def directories(data: bytes) -> list[dict[int, list[int]]]:
    """The whole-number tags of each page; a chain of pages that comes back to one it had ends there."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    magic, at = struct.unpack(order + "HI", data[2:8])
    if magic != 42:
        raise ValueError("no TIFF header")
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in TYPES:
                form, place = f"{order}{count}{TYPES[kind]}", at + 10 + 12 * k
                if struct.calcsize(form) > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                tags[tag] = list(struct.unpack_from(form, data, place))
        out.append(tags)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return out


def unpacked(data: bytes) -> bytes:
    """PackBits: a sign byte says how many bytes follow as they are, or how often the next one stands."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    """LZW of codes from the highest bit on; codes grow by a bit one entry before a table of that size is full."""
    first: list[bytes] = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, last = list(first), [], b""
    held, have, size = 0, 0, 9
    for byte in data:
        held, have = (held << 8) | byte, have + 8
        if have < size:
            continue
        have -= size
        code, held = held >> have, held & ((1 << have) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, size = list(first), b"", 9
            continue
        if last:
            table.append(last + (table[code] if code < len(table) else last)[:1])
        last = table[code]
        out.append(last)
        size = min(12, (len(table) + 1).bit_length())
    return b"".join(out)


def block(data: bytes, compression: int) -> bytes:
    if compression == 1:
        return data
    if compression == 5:
        return unlzw(data)
    if compression in (8, 32946):
        return zlib.decompress(data)
    if compression == 32773:
        return unpacked(data)
    raise ValueError(f"TIFF compression {compression} is not read")


def decode_tiff(data: bytes) -> list[np.ndarray]:
    """All pages of a file, gray or in colour, of 8 bits; what is transparent is laid on white."""
    return [page(data, t) for t in directories(data)]


def page(data: bytes, tags: dict[int, list[int]]) -> np.ndarray:
    from .images import on_white, samples

    one = lambda tag, default=None: tags.get(tag, [default])[0]
    width, height, n, depth, shades = one(WIDTH), one(HEIGHT), one(CHANNELS, 1), one(BITS, 1), one(SHADES, 1)
    if one(PLANES, 1) != 1 and n > 1 or depth not in (1, 2, 4, 8, 16) or shades not in (0, 1, 2, 3):
        raise ValueError("this kind of TIFF is not read")
    tiled = TILE_OFFSETS in tags
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS, height), height))
    line = (w * n * depth + 7) // 8
    across = -(-width // w)
    out = np.zeros((-(-height // h) * h, across * w, n), np.uint8)
    for k, (at, size) in enumerate(zip(tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_SIZES if tiled else SIZES], strict=True)):
        raw = np.frombuffer(block(data[at : at + size], one(COMPRESSION, 1)), np.uint8)
        rows = min(h, len(raw) // line)  # the last strip may be short
        raw = raw[: rows * line].reshape(rows, line)
        if depth == 16:
            raw = raw.reshape(rows, -1, 2)
            wide = raw.astype(np.uint16) @ np.array([1, 256] if data[:2] == b"II" else [256, 1], np.uint16)
            if one(PREDICTOR, 1) == 2:
                wide = np.cumsum(wide.reshape(rows, w, n), axis=1, dtype=np.uint16).reshape(rows, -1)
            got = samples(wide.astype(">u2").view(np.uint8).reshape(rows, line), w * n, 16)
        else:
            got = samples(raw, w * n, depth)
            if one(PREDICTOR, 1) == 2:
                got = np.cumsum(got.reshape(rows, w, n), axis=1, dtype=np.uint8).reshape(rows, -1)
        y, x = k // across * h, k % across * w
        out[y : y + rows, x : x + w] = got.reshape(rows, w, n)
    out = out[:height, :width]
    if shades == 3:
        return (np.array(tags[PALETTE]).reshape(3, -1).T // 257).astype(np.uint8)[out[..., 0]]
    if depth < 8:
        out = (out * (255 // ((1 << depth) - 1))).astype(np.uint8)
    colours = 3 if shades == 2 else 1
    shown = 255 - out[..., :1] if shades == 0 else out[..., :colours]
    if one(EXTRA) in (1, 2) and n > colours:
        shown = on_white(shown, out[..., colours])
    return shown[..., 0] if shown.shape[2] == 1 else shown
