import struct
import zlib

import numpy as np
import pytest

from inkgraph.sources import images, tiff


def packbits(data):
    out, at = b"", 0
    while at < len(data):
        run = 1
        while at + run < len(data) and run < 128 and data[at + run] == data[at]:
            run += 1
        out += bytes([257 - run, data[at]]) if run > 1 else bytes([0, data[at]])
        at += run
    return out + bytes([128])


def lzw(data):
    """Codes as a writer makes them: clear first, clear again before the table is full."""
    bits, table, word = "", {}, b""

    def put(code, entries):
        nonlocal bits
        bits += format(code, f"0{min(12, (258 + entries + 1).bit_length())}b")

    def known(w):
        return w[0] if len(w) == 1 else table[w]

    bits += format(256, "09b")
    sent = 0  # entries that the reader has when it reads the next code
    for k in range(len(data)):
        nxt = word + data[k : k + 1]
        if len(nxt) == 1 or nxt in table:
            word = nxt
            continue
        put(known(word), max(0, sent - 1))
        sent += 1
        table[nxt] = 258 + len(table)
        word = data[k : k + 1]
        if len(table) == 3800:
            put(known(word), max(0, sent - 1))
            put(256, sent)
            table, word, sent = {}, b"", 0
    if word:
        put(known(word), max(0, sent - 1))
        sent += 1
    put(257, max(0, sent - 1))
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


PACK = {1: lambda d: d, 8: zlib.compress, 32773: packbits, 5: lzw}


def file_of(pages, order="<"):
    """A TIFF of pages (tags, blocks, whether tiles)."""
    data = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)
    link = 4
    for tags, blocks, tiles in pages:
        at = []
        for b in blocks:
            at.append(len(data))
            data += b
        tags = tags | {324 if tiles else 273: at, 325 if tiles else 279: [len(b) for b in blocks]}
        fields = b""
        for tag, v in sorted(tags.items()):
            body = struct.pack(f"{order}{len(v)}I", *v)
            if len(body) > 4:
                place, data = len(data), data + body
                body = struct.pack(order + "I", place)
            fields += struct.pack(order + "HHI", tag, 4, len(v)) + body
        data = data[:link] + struct.pack(order + "I", len(data)) + data[link + 4 :]
        data += struct.pack(order + "H", len(tags)) + fields
        link, data = len(data), data + bytes(4)
    return data


def packed(a, depth, order):
    """Rows of samples (height, width * channels) as bytes."""
    if depth == 16:
        return a.astype(order + "u2").tobytes()
    if depth == 8:
        return a.astype(np.uint8).tobytes()
    rows = ["".join(format(v, f"0{depth}b") for v in r) for r in a.tolist()]
    return b"".join(bytes(int((r + "0" * (-len(r) % 8))[i : i + 8], 2) for i in range(0, len(r), 8)) for r in rows)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [1, 8, 32773, 5])
def test_strips_of_all_depths(order, compression):
    rng = np.random.default_rng(3)
    pages, want = [], []
    for depth, n, shades in ((1, 1, 0), (1, 1, 1), (4, 1, 1), (8, 1, 0), (8, 3, 2), (16, 1, 1), (16, 3, 2)):
        a = rng.integers(0, 1 << depth, (61, 53, n)) // 3 * 3 % (1 << depth)
        rows = [a[y : y + 20].reshape(-1, 53 * n) for y in range(0, 61, 20)]
        tags = {256: [53], 257: [61], 258: [depth] * n, 259: [compression], 262: [shades], 277: [n], 278: [20]}
        pages.append((tags, [PACK[compression](packed(r, depth, order)) for r in rows], False))
        shade = np.round(a * (255 / ((1 << depth) - 1)))
        want.append(255 - shade if shades == 0 else shade)
    got = images.decode(file_of(pages, order))
    assert [(g.reshape(w.shape) == w).all() for g, w in zip(got, want, strict=True)] == [True] * len(want)


def test_long_lzw():
    data = np.random.default_rng(5).integers(0, 9, 60_000).astype(np.uint8).tobytes()
    assert tiff.unlzw(lzw(data)) == data and tiff.unlzw(lzw(b"a" * 5_000)) == b"a" * 5_000 and tiff.unlzw(lzw(b"")) == b""


def test_tiles_palette_differences_and_alpha():
    a = np.arange(35).reshape(5, 7)
    tiles = [np.pad(a, ((0, 3), (0, 1)))[y : y + 4, x : x + 4] for y in (0, 4) for x in (0, 4)]
    base = {256: [7], 257: [5], 258: [8], 259: [1], 262: [1]}
    tiled = (base | {322: [4], 323: [4]}, [t.astype(np.uint8).tobytes() for t in tiles], True)
    steps = np.diff(a, axis=1, prepend=0).astype(np.uint8).tobytes()
    stepped = (base | {278: [5], 317: [2]}, [steps], False)
    assert all((g == a).all() for g in images.decode(file_of([tiled, stepped])))
    named = (base | {256: [2], 257: [1], 258: [1], 262: [3], 320: [257 * v for v in (1, 2, 3, 4, 5, 6)]}, [bytes([0b01000000])], False)
    clear = (base | {256: [2], 257: [1], 258: [8] * 4, 262: [2], 277: [4], 338: [2]}, [bytes([9, 9, 9, 0, 7, 8, 9, 255])], False)
    got = images.decode(file_of([named, clear]))
    assert got[0].tolist() == [[[1, 3, 5], [2, 4, 6]]] and got[1].tolist() == [[[255] * 3, [7, 8, 9]]]


def test_what_is_not_read_is_an_error(spark, tmp_path):
    fax = file_of([({256: [8], 257: [1], 258: [1], 259: [4], 262: [0]}, [b"x"], False)])
    two = file_of([({256: [2], 257: [1], 258: [8], 259: [1], 262: [1]}, [bytes([0, 255])], False)] * 2)
    (tmp_path / "a.tif").write_bytes(fax)
    (tmp_path / "b.tif").write_bytes(two)
    (tmp_path / "c.tif").write_bytes(b"MM")
    got = images.read_pages(spark, str(tmp_path)).collect()
    assert sorted((r.path[-5:], r.page_no, r.error is None) for r in got) == [("a.tif", 0, False), ("b.tif", 0, True), ("b.tif", 1, True), ("c.tif", 0, False)]
    assert images.page_count(images.read_pages(spark, str(tmp_path), "b*")).first().pages == 2
