import math

import numpy as np
import pytest

from inkgraph.operators import chem, cleanup, glyphs, molecule, raster, reaction, segment
from inkgraph.operators.molecule import Graph
from inkgraph.sources import images


def line(a, x1, y1, x2, y2, width=1):
    n = int(max(abs(x2 - x1), abs(y2 - y1))) * 2 + 1
    for t in np.linspace(0, 1, n):
        x, y = round(x1 + (x2 - x1) * t), round(y1 + (y2 - y1) * t)
        a[y - width // 2 : y + width // 2 + 1, x - width // 2 : x + width // 2 + 1] = 0


def hexagon(size=200, r=60, width=3):
    a = np.full((size, size), 255, np.uint8)
    pts = [(size / 2 + r * math.cos(math.pi / 3 * k + 0.2), size / 2 + r * math.sin(math.pi / 3 * k + 0.2)) for k in range(6)]
    for p, q in zip(pts, pts[1:] + pts[:1], strict=True):
        line(a, *p, *q, width)
    return a


def square(bonds, n=4):
    return Graph([{"x": 10.0 * (k in (1, 2)), "y": 10.0 * (k in (2, 3))} for k in range(n)], [{"a": a, "b": b} for a, b in bonds])


def test_zero_bonds_and_disconnected_atoms():
    g = square([(0, 1), (1, 0), (2, 2), (2, 3)])
    molecule.drop_zero_bonds(g)
    assert [(b["a"], b["b"]) for b in g.live()] == [(0, 1), (2, 3)]
    g.bonds[3]["live"] = False
    molecule.drop_disconnected(g)
    assert [a["live"] for a in g.atoms] == [True, True, False, False]


def test_collapse_keeps_label_and_rewires():
    g = Graph([{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0, "label": "N"}, {"x": 9.0, "y": 0.0}], [{"a": 1, "b": 2}, {"a": 0, "b": 1}])
    molecule.collapse_atoms(g, 2.0)
    assert g.atoms[0]["x"] == 0.5 and g.atoms[0]["label"] == "N"
    assert [(b["a"], b["b"]) for b in g.live()] == [(0, 2)]


@pytest.mark.parametrize("label,left", [(" ", 1), ("O", 2)])
def test_flatten_spares_labels(label, left):
    g = Graph([{"x": 0.0, "y": 0.0}, {"x": 6.0, "y": 0.5, "label": label}, {"x": 10.0, "y": 0.0}], [{"a": 0, "b": 1, "type": 2}, {"a": 1, "b": 2, "hash": True}])
    molecule.flatten(g, 2.0)
    assert len(g.live()) == left
    if left == 1:
        assert g.live()[0]["type"] == 2 and g.live()[0]["hash"]


@pytest.mark.parametrize("n", [2, 3])
def test_parallel_bonds_add_up(n):
    atoms = [{"x": float(x), "y": 3.0 * k} for k in range(n) for x in (0, 40)]
    g = Graph(atoms, [{"a": 2 * k, "b": 2 * k + 1} for k in range(n)])
    gap = molecule.double_bond_gap(g, 40.0)
    assert 5 <= gap < 9
    molecule.merge_parallel(g, gap)
    assert [b["type"] for b in g.live()] == [n]
    far = Graph([{"x": 0.0, "y": 0.0}, {"x": 40.0, "y": 0.0}, {"x": 0.0, "y": 30.0}, {"x": 40.0, "y": 30.0}], [{"a": 0, "b": 1}, {"a": 2, "b": 3}])
    molecule.merge_parallel(far, molecule.double_bond_gap(far, 40.0))
    assert len(far.live()) == 2


def test_joint_terminal_and_crossing():
    g = Graph([{"x": 0.0, "y": 0.0}, {"x": 20.0, "y": 0.0}, {"x": 10.0, "y": 0.5}, {"x": 10.0, "y": 20.0}], [{"a": 0, "b": 1}, {"a": 2, "b": 3}])
    molecule.split_at_joints(g, 2.0)
    assert sorted((b["a"], b["b"]) for b in g.live()) == [(0, 2), (2, 1), (2, 3)]
    g = Graph([{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 12.0, "y": 0.0}, {"x": 20.0, "y": 0.0}], [{"a": 0, "b": 1}, {"a": 2, "b": 3}])
    molecule.extend_terminals(g, 4.0)
    assert len(molecule.fragments(g)) == 1
    ring = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (4, 2), (1, 4), (4, 3)]
    g = Graph([{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 10.0}, {"x": 0.0, "y": 10.0}, {"x": 5.0, "y": 5.0}], [{"a": a, "b": b} for a, b in ring])
    done = molecule.uncross(g, 2.0)
    assert done in (0, 1) and len(g.live()) == (6 if done else 8)


def test_stereo_marks():
    g = Graph([{"x": 0.0, "y": 0.0}, {"x": 20.0, "y": 0.0}], [{"a": 0, "b": 1}])
    molecule.wedges(g, lambda x, y: 8 - x / 4, 3.0)
    assert g.bonds[0]["wedge"] and g.bonds[0]["a"] == 1
    g = Graph([], [])
    molecule.dashes_to_bonds(g, [{"x": 4.0 * k, "y": 0.0, "area": 9 - k} for k in range(4)] + [{"x": 90.0, "y": 90.0, "area": 1}], 6.0)
    assert len(g.bonds) == 1 and g.bonds[0]["hash"] and g.atoms[0]["x"] > g.atoms[1]["x"]
    zig = [{"x": 5.0 * k, "y": 3.0 * (k % 2)} for k in range(6)]
    g = Graph(zig, [{"a": k, "b": k + 1} for k in range(5)])
    molecule.wavy_bonds(g, 25.0)
    assert len(g.live()) == 1 and g.live()[0]["hash"] and g.live()[0]["wedge"]
    ring = Graph([{"x": 20 * math.cos(k), "y": 20 * math.sin(k)} for k in np.arange(6) * math.pi / 3], [{"a": k, "b": (k + 1) % 6} for k in range(6)])
    molecule.aromatic_circles(ring, [{"x": 0.0, "y": 0.0, "diameter": 20.0}], 20.0)
    assert all(b["arom"] for b in ring.bonds)


def test_labels_attach_ahead_only():
    g = Graph([{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}], [{"a": 0, "b": 1}])
    molecule.attach_labels(g, [{"x": 14.0, "y": 0.5, "text": "OH"}, {"x": 2.0, "y": 5.0, "text": "N"}], 6.0)
    assert [a["label"] for a in g.atoms] == [" ", "OH"]


def test_clean_graphs_by_box(spark):
    atoms = spark.createDataFrame([(k, i, 10.0 * x, 0.0, " ", 0) for k in (1, 2) for i, x in enumerate((0, 1, 2))], "k int, atom_idx int, x double, y double, label string, charge int")
    bonds = spark.createDataFrame([(k, i, i, i + 1, 1, False, False, False) for k in (1, 2) for i in (0, 1)], "k int, bond_idx int, a int, b int, type int, hash boolean, wedge boolean, arom boolean")
    got = molecule.clean_graphs(atoms, bonds, ["k"]).groupBy("k", "kind").count().collect()
    assert {(r.k, r.kind, r["count"]) for r in got} == {(k, *x) for k in (1, 2) for x in (("a", 2), ("b", 1))}


def test_smiles_do_not_depend_on_order():
    rng = np.random.default_rng(5)
    for text in ("C1=CC=CC=C1O", "CC(=O)NC", "OC(=O)C1CCN(C)C1", "[O-]C(=O)C[NH3+]", "C1CC2CCC1C2", "CCO.Cl"):
        atoms, bonds = chem.parse_smiles(text)
        want = chem.smiles(atoms, bonds)
        for _ in range(5):
            p = rng.permutation(len(atoms))
            back = np.argsort(p)
            mixed = [{"a": int(back[b["b"]]), "b": int(back[b["a"]]), "type": b["type"]} for b in bonds]
            assert chem.smiles([atoms[i] for i in p], [mixed[i] for i in rng.permutation(len(mixed))]) == want
        again = chem.parse_smiles(want)
        assert chem.smiles(*again) == want and len(again[1]) == len(bonds)
        assert chem.identity(atoms, bonds) == chem.identity(*again)


def test_rings_and_statistics():
    assert chem.statistics(*chem.parse_smiles("C1=CC=CC=C1CC1CCCC1"))  | {"rotors": 2} == {"rings": 2, "aromatic_rings": 1, "fragments": 1, "rings5": 1, "rings6": 1, "rotors": 2, "atoms": 12, "bonds": 13}
    assert sorted(map(len, chem.rings(*(lambda a, b: (len(a), b))(*chem.parse_smiles("C1CC2CCC1C2"))))) == [5, 5]


def test_molfile_round_trip(spark, tmp_path):
    atoms = [{"x": 1.0, "y": 2.0, "symbol": "C", "charge": 0}, {"x": 2.0, "y": 2.0, "symbol": "Cl", "charge": -1}]
    bonds = [{"a": 0, "b": 1, "type": 1, "wedge": True}]
    mol = chem.molfile(atoms, bonds)
    a, b = chem.parse_molfile(mol)
    assert a == atoms and b == bonds
    (tmp_path / "x.sdf").write_text(chem.sd_record(mol, {"Page": "1", "Resolution": "300"}) * 2)
    got = chem.read_sd(spark, str(tmp_path / "x.sdf")).orderBy("record_ord").collect()
    assert len(got) == 2 and got[0].mol == mol and got[1].props == {"Page": "1", "Resolution": "300"}
    chem.write_sd(spark.createDataFrame(got), str(tmp_path / "out"))
    back = chem.read_sd(spark, str(tmp_path / "out" / "*.txt")).collect()
    assert sorted(r.mol for r in back) == [mol, mol]


def test_splice():
    atoms, bonds = chem.parse_smiles("CC")
    chem.splice(atoms, bonds, 1, chem.parse_smiles("C(=O)O"))
    assert chem.smiles(atoms, bonds) == chem.smiles(*chem.parse_smiles("CC(=O)O"))


def test_raster_basics():
    a = hexagon()
    assert raster.background(a) == 1.0 and raster.ink(a, 0.4).sum() == (a == 0).sum()
    t = raster.thin(a == 0)
    assert 0 < t.sum() < (a == 0).sum() / 2 and raster.components(t).max() == 1
    assert raster.noise_factor(a == 0)[0] in (3, 4)
    m = np.zeros((5, 7), bool)
    m[0, 0] = m[1, 1] = m[3, 3:6] = True
    assert raster.components(m).max() == 2 and raster.flood_area(m, 4, 3) == (3, 4.0, 3.0) and raster.run_through(m, 4, 3, True) == 3
    assert raster.run_histogram(m)[3] == 1
    gray, adaptive, inverted = raster.to_gray(np.repeat(255 - a[:, :, None], 3, 2))
    assert (gray < 128).sum() == (a == 0).sum() and inverted and not adaptive
    ramp = np.tile(np.linspace(120, 255, 200), (200, 1)).astype(np.uint8)
    ramp[a == 0] -= 100
    binary = raster.adaptive_otsu(ramp, 15)
    assert ((binary == 0) & (a == 0)).sum() > 0.8 * (a == 0).sum()
    assert raster.smooth(a).shape == a.shape and raster.smooth_scale(a, 300, 300).shape == (300, 300)
    assert (raster.box_sums(m, 1)[3, 4], raster.box_sums(m, 1)[0, 0]) == (3, 2)
    assert raster.simplify([(0, 0), (5, 1), (10, 0)], 2) == [(0, 0), (10, 0)]


def test_thinning_keeps_shape_of_random_blobs():
    rng = np.random.default_rng(1)
    for _ in range(10):
        m = raster.box_sums(rng.random((40, 40)) > 0.6, 1) > 4
        m[0] = m[-1] = m[:, 0] = m[:, -1] = False
        assert raster.components(raster.thin(m)).max() == raster.components(m).max()


def test_trace_hexagon():
    atoms, bonds = raster.trace(raster.thin(hexagon() == 0))
    g = molecule.clean(Graph(atoms, bonds), 60.0, 3.0)
    assert (len(g.atoms), len(g.bonds)) == (6, 6)
    assert chem.statistics([{**a, "symbol": "C"} for a in g.atoms], g.bonds)["rings6"] == 1


def test_page_cleanup():
    a = hexagon()
    speck = a.copy()
    speck[5, 5] = 0
    assert cleanup.noise_filter(speck)[5, 5] == 255 and (cleanup.noise_filter(speck) == a).all()
    bar = a.copy()
    bar[:, :30] = 0
    assert (cleanup.black_filter(bar)[:, :25] == 255).all()
    assert (cleanup.clear_border(bar)[:, :25] == 255).all()
    text = np.full((300, 300), 255, np.uint8)
    for y in range(40, 260, 20):
        text[y : y + 4, 40:260] = 0
    turned = cleanup.rotate(text, math.radians(2))
    assert math.degrees(cleanup.skew(turned)) == pytest.approx(2, abs=0.3)
    moved, dx, dy = cleanup.centre(cleanup.shift(a, 20, -10))
    assert abs(dx + 20) <= 1 and abs(dy - 10) <= 1
    gray = a.copy()
    gray[:40, :40] = 180
    assert (cleanup.gray_filter(gray)[:20, :20] == 255).all()
    assert cleanup.unpaper(a)[0].shape == a.shape and cleanup.blur_filter(a).shape == a.shape
    assert cleanup.darkness(a, -5, -5, 3, 3) == 0 and cleanup.mask_of(np.full((9, 9), 255, np.uint8)) == (0, 0, 8, 8)


def test_png_and_pnm():
    a = hexagon(50, 15, 1)
    assert (images.decode_png(images.encode_png(a)) == a).all()
    pnm = b"P5\n# c\n50 50\n255\n" + a.tobytes()
    assert [(x == a).all() for x in images.decode_pnm(pnm + pnm)] == [True, True]
    assert images.sniff(b"%PDF-1") == "pdf" and images.sniff(b"zz") is None


def filtered_png(a, depth, colour, kinds, interlace=False, extra=b""):
    """A PNG of samples (height, width, channels) under the filters given, row by row; byte by byte."""
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def packed(row):
        if depth == 16:
            return list(row.astype(">u2").tobytes())
        if depth == 8:
            return row.tolist()
        bits = "".join(format(v, f"0{depth}b") for v in row.tolist())
        bits += "0" * (-len(bits) % 8)
        return [int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)]

    def rows(part):
        unit, out, above = max(1, part.shape[2] * depth // 8), b"", None
        for y, row in enumerate(part.reshape(len(part), -1)):
            line = packed(row)
            above, kind = above or [0] * len(line), kinds[y % len(kinds)]
            got = []
            for i, v in enumerate(line):
                l, u, c = (line[i - unit] if i >= unit else 0), above[i], (above[i - unit] if i >= unit else 0)
                by_distance = sorted([(abs(u - c), 0, l), (abs(l - c), 1, u), (abs(l + u - 2 * c), 2, c)])[0][2]
                got.append((v - (0, l, u, (l + u) // 2, by_distance)[kind]) % 256)
            out, above = out + bytes([kind, *got]), line
        return out

    h, w, _ = a.shape
    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if interlace else [(0, 0, 1, 1)]
    raw = b"".join(rows(a[y::dy, x::dx]) for x, y, dx, dy in passes if a[y::dy, x::dx].size)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlace", [False, True])
@pytest.mark.parametrize("shape", [(13, 11), (1, 9), (9, 1), (3, 40), (1, 1)])
@pytest.mark.parametrize("kinds", [(0,), (1, 2), (3,), (4,), (0, 1, 2, 3, 4)])
def test_png_of_all_depths_and_filters(shape, kinds, interlace):
    rng = np.random.default_rng(7)
    for depth, colour, n in ((1, 0, 1), (2, 0, 1), (4, 0, 1), (8, 0, 1), (16, 0, 1), (8, 2, 3), (16, 2, 3), (8, 4, 2), (16, 6, 4)):
        a = rng.integers(0, 1 << depth, (*shape, n)).astype(np.uint16)
        want = np.round(a * (255 / ((1 << depth) - 1)))
        if colour in (4, 6):
            alpha = want[..., -1:] / 255
            want = np.round(want[..., :-1] * alpha + 255 * (1 - alpha))
        got = images.decode_png(filtered_png(a, depth, colour, kinds, interlace))
        assert (got.reshape(want.shape) == want).all(), (depth, colour)


def test_png_palettes_and_transparent_shades():
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    a = np.array([[0, 1], [2, 1]], np.uint16)[:, :, None]
    colours = chunk(b"PLTE", bytes([10, 20, 30, 40, 50, 60, 70, 80, 90]))
    got = images.decode_png(filtered_png(a, 2, 3, (0,), extra=colours + chunk(b"tRNS", bytes([0]))))
    assert got.tolist() == [[[255] * 3, [40, 50, 60]], [[70, 80, 90], [40, 50, 60]]]
    assert images.decode_png(filtered_png(a, 2, 3, (4,), extra=colours)).tolist()[0][0] == [10, 20, 30]
    assert images.decode_png(filtered_png(a, 8, 0, (0,), extra=chunk(b"tRNS", b"\0\1"))).tolist() == [[0, 255], [2, 255]]


def test_pnm_of_all_kinds():
    a = np.array([[0, 1, 1], [1, 0, 0]])
    ink = (1 - a) * 255
    assert (images.decode(b"P1\n# c\n3 2\n0 1 1\n100")[0] == ink).all()
    assert (images.decode(b"P4 3 2\n" + bytes([0b01100000, 0b10000000]))[0] == ink).all()
    assert images.decode(b"P2\n2 1 # w h\n15\n0 # black\n15")[0].tolist() == [[0, 255]]
    assert images.decode(b"P3\n1 1\n255\n1 2 3")[0].tolist() == [[[1, 2, 3]]]
    assert images.decode(b"P5 2 1 65535\n\0\0\xff\xff")[0].tolist() == [[0, 255]]
    assert [x.tolist() for x in images.decode(b"P6 1 1 255\n\x01\x02\x03\nP5 1 1 255\n\x09")] == [[[[1, 2, 3]]], [[9]]]
    with pytest.raises(ValueError):
        images.decode(b"P5 x")


def test_pages_of_cells(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 2, 1), (1, 0, 2, 1), (1, 0, 3, 0), (1, 0, -1, 1), (1, 1, 1, 1), (2, 0, 9, 9)], "doc_id int, page_no int, x int, y int")
    got = {(r.doc_id, r.page_no): np.frombuffer(r.gray, np.uint8).reshape(r.height, r.width).tolist() for r in images.pages_of_cells(cells, 3, 2).collect()}
    assert got == {(1, 0): [[0, 255, 255], [255, 255, 0]], (1, 1): [[255, 255, 255], [255, 0, 255]]}
    assert images.pages_of_cells(cells.limit(0), 3, 2).count() == 0


def test_segmentation(spark):
    page = np.full((400, 400), 255, np.uint8)
    page[40:240, 40:240] = np.minimum(page[40:240, 40:240], hexagon())
    page[300:302, 10:390] = 0  # a rule
    page[350, 350] = 0  # a speck
    df = spark.createDataFrame([(1, 0, 400, 400, bytearray(page.tobytes()), False)], "doc_id long, page_no int, width int, height int, gray binary, adaptive boolean")
    found = segment.find_segments(df)
    assert found.count() == 2
    assert segment.without_separators(segment.measured(found)).count() == 1
    box = segment.segment_pages(df).collect()
    assert len(box) == 1 and 70 < box[0].x1 < 90 and box[0].box_id == 0
    seg, skipped = segment.page_segments(page)
    assert not skipped and len(seg) == 2


def test_symbols():
    a = np.full((60, 160), 255, np.uint8)
    line(a, 10, 30, 140, 30, 1)
    for k in range(16):
        a[30 - k // 2 : 31 + k // 2, 140 - k] = 0
    (pts, _), = segment.page_segments(a)[0]
    got = segment.symbol(pts)
    assert got["kind"] == "arrow" and got["head"][0] > 130 and got["tail"][0] < 15
    b = np.full((60, 60), 255, np.uint8)
    line(b, 10, 30, 50, 30), line(b, 30, 10, 30, 50)
    assert segment.symbol(segment.page_segments(b)[0][0][0])["kind"] == "plus"
    assert segment.symbol(segment.page_segments(hexagon())[0][0][0]) is None


GLYPHS = {"N": ["#...#", "##..#", "#.#.#", "#..##", "#...#"], "C": [".###.", "#....", "#....", "#....", ".###."], "H": ["#...#", "#...#", "#####", "#...#", "#...#"], "3": ["####.", "....#", ".###.", "....#", "####."]}


def bitmap(rows, k=3):
    return np.kron(np.array([[c == "#" for c in r] for r in rows]), np.ones((k, k), bool)).astype(bool)


def test_glyph_reading(spark):
    read = glyphs.cascade([lambda m: glyphs.UNKNOWN, glyphs.template_reader({c: bitmap(r) for c, r in GLYPHS.items()})])
    assert [read(bitmap(r, 4)) for r in GLYPHS.values()] == list(GLYPHS)
    assert read(np.zeros((9, 9), bool)) == glyphs.UNKNOWN
    df = spark.createDataFrame([(15, 15, bytearray(bitmap(GLYPHS["N"]).astype(np.uint8).tobytes()))], "height int, width int, ink binary")
    assert glyphs.read_glyphs(df, read).first().a == "N"
    assert glyphs.sign_of(np.ones((2, 9), bool)) == "-"
    plus = np.zeros((9, 9), bool)
    plus[4] = plus[:, 4] = True
    assert glyphs.sign_of(plus) == "+" and glyphs.sign_of(bitmap(GLYPHS["C"])) == glyphs.UNKNOWN


def test_label_assembly(spark):
    letters = [("H", 18.0, 10.0, 5.0), ("C", 10.0, 10.0, 5.0), ("3", 25.0, 14.0, 3.0), ("N", 80.0, 50.0, 5.0), ("+", 87.0, 45.0, 3.0)]
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate(letters)], "k int, letter_idx int, a string, x double, y double, r double")
    got = {r.a: list(r.n) for r in glyphs.assemble_labels(df, ["k"]).collect()}
    assert got == {"CH3": [1, 0, 2], "N+": [3, 4]}


def boxes_at(*xs, y=100):
    return [{"box_id": k, "x1": x, "y1": y, "x2": x + 40, "y2": y + 40} for k, x in enumerate(xs)]


def arrow(k, x1, x2, y=120, **more):
    return {"arrow_id": k, "tail": (x1, y), "head": (x2, y), "agent": "", **more}


def test_reaction_layouts(spark):
    names = {k: f"S{k}" for k in range(9)}
    r = reaction.arrange([arrow(0, 60, 100)], [], boxes_at(10, 110), names)
    assert [(x["reactants"], x["products"]) for x in r] == [(["S0"], ["S1"])]
    r = reaction.arrange([arrow(0, 130, 170)], [{"x": 65, "y": 120}], boxes_at(10, 80, 180), names)
    assert [(x["reactants"], x["products"]) for x in r] == [(["S0", "S1"], ["S2"])]
    r = reaction.arrange([arrow(0, 130, 170)], [], boxes_at(10, 80, 180), names)
    assert r[0]["reactants"] == ["S1"]
    r = reaction.arrange([arrow(0, 60, 100), arrow(1, 100, 60, 124)], [], boxes_at(10, 110), names)
    assert len(r) == 1 and r[0]["reversible"]
    below = boxes_at(10) + [{"box_id": 1, "x1": 10, "y1": 300, "x2": 50, "y2": 340}]
    r = reaction.arrange([arrow(0, 60, 100)], [], below, names)
    assert r[0]["linebreak"] and r[0]["products"] == ["S1"]
    mid = boxes_at(10, 210) + [{"box_id": 2, "x1": 90, "y1": 60, "x2": 150, "y2": 100}]
    r = reaction.arrange([arrow(0, 60, 200, agent="H2O")], [], mid, names)
    assert r[0]["agent"] == "H2O.S2"
    k = "doc_id long, page_no int, "
    a = spark.createDataFrame([(1, 0, 0, 60, 120, 100, 120, "x")], k + "arrow_id int, tail_x int, tail_y int, head_x int, head_y int, agent string")
    b = spark.createDataFrame([(1, 0, 0, 10, 100, 50, 140, "C"), (1, 0, 1, 110, 100, 150, 140, "O")], k + "box_id int, x1 int, y1 int, x2 int, y2 int, structure string")
    p = spark.createDataFrame([], k + "x int, y int")
    got = reaction.reactions(a, p, b)
    from pyspark.sql import functions as F

    assert got.select(reaction.reaction_smiles(F.col("reactants"), F.col("agent"), F.col("products"))).first()[0] == "C>x>O"


def test_images_to_structures(spark, tmp_path):
    from inkgraph.plans import recognise as R
    from inkgraph.streaming.arrivals import arriving_pages

    page = np.full((400, 400), 255, np.uint8)
    page[100:300, 100:300] = hexagon()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(images.encode_png(page))
    (tmp_path / "in" / "bad.png").write_bytes(b"nothing")
    pages = images.read_pages(spark, str(tmp_path / "in"))
    assert pages.where("error IS NOT NULL").count() == 1 and images.page_count(pages).first().pages == 1
    o = R.Options(resolution=300, coordinates=True, page=True)
    rec = R.recognise(pages, o)
    rows = R.lines(rec, o).collect()
    assert len(rows) == 1 and rows[0].line.split()[:2] == [chem.smiles(*chem.parse_smiles("C1CCCCC1")), "1"]
    assert R.lines(rec, R.Options(format="SDF", confidence=True)).first().line.endswith("$$$$")
    with pytest.raises(ValueError):
        R.Options(embedded="inchi").checked()
    q = arriving_pages(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert spark.table("arrived").count() == 2


def test_reaction_rxn(spark):
    from inkgraph.operators.chem import molfile, parse_smiles
    from inkgraph.operators.reaction import reaction_rxn

    a, b = (molfile(*parse_smiles(x)) for x in ("CO", "C=O"))
    rows = spark.createDataFrame([([a, None, a], [b]), (None, [])], "r array<string>, p array<string>")
    full, empty = [x[0] for x in rows.select(reaction_rxn(rows["r"], rows["p"])).collect()]
    head, *tables = full.split("$MOL\n")
    assert head == "$RXN\n\n  inkgraph\n\n  2  1\n" and tables == [a, a, b]
    assert empty == "$RXN\n\n  inkgraph\n\n  0  0\n"


def test_unread_pages_and_unwritten_formats(spark, monkeypatch):
    from inkgraph.operators import segment as S
    from inkgraph.plans import recognise as R
    from inkgraph.sources.images import PAGES

    white = np.full((40, 40), 255, np.uint8)
    dots = white.copy()
    dots[2:38:6, 2:38:6] = dots[3:39:6, 2:38:6] = dots[2:38:6, 3:39:6] = dots[3:39:6, 3:39:6] = 0
    rows = [(1, "a", 0, 40, 40, white.tobytes(), False, False, None), (2, "b", 0, 40, 40, dots.tobytes(), False, False, None), (3, "c", 0, 0, 0, b"", False, False, "no image")]
    pages = spark.createDataFrame(rows, PAGES)
    assert [r.reason for r in R.unread(pages).collect()] == ["no image"]
    assert S.page_segments(dots, 0.1, False)[1] is False and len(S.page_segments(dots, 0.1, False)[0]) == 36
    monkeypatch.setattr(S, "MOST_SEGMENTS", 20)
    assert S.page_segments(dots, 0.1, False) == ([], True)
    records = spark.createDataFrame([], R.RECORDS)
    for o in (R.Options(format="rsmi"), R.Options(format="cmlr"), R.Options(format="sdf", embedded="inchi")):
        with pytest.raises(ValueError):
            R.lines(records, o)


def test_structures_from_graphs(spark):
    """A six-ring with a misread superatom, a charged and an unknown label; beside it a part too small to keep."""
    from inkgraph.operators import graph
    from inkgraph.plans import recognise as R

    named = {6: "OMc", 7: "N+", 8: "Qq"}
    atoms = [(i, 100.0 + 10 * i, 200.0 - i, named.get(i, " ")) for i in range(11)]
    ends = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0), (0, 6), (2, 7), (4, 8), (8, 4), (9, 10)]
    bonds = [(n, a, b, 2 if n in (0, 2) else 1, False, n == 7, False) for n, (a, b) in enumerate(ends)]
    graphs = spark.createDataFrame([(1, 0, 0, 2, 300, 5, 7, 0.5, 10.0, atoms, bonds)], R.GRAPHS)
    pairs = "key string, value string"
    spelling, groups = spark.createDataFrame([("OMc", "OMe")], pairs), spark.createDataFrame([("OMe", "OC")], pairs)
    (got,) = R.structures(graphs, spelling, groups).collect()
    assert got.structure == chem.smiles(*chem.parse_smiles("C1(OC)=CC([NH3+])=CC([*])C1"))
    assert (got.frag_id, got.dpi, got.avg_bond) == (0, 300, 20.0) and (got.x1, got.y2) == (205, 407)
    assert sum(line.endswith("  1  0  0  0") for line in got.mol.split("\n")) == 1  # the wedge
    # 9 atoms drawn and one six-ring, one unknown, in one fragment
    assert got.confidence == pytest.approx(9 * 0.02 + 0.3 - 0.5 - 0.1)
    one = R.structures(graphs, spelling, groups, {n: 1.0 for n in graph.FEATURES if n in ("Me", "N", "wedges", "positive", "bonds")}).first()
    assert one.confidence == 1 + 1 + 1 + 1 + 9
    bare = R.structures(graphs).first()
    assert "OC" not in bare.structure and bare.structure.count("[*]") == 2
    assert R.structures(graphs.where("doc_id = 2"), spelling, groups).count() == 0
