import re

import numpy as np
import pytest

from drawn import LETTERS, arrow, chain, circle, hashed, paper, plus, ring, stroke, word
from inkgraph.operators import chem, glyphs
from inkgraph.plans import recognise as R
from inkgraph.sources.images import PAGES

OPTIONS = R.Options(resolution=300)


def pages_of(spark, arrays):
    return spark.createDataFrame([(k, f"p{k}", 0, a.shape[1], a.shape[0], a.tobytes(), False, False, None) for k, a in enumerate(arrays)], PAGES)


def methylhexane(kind, mirror=False):
    a = paper(300, 420)
    pts = chain(a, 60, 170, 6)
    top = (pts[3][0], pts[3][1] - 48)
    {"wedge": lambda: stroke(a, pts[3], top, 2, 11), "hash": lambda: hashed(a, pts[3], top), "plain": lambda: stroke(a, pts[3], top)}[kind]()
    return a[:, ::-1].copy() if mirror else a


def test_wedges_and_hashes_give_hands(spark):
    kinds = [(k, m) for k in ("plain", "wedge", "hash") for m in (False, True)]
    rows = {r.doc_id: r for r in R.recognise(pages_of(spark, [methylhexane(*k) for k in kinds]), OPTIONS).collect()}
    key = {k: rows[i].identity_key for i, k in enumerate(kinds)}
    assert key["plain", False] == key["plain", True]
    assert key["wedge", False] == key["hash", True] != key["wedge", True] == key["hash", False]
    assert len(set(key.values())) == 3
    # seen from the methyl towards the viewer: propyl left, ethyl right; with the hydrogen behind, propyl, methyl, ethyl run clockwise
    assert re.sub("@+H?", "", rows[2].structure).replace("[C]", "C") == chem.smiles(*chem.parse_smiles("CCCC(C)CC"))
    assert {rows[2].structure, rows[3].structure} == {"CCC[C@@H](C)CC", "CCC[C@H](C)CC"} and rows[2].structure.count("@@")
    wedge = [x for x in rows[2].mol.split("\n") if x.endswith("  1  0  0  0")]
    assert len(wedge) == 1 and sum(x.endswith("  6  0  0  0") for x in rows[4].mol.split("\n")) == 1


def test_circles_make_rings_aromatic(spark):
    a = paper(300, 300)
    ring(a, 150, 150, 60)
    circle(a, 150, 150, 35)
    (got,) = R.recognise(pages_of(spark, [a]), OPTIONS).collect()
    assert got.structure == chem.smiles(*chem.parse_smiles("C1=CC=CC=C1"))


def reaction_page(word_="HT L"):
    a = paper(400, 1000)
    ring(a, 100, 200, 60)
    plus(a, 215, 200)
    chain(a, 265, 215, 6, 44)
    arrow(a, (500, 200), (660, 200))
    word(a, 540, 170, word_)
    word(a, 560, 208, "LL")
    ring(a, 800, 200, 60, n=7)
    return a


def reader():
    return glyphs.template_reader({c: np.kron(np.array([[x == "#" for x in line] for line in m]), np.ones((2, 2), bool)) for c, m in LETTERS.items()})


@pytest.fixture(scope="module")
def found(spark):
    return R.reactions_of(pages_of(spark, [reaction_page()]), R.Options(format="rsmi", resolution=300), reader()).cache()


def test_page_of_a_reaction(spark, found):
    six, six_chain, seven = (chem.smiles(*chem.parse_smiles(x)) for x in ("C1CCCCC1", "CCCCCC", "C1CCCCCC1"))
    (line,) = R.reaction_lines(found, R.Options(format="rsmi")).collect()
    left, agent, right = line.line.split(">")
    assert left.split(".") == [six, six_chain] and right == seven
    assert agent == "HT L LL"


def test_reaction_files(spark, found):
    (rxn,) = [r.line for r in R.reaction_lines(found, R.Options(format="rxn")).collect()]
    head, *tables = rxn.split("$MOL\n")
    assert head.split("\n")[4] == "  2  1" and len(tables) == 3
    assert [chem.smiles(*chem.parse_molfile(t)) for t in tables] == [chem.smiles(*chem.parse_smiles(x)) for x in ("C1CCCCC1", "CCCCCC", "C1CCCCCC1")]
    import xml.etree.ElementTree as ET

    (cml,) = [r.line for r in R.reaction_lines(found, R.Options(format="cmlr")).collect()]
    tree = ET.fromstring(cml)
    ns = "{http://www.xml-cml.org/schema}"
    assert tree.get("title") == "HT L LL" and tree.get("type") == "irreversible"
    assert [len(tree.findall(f"{ns}{side}List/{ns}{side}")) for side in ("reactant", "product")] == [2, 1]
    atoms = tree.findall(f"{ns}productList//{ns}atom")
    assert len(atoms) == 7 and {x.get("elementType") for x in atoms} == {"C"}
    with pytest.raises(ValueError, match="no format of reactions"):
        R.reaction_lines(found, R.Options(format="sdf"))


def test_pages_of_which_there_is_nothing_have_a_reason(spark, monkeypatch):
    from inkgraph.operators import segment as S

    a = paper(300, 300)
    ring(a, 150, 150, 60)
    dots = paper(90, 90)
    for y in range(2, 80, 6):
        for x in range(2, 80, 6):
            dots[y : y + 2, x : x + 2] = 0
    pages = pages_of(spark, [a, dots]).unionByName(spark.createDataFrame([(2, "p2", 0, 0, 0, b"", False, False, "no image")], PAGES))
    monkeypatch.setattr(S, "MOST_SEGMENTS", 100)
    rows = {r.doc_id: r for r in R.recognise(pages, OPTIONS).collect()}
    assert rows[0].error is None and rows[0].structure
    assert rows[1].structure is None and rows[1].error == "over 100 segments" and rows[2].error == "no image"
    records = spark.createDataFrame(list(rows.values()), R.RECORDS)
    assert [r.doc_id for r in R.lines(records, OPTIONS).collect()] == [0]
    (sdf,) = R.lines(records, R.Options(format="sdf", embedded="can")).collect()
    assert f"> <SMILES>\n{rows[0].structure}\n" in sdf.line


def test_fragments_that_come_near_are_one(spark):
    zigzag = lambda first, x, y=50.0, up=5.0: [(first + k, x + 10.0 * k, y + up * (k % 2), " ") for k in range(4)]
    atoms = [*zigzag(0, 0.0), *zigzag(4, 39.0), *zigzag(8, 71.0, 55.0, -5.0)]  # a gap of nine tenths of a bond, then one of a fifth
    bonds = [(n, a, a + 1, 1, False, False, False) for n, a in enumerate([0, 1, 2, 4, 5, 6, 8, 9, 10])]
    far = [(k, 500.0 * (k // 6) + 10.0 * k, 5.0 * (k % 2), " ") for k in range(12)]
    links = [(k, k, k + 1, 1, False, False, False) for k in range(11) if k != 5]
    graphs = spark.createDataFrame([(1, 0, 0, 2, 300, 0, 0, 1.0, 10.0, atoms, bonds), (2, 0, 0, 2, 300, 0, 0, 1.0, 10.0, far, links)], R.GRAPHS)
    got = sorted((r.doc_id, r.structure) for r in R.structures(graphs).collect())
    assert got == [(1, "C" * 11), (2, "C" * 6), (2, "C" * 6)]


def test_accuracy_of_a_folder(spark, tmp_path):
    from inkgraph.plans.accuracy import accuracy
    from inkgraph.sources import images

    (tmp_path / "pages").mkdir()
    (tmp_path / "truth").mkdir()
    for name, kind in (("one", "wedge"), ("two", "hash")):
        (tmp_path / "pages" / f"{name}.png").write_bytes(images.encode_png(methylhexane(kind)))
        a, b = chem.parse_smiles("CCCC(C)CC")
        xy = [(0, 0), (1, -0.5), (2, 0), (3, -0.5), (3, -1.5), (4, 0), (5, -0.5)]
        for atom, (x, y) in zip(a, xy, strict=True):
            atom["x"], atom["y"] = x, y
        (mark,) = [x for x in b if {x["a"], x["b"]} == {3, 4}]
        mark.update(a=3, b=4, wedge=True)  # true of the first page, the mirror image of the second
        (tmp_path / "truth" / f"{name}.sdf").write_text(chem.sd_record(chem.molfile(a, b), {}))
    (tmp_path / "truth" / "three.sdf").write_text(chem.sd_record(chem.molfile(*chem.parse_smiles("CO")), {}))
    got = accuracy(images.read_pages(spark, str(tmp_path / "pages")), chem.read_sd(spark, str(tmp_path / "truth")), OPTIONS).first()
    assert (got.identical, got.total) == (1, 3) and got.recall == pytest.approx(1 / 3)
