import itertools
import math
import random
import re

from inkgraph.operators import chem


def drawing(points, bonds, turn=0.0, order=None, mirror=False, flip=False):
    """A drawing turned, mirrored or seen from behind, its atoms renumbered; bonds are (a, b, type, mark)."""
    order = order or list(range(len(points)))
    place = {old: new for new, old in enumerate(order)}
    atoms = []
    for old in order:
        s, x, y = points[old]
        x = -x if mirror or flip else x
        atoms.append({"symbol": s, "x": x * math.cos(turn) - y * math.sin(turn), "y": x * math.sin(turn) + y * math.cos(turn), "charge": 0})
    swap = {"wedge": "hash", "hash": "wedge"} if flip else {}  # from behind, what came forward goes back
    out = []
    for a, b, t, m in bonds:
        m = swap.get(m, m)
        out.append({"a": place[a], "b": place[b], "type": t, "hash": m in ("hash", "wavy"), "wedge": m in ("wedge", "wavy"), "arom": False})
    return atoms, out


# y grows downwards: N above the centre and towards the viewer, the acid to the right, the methyl to the left
ALANINE = [("C", 0, 0), ("N", 0, -1), ("C", -0.87, 0.5), ("C", 0.87, 0.5), ("O", 1.74, 0), ("O", 0.87, 1.5)]
ALANINE_BONDS = [(0, 1, 1, "wedge"), (0, 2, 1, ""), (0, 3, 1, ""), (3, 4, 2, ""), (3, 5, 1, "")]


def hand_from(smiles, order):
    """@ or @@ of the one centre as seen with its neighbours (first atoms of what is attached, H for hydrogen) in this order."""
    m = re.search(r"(\w?)\[C(@+)(H?)\]", smiles)
    rest = smiles[m.end() :]
    near = [m[1]] if m[1] else []
    near += ["H"] if m[3] else []
    while rest.startswith("("):
        depth, k = 0, 0
        while True:
            depth += {"(": 1, ")": -1}.get(rest[k], 0)
            k += 1
            if depth == 0:
                break
        near.append(rest[1:k])
        rest = rest[k:]
    near.append(rest)
    name = lambda x: "acid" if x.startswith("C(") or x.startswith("C=") else x[0]
    at = [order.index(name(x)) for x in near]
    odd = sum(x > y for n, x in enumerate(at) for y in at[n + 1 :]) % 2
    return {"@": "@@", "@@": "@"}[m[2]] if odd else m[2]


def test_right_handed_alanine():
    # R: seen with the hydrogen behind, N, acid, methyl run clockwise; the known string of this hand is N[C@H](C)C(=O)O
    got = chem.smiles(*drawing(ALANINE, ALANINE_BONDS))
    assert hand_from(got, ["N", "H", "C", "acid"]) == "@"
    back = chem.smiles(*drawing(ALANINE, [(a, b, t, "hash" if m else m) for a, b, t, m in ALANINE_BONDS]))
    assert hand_from(back, ["N", "H", "C", "acid"]) == "@@"


def test_mirror_drawings_differ_and_redrawn_ones_agree():
    rng = random.Random(2)
    key = chem.identity(*drawing(ALANINE, ALANINE_BONDS))
    other = chem.identity(*drawing(ALANINE, ALANINE_BONDS, mirror=True))
    assert key != other
    for _ in range(20):
        order = rng.sample(range(6), 6)
        turn = rng.uniform(0, 6)
        assert chem.identity(*drawing(ALANINE, ALANINE_BONDS, turn, order)) == key
        assert chem.identity(*drawing(ALANINE, ALANINE_BONDS, turn, order, mirror=True)) == other
        assert chem.identity(*drawing(ALANINE, ALANINE_BONDS, turn, order, flip=True)) == key  # seen from behind it is the same
    moved = [(0, 1, 1, ""), (0, 2, 1, "wedge"), *ALANINE_BONDS[2:]]  # another bond drawn towards the viewer: the hand stays, as all three turn alike
    assert chem.identity(*drawing(ALANINE, moved)) == key
    for plain in ("", "wavy"):
        flat = chem.identity(*drawing(ALANINE, [(0, 1, 1, plain), *ALANINE_BONDS[1:]]))
        assert flat not in (key, other)
    reversed_ = [(1, 0, 1, "wedge"), *ALANINE_BONDS[1:]]  # the narrow end at N says nothing of carbon
    assert "@" not in chem.smiles(*drawing(ALANINE, reversed_))


def test_no_hand_where_two_neighbours_are_alike():
    points = [("C", 0, 0), ("N", 0, -1), ("C", -0.87, 0.5), ("C", 0.87, 0.5)]
    assert "@" not in chem.smiles(*drawing(points, [(0, 1, 1, "wedge"), (0, 2, 1, ""), (0, 3, 1, "")]))


def tartaric(first, second):
    points = [("C", -0.5, 0), ("C", 0.5, 0), ("O", -0.5, -1), ("O", 0.5, -1), ("C", -1.4, 0.5), ("C", 1.4, 0.5), ("O", -1.4, 1.5), ("O", -2.3, 0), ("O", 1.4, 1.5), ("O", 2.3, 0)]
    bonds = [(0, 1, 1, ""), (0, 2, 1, first), (1, 3, 1, second), (0, 4, 1, ""), (1, 5, 1, ""), (4, 6, 2, ""), (4, 7, 1, ""), (5, 8, 2, ""), (5, 9, 1, "")]
    return points, bonds


def test_two_centres_three_isomers():
    rng = random.Random(3)
    keys = {}
    for marks in itertools.product(("wedge", "hash"), repeat=2):
        found = {chem.identity(*drawing(*tartaric(*marks), rng.uniform(0, 6), rng.sample(range(10), 10))) for _ in range(15)}
        assert len(found) == 1
        keys[marks] = found.pop()
    assert keys["wedge", "hash"] != keys["hash", "wedge"]  # mirror images
    assert keys["wedge", "wedge"] == keys["hash", "hash"]  # meso: the plane of symmetry
    assert len(set(keys.values())) == 3


def butene(up):
    return [("C", -1.5, -0.87), ("C", -1, 0), ("C", 0, 0), ("F", 0.5, -0.87 if up else 0.87)], [(0, 1, 1, ""), (1, 2, 2, ""), (2, 3, 1, "")]


def sides(smiles):
    """Whether the two ends of C?C=C?F lie on one side, by the marks as they are written."""
    m = re.fullmatch(r"([CF])([/\\])C=C([/\\])([CF])|C\(([/\\])[CF]\)=C([/\\])[CF]", smiles)
    return m[2] != m[3] if m[2] else m[5] == m[6]


def test_cis_and_trans():
    rng = random.Random(4)
    for up in (True, False):
        found = {chem.smiles(*drawing(*butene(up), rng.uniform(0, 6), rng.sample(range(4), 4), mirror=rng.random() < 0.5)) for _ in range(20)}
        assert len(found) == 1 and sides(found.pop()) == up
    ring = [("C", math.cos(k * math.pi / 3), math.sin(k * math.pi / 3)) for k in range(6)]
    assert not {"/", "\\"} & set(chem.smiles(*drawing(ring, [(k, (k + 1) % 6, 2 if k == 0 else 1, "") for k in range(6)])))


def test_double_bonds_that_share_a_bond():
    rng = random.Random(5)
    base = [("F", -1.5, 0.87), ("C", -1, 0), ("C", 0, 0), ("C", 0.5, 0.87), ("C", 1.5, 0.87), ("Cl", 2, 0)]
    seen = set()
    for a, b in itertools.product((1, -1), repeat=2):
        points = [(base[0][0], base[0][1], a * base[0][2]), *base[1:5], ("Cl", 2, 0.87 + b * 0.87)]
        bonds = [(0, 1, 1, ""), (1, 2, 2, ""), (2, 3, 1, ""), (3, 4, 2, ""), (4, 5, 1, "")]
        found = {chem.smiles(*drawing(points, bonds, rng.uniform(0, 6), rng.sample(range(6), 6), mirror=rng.random() < 0.5)) for _ in range(20)}
        assert len(found) == 1
        seen |= found
    assert len(seen) == 4


def test_written_files_keep_the_hand():
    atoms, bonds = drawing(ALANINE, ALANINE_BONDS, 0.3)
    assert chem.smiles(*chem.parse_molfile(chem.molfile(atoms, bonds))) == chem.smiles(atoms, bonds)
