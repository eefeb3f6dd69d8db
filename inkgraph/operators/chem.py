"""Molecule text: SDF and SMILES writers, a reader, ring perception and an identity key. Published methods, our own code.

A molecule is atoms (x, y, symbol, charge) and bonds (a, b, type), as molecule.Graph has them after labels are resolved.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Usual valences.
VALENCE = {"H": 1, "B": 3, "C": 4, "N": 3, "O": 2, "F": 1, "Si": 4, "P": 3, "S": 2, "Cl": 1, "Br": 1, "I": 1}
ORGANIC = {"B", "C", "N", "O", "P", "S", "F", "Cl", "Br", "I"}
BOND_LENGTH = 1.512


def neighbours(n: int, bonds: Iterable[dict]) -> list[list[tuple[int, int]]]:
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for b in bonds:
        near[b["a"]].append((b["b"], b["type"]))
        near[b["b"]].append((b["a"], b["type"]))
    return near


def _numbered(keys: list) -> list[int]:
    order = {k: n for n, k in enumerate(sorted(set(keys)))}
    return [order[k] for k in keys]


def _refine(near: list[list[tuple[int, int]]], rank: list[int]) -> list[int]:
    """Classes split by the sorted classes of neighbours, as Morgan's; the order of those that were told apart before stays."""
    while True:
        new = _numbered([(r, tuple(sorted((rank[j], t) for j, t in near[i]))) for i, r in enumerate(rank)])
        if len(set(new)) == len(set(rank)):
            return new
        rank = new


def handed(i: int, atoms: list[dict], bonds: list[dict], rank: list[int]) -> int:
    """The hand of a centre: the sign of the volume that its neighbours span in order of rank, an unseen hydrogen last; 0 if it has none.

    A centre is a carbon, silicon or charged nitrogen on three or four single bonds to atoms of different ranks, with a wedge or hash
    that starts there. These ends are raised or lowered, all else is in the plane; a wavy bond leaves the hand open.
    """
    own = [b for b in bonds if i in (b["a"], b["b"])]
    symbol, others = atoms[i]["symbol"], [b["b"] if b["a"] == i else b["a"] for b in own]
    able = symbol in ("C", "Si") and len(own) in (3, 4) or symbol == "N" and atoms[i].get("charge", 0) > 0 and len(own) == 4
    if not able or any(b["type"] != 1 or b.get("hash") and b.get("wedge") for b in own) or len({rank[k] for k in others}) < len(own):
        return 0
    lift = [(bool(b.get("wedge")) - bool(b.get("hash"))) * (b["a"] == i) for b in own]
    if not any(lift):
        return 0
    ends = {}
    for k, z in zip(others, lift, strict=True):
        dx, dy = atoms[k]["x"] - atoms[i]["x"], atoms[i]["y"] - atoms[k]["y"]
        size = math.hypot(dx, dy) or 1.0
        ends[k] = np.array([dx / size, dy / size, z])
    v = [ends[k] for k in sorted(others, key=rank.__getitem__)]
    last = v[3] if len(v) == 4 else -(v[0] + v[1] + v[2])
    volume = np.linalg.det([x - last for x in v[:3]])
    return 0 if abs(volume) < 1e-3 else 1 if volume > 0 else -1


def double_sides(atoms: list[dict], bonds: list[dict], rank: list[int]) -> list[tuple[dict, dict[int, int], bool]]:
    """(bond, side of each neighbour of its ends, whether the ranking ones are on one side) of each double bond that can be cis or trans.

    It is in no ring, an end has one or two other neighbours, of different ranks, on plain single bonds that are not wavy, none in line with it.
    """
    near, out = neighbours(len(atoms), bonds), []
    for b in bonds:
        if b["type"] != 2 or b.get("arom") or atoms[b["a"]]["symbol"] not in ("C", "N") or atoms[b["b"]]["symbol"] not in ("C", "N"):
            continue
        side, ranking = {}, []
        dx, dy = atoms[b["b"]]["x"] - atoms[b["a"]]["x"], atoms[b["b"]]["y"] - atoms[b["a"]]["y"]
        for end, far in ((b["a"], b["b"]), (b["b"], b["a"])):
            rest = [(j, t) for j, t in near[end] if j != far]
            if not 1 <= len(rest) <= 2 or any(t != 1 for _, t in rest) or len({rank[j] for j, _ in rest}) < len(rest):
                break
            for j, _ in rest:
                ex, ey = atoms[j]["x"] - atoms[end]["x"], atoms[j]["y"] - atoms[end]["y"]
                turn = (dx * ey - dy * ex) / ((math.hypot(dx, dy) * math.hypot(ex, ey)) or 1.0)
                side[j] = 0 if abs(turn) < 0.1 else 1 if turn > 0 else -1
            ranking.append(max(rest, key=lambda x: rank[x[0]])[0])
        wavy = any(x.get("hash") and x.get("wedge") and {x["a"], x["b"]} & {b["a"], b["b"]} for x in bonds)
        if len(ranking) == 2 and 0 not in side.values() and not wavy and not _joined(near, b["a"], b["b"]):
            out.append((b, side, side[ranking[0]] == side[ranking[1]]))
    return out


def _joined(near: list[list[tuple[int, int]]], a: int, b: int) -> bool:
    """Whether another way leads from a to b than the bond between them."""
    seen, todo = {a}, [j for j, _ in near[a] if j != b]
    while todo:
        k = todo.pop()
        if k == b:
            return True
        if k not in seen:
            seen.add(k)
            todo += [j for j, _ in near[k] if (k, j) != (a, b)]
    return False


def classes(atoms: list[dict], bonds: list[dict]) -> tuple[list[int], list[tuple[int, int]]]:
    """Classes of equivalent atoms, and each atom's (hand, 1 on a cis and 2 on a trans bond): what stereo tells apart splits further classes."""
    near = neighbours(len(atoms), bonds)
    rank = _refine(near, _numbered([(a["symbol"], a.get("charge", 0), len(near[i]), sum(t for _, t in near[i])) for i, a in enumerate(atoms)])) if atoms else []
    marks = [(0, 0)] * len(atoms)
    while True:
        found = [[handed(i, atoms, bonds, rank), 0] for i in range(len(atoms))]
        for b, _, same in double_sides(atoms, bonds, rank):
            found[b["a"]][1] = found[b["b"]][1] = 1 if same else 2
        if [tuple(x) for x in found] == marks:
            return rank, marks
        marks = [tuple(x) for x in found]
        rank = _refine(near, _numbered(list(zip(rank, marks, strict=True))))


def ranks(atoms: list[dict], bonds: list[dict]) -> list[int]:
    """A canonical number for each atom: classes, with ties broken one at a time."""
    near, rank = neighbours(len(atoms), bonds), classes(atoms, bonds)[0]
    while len(set(rank)) < len(atoms):
        twin = min(r for r in rank if rank.count(r) > 1)
        i = min(k for k, r in enumerate(rank) if r == twin)
        rank = _refine(near, [2 * r + (1 if r == twin and k != i else 0) for k, r in enumerate(rank)])
    return rank


def rings(atoms: int, bonds: list[dict]) -> list[list[int]]:
    """A smallest set of smallest rings: shortest cycles through each bond, shortest first, independent over GF(2) (Horton)."""
    near = neighbours(atoms, bonds)
    number = {frozenset((b["a"], b["b"])): k for k, b in enumerate(bonds)}
    found = {}
    for b in bonds:
        for root in range(atoms):
            paths = []
            for end in (b["a"], b["b"]):
                back = {root: -1}
                todo = deque([root])
                while todo and end not in back:
                    i = todo.popleft()
                    for j, _ in sorted(near[i]):
                        if j not in back:
                            back[j] = i
                            todo.append(j)
                path = []
                i = end if end in back else None
                while i is not None and i != -1:
                    path.append(i)
                    i = back[i]
                paths.append(path)
            p, q = paths
            if p and q and set(p) & set(q) == {root} and len(p) + len(q) > 3:
                ring = p + q[::-1][1:]
                edges = frozenset(number[frozenset((ring[k], ring[(k + 1) % len(ring)]))] for k in range(len(ring)) if frozenset((ring[k], ring[(k + 1) % len(ring)])) in number)
                if len(edges) == len(ring):
                    found.setdefault(edges, ring)
    basis: dict[int, int] = {}
    out = []
    for edges, ring in sorted(found.items(), key=lambda x: (len(x[0]), sorted(x[0]))):
        v = sum(1 << e for e in edges)
        while v and v.bit_length() in basis:
            v ^= basis[v.bit_length()]
        if v:
            basis[v.bit_length()] = v
            out.append(ring)
    return out


def statistics(atoms: list[dict], bonds: list[dict]) -> dict[str, int]:
    """rings, aromatic_rings, fragments, rings5, rings6, rotors, atoms, bonds."""
    near = neighbours(len(atoms), bonds)
    found = rings(len(atoms), bonds)
    order = {frozenset((b["a"], b["b"])): b for b in bonds}
    inside = {frozenset((r[k], r[(k + 1) % len(r)])) for r in found for k in range(len(r))}

    def aromatic(r: list[int]) -> bool:
        own = [order[frozenset((r[k], r[(k + 1) % len(r)]))] for k in range(len(r))]
        return len(r) == 6 and (all(b.get("arom") for b in own) or sum(b["type"] == 2 for b in own) == 3)

    rotors = sum(b["type"] == 1 and frozenset((b["a"], b["b"])) not in inside and len(near[b["a"]]) > 1 and len(near[b["b"]]) > 1 for b in bonds)
    seen: set[int] = set()
    parts = 0
    for i in range(len(atoms)):
        if i not in seen:
            parts += 1
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    todo += [j for j, _ in near[k]]
    return {"rings": len(found), "aromatic_rings": sum(map(aromatic, found)), "fragments": parts, "rings5": sum(len(r) == 5 for r in found), "rings6": sum(len(r) == 6 for r in found), "rotors": rotors, "atoms": len(atoms), "bonds": len(bonds)}


def smiles(atoms: list[dict], bonds: list[dict]) -> str:
    """Deterministic SMILES from canonical ranks: equal graphs give equal strings, whatever their order. Hands of centres and sides of double bonds are in it."""
    near = neighbours(len(atoms), bonds)
    rank = ranks(atoms, bonds)
    hand = [handed(i, atoms, bonds, rank) for i in range(len(atoms))]
    hand = [h if m else 0 for h, (m, _) in zip(hand, classes(atoms, bonds)[1], strict=True)]
    doubles = double_sides(atoms, bonds, classes(atoms, bonds)[0])
    mark = {1: "", 2: "=", 3: "#", 4: ":"}
    slash: dict[tuple[int, int], str] = {}

    def turned(i: int, order: list[int]) -> str:
        """@ if, from the first in order of writing, the others run counterclockwise."""
        usual = [*sorted((j for j, _ in near[i]), key=rank.__getitem__), -1]
        at = [usual.index(j) for j in order]
        odd = sum(x > y for n, x in enumerate(at) for y in at[n + 1 :]) % 2
        return "@" if (hand[i] > 0) != bool(odd) else "@@"

    def text(i: int, order: list[int]) -> str:
        a, s = atoms[i], atoms[i]["symbol"]
        charge = a.get("charge", 0)
        if s in ORGANIC and not charge and not hand[i]:
            return s
        if s in ("Xx", "*"):
            return "[*]"
        turn = turned(i, order) if hand[i] else ""
        h = max(VALENCE.get(s, 0) + (charge if s in ("N", "P", "O", "S") else -abs(charge)) - sum(t for _, t in near[i]), 0) if s in VALENCE and s != "H" else 0
        sign = ("+" if charge > 0 else "-") + (str(abs(charge)) if abs(charge) > 1 else "") if charge else ""
        return f"[{s}{turn}{'H' + (str(h) if h > 1 else '') if h else ''}{sign}]"

    seen: set[int] = set()
    out = []
    for root in sorted(range(len(atoms)), key=rank.__getitem__):
        if root in seen:
            continue
        # first walk: the spanning tree and the bonds that close rings; no recursion, chains may be long
        children: dict[int, list[tuple[int, int]]] = {}
        closing: dict[int, list[tuple[int, int, int]]] = {}
        stack, parent, done = [(root, -1)], {root: -1}, set()
        index: dict[int, int] = {}
        while stack:
            i, p = stack.pop()
            if i in index:
                continue
            index[i] = len(index)
            parent[i] = p
            for j, _ in sorted(near[i], key=lambda x: -rank[x[0]]):
                if j not in index:
                    stack.append((j, i))
        for i in index:
            for j, t in near[i]:
                if parent[j] == i and i != j:
                    children.setdefault(i, []).append((j, t))
                elif parent[i] != j and index[i] < index[j] and frozenset((i, j)) not in done:
                    done.add(frozenset((i, j)))
                    n = len(done)
                    closing.setdefault(i, []).append((n, t, j))
                    closing.setdefault(j, []).append((n, t, i))
        seen |= set(index)
        # what lies above an end of a double bond is written with a slash; bonds that two double bonds share keep what the first one gave them
        for b, side, _ in sorted((d for d in doubles if d[0]["a"] in index), key=lambda d: sorted((index[d[0]["a"]], index[d[0]["b"]]))):
            single = [(j, end) for end in (b["a"], b["b"]) for j, _ in near[end] if j in side and (parent[j] == end or parent[end] == j)]
            if len({end for _, end in single}) < 2:
                continue  # a side is closed by ring marks alone
            written = [((end, j), side[j]) if parent[j] == end else ((j, end), -side[j]) for j, end in single]
            written.sort(key=lambda w: index[w[0][1]])
            up = next((v * (1 if slash[w] == "/" else -1) for w, v in written if w in slash), written[0][1])
            for w, v in written:
                slash.setdefault(w, "/" if v == up else "\\")
        parts: list[str] = []
        work: list = [root]
        while work:
            w = work.pop()
            if isinstance(w, str):
                parts.append(w)
                continue
            ring = "".join(mark[t] + (str(n) if n < 10 else f"%{n}") for n, t, _ in sorted(closing.get(w, [])))
            kids = sorted(children.get(w, []), key=lambda x: rank[x[0]])
            around = [*([parent[w]] if parent[w] >= 0 else []), *([-1] if len(near[w]) == 3 else []), *(j for _, _, j in sorted(closing.get(w, []))), *(j for j, _ in kids)]
            parts.append(text(w, around) + ring)
            for k, (j, t) in reversed(list(enumerate(kids))):
                if k < len(kids) - 1:
                    work += [")", j, "(" + slash.get((w, j), mark[t])]
                else:
                    work += [j, slash.get((w, j), mark[t])]
        out.append("".join(parts))
    return ".".join(sorted(out))


def identity(atoms: list[dict], bonds: list[dict]) -> str:
    """A key that equal graphs share, and mirror images do not: a hash of the canonical string. It is no registered identifier."""
    return hashlib.sha256(smiles(atoms, bonds).encode()).hexdigest()[:27].upper()


def molfile(atoms: list[dict], bonds: list[dict], title: str = "", average: float | None = None) -> str:
    """A V2000 connection table; with the average bond length coordinates are scaled to a usual bond, y upwards."""
    scale = BOND_LENGTH / average if average else 1.0
    lines = [title, "  inkgraph", "", f"{len(atoms):3d}{len(bonds):3d}  0  0  0  0  0  0  0  0999 V2000"]
    lines += [f"{a['x'] * scale:10.4f}{-a['y'] * scale:10.4f}{0:10.4f} {a['symbol']:<3} 0  0  0  0  0  0  0  0  0  0  0  0" for a in atoms]
    lines += [f"{b['a'] + 1:3d}{b['b'] + 1:3d}{b['type']:3d}{(4 if b.get('hash') and b.get('wedge') else 6 if b.get('hash') else 1 if b.get('wedge') else 0):3d}  0  0  0" for b in bonds]
    charged = [(i + 1, a["charge"]) for i, a in enumerate(atoms) if a.get("charge")]
    for k in range(0, len(charged), 8):
        some = charged[k : k + 8]
        lines.append(f"M  CHG{len(some):3d}" + "".join(f"{i:4d}{c:4d}" for i, c in some))
    return "\n".join([*lines, "M  END"]) + "\n"


def cml(atoms: list[dict], bonds: list[dict], id: str = "m1") -> str:
    """A molecule in Chemical Markup Language, y upwards, with charges and wedge and hash bonds."""
    rows = "".join(
        f'<atom id="a{k}" elementType="{"R" if a["symbol"] in ("*", "Xx") else a["symbol"]}" x2="{a["x"]:.4f}" y2="{0.0 - a["y"]:.4f}"' + (f' formalCharge="{a["charge"]}"' if a.get("charge") else "") + "/>" for k, a in enumerate(atoms, 1)
    )
    stereo = lambda b: "" if bool(b.get("wedge")) == bool(b.get("hash")) else f"<bondStereo>{'W' if b.get('wedge') else 'H'}</bondStereo>"
    links = "".join(f'<bond atomRefs2="a{b["a"] + 1} a{b["b"] + 1}" order="{"A" if b["type"] == 4 else b["type"]}">{stereo(b)}</bond>' for b in bonds)
    return f'<molecule id="{id}"><atomArray>{rows}</atomArray><bondArray>{links}</bondArray></molecule>'


def sd_record(mol: str, properties: dict[str, str]) -> str:
    return mol + "".join(f"> <{k}>\n{v}\n\n" for k, v in properties.items()) + "$$$$\n"


def parse_molfile(text: str) -> tuple[list[dict], list[dict]]:
    lines = text.split("\n")
    n, m = int(lines[3][:3]), int(lines[3][3:6])
    atoms = [{"x": float(x[:10]), "y": -float(x[10:20]), "symbol": x[31:34].strip(), "charge": 0} for x in lines[4 : 4 + n]]
    stereo = {1: {"wedge": True}, 6: {"hash": True}, 4: {"hash": True, "wedge": True}}
    bonds = [{"a": int(x[:3]) - 1, "b": int(x[3:6]) - 1, "type": int(x[6:9]), **stereo.get(int(x[9:12] or 0), {})} for x in lines[4 + n : 4 + n + m]]
    for x in lines[4 + n + m :]:
        if x.startswith("M  CHG"):
            v = list(map(int, x[6:].split()))
            for i, c in zip(v[1::2], v[2::2], strict=True):
                atoms[i - 1]["charge"] = c
    return atoms, bonds


def splice(atoms: list[dict], bonds: list[dict], i: int, group: tuple[list[dict], list[dict]], angle: float = 0.6) -> None:
    """Atom i becomes the first atom of a group; the others are fanned out around it at their distance in the group."""
    first, base = group[0][0], len(atoms)
    atoms[i].update(symbol=first["symbol"], charge=first.get("charge", 0))
    for k, a in enumerate(group[0][1:], 1):
        atoms.append({**a, "x": atoms[i]["x"] + k * math.cos(angle * k), "y": atoms[i]["y"] + k * math.sin(angle * k)})
    at = lambda k: i if k == 0 else base + k - 1
    bonds += [{**b, "a": at(b["a"]), "b": at(b["b"])} for b in group[1]]


def parse_smiles(text: str) -> tuple[list[dict], list[dict]]:
    """Atoms and bonds of a plain SMILES: organic and bracket atoms, branches, ring closures, charges; aromatic letters make bonds of type 4."""
    atoms: list[dict] = []
    bonds: list[dict] = []
    stack: list[int] = []
    rings_: dict[str, tuple[int, int]] = {}
    last, kind, k = -1, 0, 0

    def order(a: int, b: int, t: int) -> int:
        return t or (4 if atoms[a].get("low") and atoms[b].get("low") else 1)

    while k < len(text):
        c = text[k]
        if c == "(":
            stack.append(last)
        elif c == ")":
            last = stack.pop()
        elif c in "-=#:/\\":
            kind = {"=": 2, "#": 3, ":": 4}.get(c, 1 if c == "-" else 0)
        elif c == ".":
            last = -1
        elif c.isdigit() or c == "%":
            name = text[k + 1 : k + 3] if c == "%" else c
            k += 2 if c == "%" else 0
            if name in rings_:
                other, t = rings_.pop(name)
                bonds.append({"a": other, "b": last, "type": order(other, last, kind or t)})
            else:
                rings_[name] = (last, kind)
            kind = 0
        else:
            if c == "[":
                end = text.index("]", k)
                body = text[k + 1 : end].lstrip("0123456789").replace("@", "")
                k = end
                symbol = body[:1].upper() + (body[1] if len(body) > 1 and body[1].islower() else "") if body[:1] != "*" else "*"
                rest = body[len(symbol) :]
                charge = (rest.count("+") - rest.count("-")) if not rest[-1:].isdigit() or not ("+" in rest or "-" in rest) else int(rest[-1]) * (1 if "+" in rest else -1)
                low = body[:1].islower()
            else:
                symbol = text[k : k + 2] if text[k : k + 2] in ("Cl", "Br") else c.upper()
                k += len(symbol) - 1
                charge, low = 0, c.islower()
            atoms.append({"x": 0.0, "y": 0.0, "symbol": symbol, "charge": charge, "low": low})
            if last >= 0:
                bonds.append({"a": last, "b": len(atoms) - 1, "type": order(last, len(atoms) - 1, kind)})
            last, kind = len(atoms) - 1, 0
        k += 1
    return atoms, bonds


def with_double_bonds(atoms: list[dict], bonds: list[dict]) -> list[dict]:
    """Bonds marked aromatic, where single, take turns in being double: a largest matching of their atoms, in canonical order of these, by augmenting paths of a search
    that may be cut short where odd rings meet.
    """
    open_ = [k for k, b in enumerate(bonds) if b.get("arom") and b["type"] == 1]
    if not open_:
        return bonds
    rank = ranks(atoms, [{**b, "type": 4, "hash": False, "wedge": False} if k in set(open_) else b for k, b in enumerate(bonds)])
    busy = {i for k, b in enumerate(bonds) if k not in open_ and b["type"] > 1 for i in (b["a"], b["b"])}
    busy |= {i for i, a in enumerate(atoms) if a["symbol"] in ("O", "S")}
    near: dict[int, list[int]] = {}
    for k in open_:
        a, b = bonds[k]["a"], bonds[k]["b"]
        if a not in busy and b not in busy:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    mate: dict[int, int] = {}

    def augment(i: int, seen: set[int]) -> bool:
        for j in sorted(near[i], key=rank.__getitem__):
            if j not in seen:
                seen |= {i, j}
                if j not in mate or augment(mate[j], seen):
                    mate[i], mate[j] = j, i
                    return True
        return False

    for i in sorted(near, key=rank.__getitem__):
        if i not in mate:
            augment(i, {i})
    return [{**b, "type": 2} if k in set(open_) and mate.get(b["a"]) == b["b"] else b for k, b in enumerate(bonds)]


def write_structures(atoms: DataFrame, bonds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, smiles, identity_key, mol and statistics of graphs: atoms (keys, atom_idx, x, y, symbol, charge), bonds (keys, a, b, type, hash, wedge, arom).

    If atoms have them, `group` is the SMILES of what stands in an atom's place, its first atom attached, and `average` the graph's
    bond length, to which coordinates are scaled. One row a graph; graphs without atoms have none.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in atoms.schema if f.name in keys)
    stats = ["rings", "aromatic_rings", "fragments", "rings5", "rings6", "rotors", "atoms", "bonds"]
    schema += ", smiles string, identity_key string, mol string, " + ", ".join(f"{s} int" for s in stats)
    names = [*keys, "smiles", "identity_key", "mol", *stats]

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty:
            return pd.DataFrame([], columns=names)
        a = a.sort_values("atom_idx")
        number = {int(i): n for n, i in enumerate(a["atom_idx"])}
        atoms_ = a[["x", "y", "symbol", "charge"]].to_dict("records")
        bonds_ = [{**r, "a": number[r["a"]], "b": number[r["b"]]} for r in b.to_dict("records") if r["a"] in number and r["b"] in number]
        for i, group in enumerate(a["group"] if "group" in a else ()):
            if isinstance(group, str):
                splice(atoms_, bonds_, i, parse_smiles(group))
        bonds_ = with_double_bonds(atoms_, bonds_)
        average = float(a["average"].iloc[0]) if "average" in a else None
        found = statistics(atoms_, bonds_)
        return pd.DataFrame([[*key, smiles(atoms_, bonds_), identity(atoms_, bonds_), molfile(atoms_, bonds_, average=average), *[found[s] for s in stats]]], columns=names)

    bonds = bonds.select(*[F.col(x).alias(x) for x in bonds.columns])  # both may come from one table, and cogroup tells columns by identity
    return atoms.groupBy(*keys).cogroup(bonds.groupBy(*keys)).applyInPandas(run, schema)


def read_sd(spark, path: str) -> DataFrame:
    """path, record_ord, mol, props: the records of SD files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parts = whole.select("path", F.posexplode(F.split("value", r"\$\$\$\$\n?")).alias("record_ord", "record")).where(F.trim("record") != "")
    pairs = F.expr(r"regexp_extract_all(record, '> <([^>]*)>\n([^\n]*)', 1)"), F.expr(r"regexp_extract_all(record, '> <([^>]*)>\n([^\n]*)', 2)")
    return parts.select("path", "record_ord", F.regexp_extract("record", r"(?s)^(.*?M  END\n)", 1).alias("mol"), F.map_from_arrays(*pairs).alias("props"))


def write_sd(records: DataFrame, path: str, mol: str = "mol", props: str = "props") -> None:
    """SD files, a record a row."""
    fields = F.array_join(F.transform(F.map_entries(props), lambda e: F.concat(F.lit("> <"), e["key"], F.lit(">\n"), e["value"], F.lit("\n\n"))), "")
    records.select(F.concat(F.col(mol), fields, F.lit("$$$$")).alias("value")).write.text(path)
