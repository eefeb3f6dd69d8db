"""Reactions: arrows, plus signs and structure boxes of a page become reactants, products and agents.

A page is one group: each step takes what the one before left.
"""

from __future__ import annotations

import math
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chem

REACH = 200


def box_distance(p: tuple[float, float], b: dict) -> float:
    return math.hypot(max(b["x1"] - p[0], 0, p[0] - b["x2"]), max(b["y1"] - p[1], 0, p[1] - b["y2"]))


def between(a: dict, b: dict) -> float:
    corners = lambda c: [(c[x], c[y]) for x in ("x1", "x2") for y in ("y1", "y2")]
    return min([box_distance(p, b) for p in corners(a)] + [box_distance(p, a) for p in corners(b)])


def mark_reversible(arrows: list[dict]) -> list[dict]:
    """Of two close arrows in opposite directions the first stays, as reversible."""
    out: list[dict] = []
    for a in arrows:
        va = (a["head"][0] - a["tail"][0], a["head"][1] - a["tail"][1])
        for b in out:
            vb = (b["head"][0] - b["tail"][0], b["head"][1] - b["tail"][1])
            size = math.hypot(*va) * math.hypot(*vb)
            close = max(math.dist(a["head"], b["tail"]), math.dist(a["tail"], b["head"])) < math.hypot(*vb) / 2
            if size and (va[0] * vb[0] + va[1] * vb[1]) / size < -0.95 and close:
                b["reversible"] = True
                break
        else:
            out.append(dict(a, reversible=a.get("reversible", False)))
    return out


def chain(arrows: list[dict]) -> list[list[dict]]:
    """Arrows in order of a walk to the nearest tail, from the page's corner, split where a hop is over the mean by two deviations."""
    todo, at, order, hops = list(arrows), (0.0, 0.0), [], []
    while todo:
        nxt = min(todo, key=lambda a: (math.dist(at, a["tail"]), a["arrow_id"]))
        hops.append(math.dist(at, nxt["tail"]))
        todo.remove(nxt)
        order.append(nxt)
        at = nxt["head"]
    if not order:
        return []
    inner = hops[1:]
    mean = sum(inner) / len(inner) if inner else 0.0
    dev = math.sqrt(sum((h - mean) ** 2 for h in inner) / len(inner)) if inner else 0.0
    groups = [[order[0]]]
    for a, h in zip(order[1:], inner, strict=True):
        if h > mean + 2 * dev and dev:
            groups.append([a])
        else:
            groups[-1].append(a)
    return groups


def side_boxes(arrow: dict, boxes: list[dict], used: set[int], head: bool) -> list[int]:
    """The nearest box behind the tail (or beyond the head) in the arrow's band, then greedily its nearest neighbours within reach on that side."""
    p, q = (arrow["head"], arrow["tail"]) if head else (arrow["tail"], arrow["head"])
    d = (p[0] - q[0], p[1] - q[1])
    size = math.hypot(*d) or 1.0
    centre = lambda b: ((b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2)
    out_of = lambda b: ((centre(b)[0] - p[0]) * d[0] + (centre(b)[1] - p[1]) * d[1]) / size
    off = lambda b: abs((centre(b)[0] - p[0]) * d[1] - (centre(b)[1] - p[1]) * d[0]) / size
    half = lambda b: max(b["x2"] - b["x1"], b["y2"] - b["y1"]) / 2
    free = [b for b in boxes if b["box_id"] not in used and out_of(b) > 0 and off(b) < half(b) + size / 2]
    got: list[dict] = []
    at = min(free, key=lambda b: (box_distance(p, b), b["box_id"]), default=None)
    while at is not None and (between(got[-1], at) if got else box_distance(p, at)) < REACH:
        got.append(at)
        free.remove(at)
        at = min(free, key=lambda b: (between(got[-1], b), b["box_id"]), default=None)
    return [b["box_id"] for b in got]


def agents(arrow: dict, boxes: list[dict]) -> list[int]:
    """Boxes near the arrow's shaft and within its span."""
    (x1, y1), (x2, y2) = arrow["tail"], arrow["head"]
    lo, hi = min(x1, x2), max(x1, x2)
    if abs(x2 - x1) < abs(y2 - y1):
        lo, hi = min(y1, y2), max(y1, y2)
        return [b["box_id"] for b in boxes if lo < b["y1"] and b["y2"] < hi and between({"x1": x1, "x2": x2, "y1": lo, "y2": hi}, b) < REACH]
    return [b["box_id"] for b in boxes if lo < b["x1"] and b["x2"] < hi and between({"x1": lo, "x2": hi, "y1": min(y1, y2), "y2": max(y1, y2)}, b) < REACH]


def joined_by_plus(ids: list[int], boxes: dict[int, dict], pluses: list[dict], nearest_first: bool = True) -> list[int]:
    """From the box nearest to the arrow on, the boxes that a plus sign stands between; the first always counts."""
    out = ids[:1]
    for a, b in zip(ids[:-1], ids[1:], strict=True):
        p, q = boxes[a], boxes[b]
        x1, x2 = sorted(((p["x1"] + p["x2"]) / 2, (q["x1"] + q["x2"]) / 2))
        y1, y2 = min(p["y1"], q["y1"]), max(p["y2"], q["y2"])
        if not any(x1 <= s["x"] <= x2 and y1 <= s["y"] <= y2 for s in pluses):
            break
        out.append(b)
    return out


def arrange(arrows: list[dict], pluses: list[dict], boxes: list[dict], structures: dict[int, str], as_agents: dict[int, str] | None = None) -> list[dict]:
    """A reaction for each arrow that has structures on both sides. As agents structures are written as in `as_agents`, if given.

    An arrow whose row has no box beyond it takes its products from the next line, the box farthest to the left below it.
    """
    by_id = {b["box_id"]: b for b in boxes}
    out = []
    for group in chain(mark_reversible(arrows)):
        for a in group:
            mid = agents(a, boxes)
            used = set(mid)
            before = joined_by_plus(side_boxes(a, boxes, used, head=False), by_id, pluses)
            after = joined_by_plus(side_boxes(a, boxes, used | set(before), head=True), by_id, pluses)
            linebreak = False
            if not after:
                below = [b for b in boxes if b["y1"] > max(a["head"][1], a["tail"][1]) and b["box_id"] not in used | set(before)]
                first = min(below, key=lambda b: (b["y1"] // REACH, b["x1"], b["box_id"]), default=None)
                after, linebreak = ([first["box_id"]], True) if first else ([], False)
            reactants, products = [structures[i] for i in reversed(before) if i in structures], [structures[i] for i in after if i in structures]
            if reactants and products:
                all_ = [by_id[i] for i in before + after + mid]
                xs, ys = [a["head"][0], a["tail"][0]], [a["head"][1], a["tail"][1]]
                agent = ".".join([x for x in [a.get("agent") or ""] if x] + [s for i in mid if (s := (as_agents or structures).get(i))])
                out.append({"arrow_id": a["arrow_id"], "reactants": reactants, "products": products, "agent": agent, "reversible": a["reversible"], "linebreak": linebreak, "x1": min([*xs, *(b["x1"] for b in all_)]), "y1": min([*ys, *(b["y1"] for b in all_)]), "x2": max([*xs, *(b["x2"] for b in all_)]), "y2": max([*ys, *(b["y2"] for b in all_)])})
    return out


def reactions(arrows: DataFrame, pluses: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, page_no, arrow_id, reactants, products, agent, reversible, linebreak, x1 .. y2.

    arrows: arrow_id, head_x, head_y, tail_x, tail_y, agent; pluses: x, y; boxes: box_id, x1, y1, x2, y2, structure, and agent_structure if agents are written in
    another way. All with doc_id and page_no.
    """
    keys = ["doc_id", "page_no"]
    as_list = lambda df, name, *c: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*c))).alias(name))
    page = as_list(arrows, "arrows", "arrow_id", "head_x", "head_y", "tail_x", "tail_y", "agent").join(as_list(boxes, "boxes", "box_id", "x1", "y1", "x2", "y2", "structure", *[x for x in ("agent_structure",) if x in boxes.columns]), keys).join(as_list(pluses, "pluses", "x", "y"), keys, "left")

    def run(batches):
        for pdf in batches:
            rows = []
            for p in pdf.itertuples():
                arrows_ = [{"arrow_id": a["arrow_id"], "head": (a["head_x"], a["head_y"]), "tail": (a["tail_x"], a["tail_y"]), "agent": a["agent"]} for a in p.arrows]
                boxes_ = [dict(b) for b in p.boxes]
                plus = [] if p.pluses is None else [dict(x) for x in p.pluses]
                named = [{b["box_id"]: b[c] for b in boxes_ if b.get(c)} for c in ("structure", "agent_structure")]
                for r in arrange(arrows_, plus, boxes_, named[0], named[1] or None):
                    rows.append((p.doc_id, p.page_no, *[r[c] for c in ("arrow_id", "reactants", "products", "agent", "reversible", "linebreak", "x1", "y1", "x2", "y2")]))
            yield pd.DataFrame(rows, columns=[*keys, "arrow_id", "reactants", "products", "agent", "reversible", "linebreak", "x1", "y1", "x2", "y2"])

    return page.mapInPandas(run, "doc_id long, page_no int, arrow_id int, reactants array<string>, products array<string>, agent string, reversible boolean, linebreak boolean, x1 int, y1 int, x2 int, y2 int")


def reaction_smiles(reactants: Column, agent: Column, products: Column) -> Column:
    """`reactants>agent>products`."""
    return F.concat(F.array_join(reactants, "."), F.lit(">"), F.coalesce(agent, F.lit("")), F.lit(">"), F.array_join(products, "."))


def reaction_rxn(reactants: Column, products: Column) -> Column:
    """A V2000 reaction file from arrays of connection tables; a null array is empty, null tables are left out."""
    none = F.array().cast("array<string>")
    sides = [F.filter(F.coalesce(side, none), lambda m: m.isNotNull()) for side in (reactants, products)]
    counts = [F.lpad(F.size(side).cast("string"), 3, " ") for side in sides]
    tables = F.transform(F.concat(*sides), lambda m: F.concat(F.lit("$MOL\n"), m))
    return F.concat(F.lit("$RXN\n\n  inkgraph\n\n"), *counts, F.lit("\n"), F.array_join(tables, ""))


def reaction_cml(reactants: Column, agent: Column, products: Column, reversible: Column) -> Column:
    """A CML reaction from arrays of connection tables; the agent is its title. Null arrays are empty."""

    @F.pandas_udf("string")
    def write(r: pd.Series, a: pd.Series, p: pd.Series, both: pd.Series) -> pd.Series:
        def side(name: str, tables, first: int) -> str:
            kind = name[:-4].lower()
            return f"<{name}>" + "".join(f"<{kind}>{chem.cml(*chem.parse_molfile(m), id=f'm{first + k}')}</{kind}>" for k, m in enumerate(tables)) + f"</{name}>"

        out = []
        for one, title, two, way in zip(r, a, p, both, strict=True):
            one, two = ([m for m in (x if x is not None else ()) if m] for x in (one, two))
            head = f" title={quoteattr(title)}" if title else ""
            out.append(f'<reaction xmlns="http://www.xml-cml.org/schema"{head} type="{"reversible" if way else "irreversible"}">{side("reactantList", one, 1)}{side("productList", two, 1 + len(one))}</reaction>')
        return pd.Series(out)

    return write(reactants, agent, products, F.coalesce(reversible, F.lit(False)))
