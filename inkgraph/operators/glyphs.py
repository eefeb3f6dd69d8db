"""Characters: recognition by templates or a function of the user's, and assembly of labels from glyphs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import READABLE
from .raster import resize

UNKNOWN = "_"
SIZE = (12, 9)


def fit(mask: np.ndarray) -> np.ndarray:
    """A glyph's ink at the size of templates, from 0 to 1."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return np.zeros(SIZE)
    part = mask[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    return resize((part * 255).astype(np.uint8), *SIZE) / 255.0


def template_reader(templates: dict[str, np.ndarray], least: float = 0.8) -> Callable[[np.ndarray], str]:
    """A reader that answers the template of the largest correlation, or UNKNOWN under `least`; the first wins."""
    names = list(templates)
    stack = np.stack([fit(templates[n]).ravel() for n in names])
    stack = stack - stack.mean(axis=1, keepdims=True)
    stack /= np.maximum(np.linalg.norm(stack, axis=1, keepdims=True), 1e-9)

    def read(mask: np.ndarray) -> str:
        v = fit(mask).ravel()
        v = v - v.mean()
        score = stack @ v / max(np.linalg.norm(v), 1e-9)
        return names[int(score.argmax())] if score.max() >= least else UNKNOWN

    return read


def cascade(readers: list[Callable[[np.ndarray], str]], alphabet: str = READABLE) -> Callable[[np.ndarray], str]:
    """The first answer of several readers that is in the alphabet. Boxes with hardly any ink or white, and a small 7, are unknown."""

    def read(mask: np.ndarray) -> str:
        if mask.sum() <= 2 or (~mask).sum() <= 2:
            return UNKNOWN
        for reader in readers:
            c = reader(mask)
            if c != UNKNOWN and c.isalnum() and c in alphabet:
                if c == "7" and (mask.shape[1] <= 10 or mask.shape[0] <= 20):
                    continue
                return c
        return UNKNOWN

    return read


def cuts(mask: np.ndarray, most: int = 64) -> list[int]:
    """Columns before which fused glyphs may be parted: both edges, and where a column has less ink than those beside it, the thinnest ones first."""
    ink = mask.sum(axis=0)
    inner = [k for k in range(1, len(ink)) if ink[k] <= ink[k - 1] and ink[k] <= ink[min(k + 1, len(ink) - 1)]]
    return sorted({0, len(ink), *sorted(inner, key=lambda k: (ink[k], k))[: most - 2]})


def split_fused(mask: np.ndarray, reader: Callable[[np.ndarray], str], low: int, high: int) -> list[tuple[str, int, int]]:
    """(character, first column, end) of the glyphs that a part of ink is best read as, from left to right; none if nothing can be read.

    Every window between two cuts, from `low` to `high` columns wide, is read by itself. Of the windows that were read those are taken that do not
    overlap and cover most columns, of equal ones the fewest: a choice of weighted intervals.
    """
    at = cuts(mask)
    windows = []
    for i, a in enumerate(at):
        for b in at[i + 1 :]:
            if low <= b - a <= high:
                part = mask[:, a:b]
                rows, cols = np.flatnonzero(part.any(axis=1)), np.flatnonzero(part.any(axis=0))
                if len(rows) and (c := reader(part[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1])) != UNKNOWN:
                    windows.append((b, a, c))
    best: dict[int, tuple[int, int, tuple]] = {at[0]: (0, 0, ())}
    for end in at[1:]:
        before = max((best[k] for k in at if k in best and k < end), key=lambda x: (x[0], x[1]))
        taken = [(best[a][0] + b - a, best[a][1] - 1, (*best[a][2], (c, a, b))) for b, a, c in windows if b == end]
        best[end] = max([before, *taken], key=lambda x: (x[0], x[1]))
    return list(best[at[-1]][2])


def fused_glyphs(glyphs: DataFrame, reader: Callable[[np.ndarray], str], low: int, high: int) -> DataFrame:
    """glyphs (height, width, ink binary, ...) that nobody could read, a row for each character read in them, with `a`, first and last column."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, g in enumerate(pdf.itertuples()):
                rows += [(k, *found) for found in split_fused(np.frombuffer(g.ink, np.uint8).reshape(g.height, g.width) > 0, reader, low, high)]
            out = pdf.iloc[[r[0] for r in rows]].copy()
            out["a"], out["first"], out["last"] = [r[1] for r in rows], [r[2] for r in rows], [r[3] - 1 for r in rows]
            yield out

    return glyphs.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in glyphs.schema) + ", a string, first int, last int")


def first_known(*answers: Column) -> Column:
    """The first of several readers' columns that is not unknown."""
    return F.coalesce(*[F.when(a != UNKNOWN, a) for a in answers], F.lit(UNKNOWN))


def read_glyphs(glyphs: DataFrame, reader: Callable[[np.ndarray], str]) -> DataFrame:
    """glyphs (height, width, ink binary, ...) with `a`, the character."""

    def run(batches):
        for pdf in batches:
            pdf["a"] = [reader(np.frombuffer(g.ink, np.uint8).reshape(g.height, g.width) > 0) for g in pdf.itertuples()]
            yield pdf

    return glyphs.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in glyphs.schema) + ", a string")


def follows(p: dict, q: dict) -> bool:
    """Whether q goes on from p: beside it and level, a digit a little lower, or a sign a little higher."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    if not 0 < dx < 1.8 * (p["r"] + q["r"]):
        return False
    if q["a"].isdigit():
        return -p["r"] / 2 < dy < 1.5 * p["r"]
    if q["a"] in "+-":
        return -1.8 * p["r"] < dy < p["r"]
    return abs(dy) < min(p["r"], q["r"])


def assemble(letters: list[dict]) -> list[dict]:
    """Labels from glyphs (a, x, y, r): each goes on with the first later glyph that follows it; signs go to the end.

    A glyph that nothing follows or precedes is a label of its own. n has the members' places in the input.
    """
    order = sorted(range(len(letters)), key=lambda i: (letters[i]["x"], letters[i]["y"], i))
    after, has_before = {}, set()
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if j not in has_before and follows(letters[i], letters[j]):
                after[i] = j
                has_before.add(j)
                break
    out = []
    for i in order:
        if i in has_before:
            continue
        n = [i]
        while n[-1] in after:
            n.append(after[n[-1]])
        text = "".join(letters[k]["a"] for k in n)
        signs = "".join(c for c in text if c in "+-")
        first, last = letters[n[0]], letters[n[-1]]
        out.append({"a": text.replace("+", "").replace("-", "") + signs, "x1": first["x"], "y1": first["y"], "r1": first["r"], "x2": last["x"], "y2": last["y"], "r2": last["r"], "n": n})
    return out


def assemble_labels(letters: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label_idx, a, x1, y1, r1, x2, y2, r2, n of glyphs (keys, letter_idx, a, x, y, r); a drawing is a group."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in letters.schema if f.name in keys)
    names = ["a", "x1", "y1", "r1", "x2", "y2", "r2", "n"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("letter_idx")
        idx = pdf["letter_idx"].tolist()
        got = assemble(pdf[["a", "x", "y", "r"]].to_dict("records"))
        return pd.DataFrame([[*key, k, *[x[c] for c in names[:-1]], [idx[i] for i in x["n"]]] for k, x in enumerate(got)], columns=[*keys, "label_idx", *names])

    return letters.groupBy(*keys).applyInPandas(run, schema + ", label_idx int, a string, x1 double, y1 double, r1 double, x2 double, y2 double, r2 double, n array<int>")


def sign_of(mask: np.ndarray) -> str:
    """`+`, `-` or UNKNOWN of a small box: a flat, filled box is a minus; a middle row and column of ink with empty corners a plus."""
    h, w = mask.shape
    if h / w < 0.7 and mask.mean() > 0.9:
        return "-"
    if 0.6 < h / w < 1.6 and h >= 3 and w >= 3:
        corner = mask[: h // 3, : w // 3].any() or mask[: h // 3, -(w // 3) :].any() or mask[-(h // 3) :, : w // 3].any() or mask[-(h // 3) :, -(w // 3) :].any()
        if mask[h // 2].mean() > 0.9 and mask[:, w // 2].mean() > 0.9 and not corner:
            return "+"
    return UNKNOWN
