"""Pixel kernels in numpy. Gray images are uint8 arrays, 255 is white; masks are boolean, True is ink.

One page (or one box of it) is one row; a kernel runs inside mapInPandas over such rows.
"""

from __future__ import annotations

import math

import numpy as np


def background(gray: np.ndarray) -> float:
    """The brightest shade of the whole image, from 0 to 1."""
    return float(gray.max()) / 255 if gray.size else 1.0


def ink(gray: np.ndarray, threshold: float, bg: float | None = None) -> np.ndarray:
    """Pixels whose shade differs from the background by more than the threshold."""
    bg = background(gray) if bg is None else bg
    return np.abs(gray / 255.0 - bg) > threshold


def otsu_peaks(hist: np.ndarray) -> tuple[int, int, int, int, int]:
    """(split, peak1, peak2, max1, max2): see stats.otsu; the first of equals wins, empty sides are no split."""
    n = hist.astype(float)
    w, m = np.cumsum(n), np.cumsum(n * np.arange(len(n)))
    inner = (w > 0) & (w < w[-1])
    sigma = np.full(len(n), -1.0)
    share = w[inner] / w[-1]
    sigma[inner] = share * (1 - share) * (m[inner] / w[inner] - (m[-1] - m[inner]) / (w[-1] - w[inner])) ** 2
    split = int(sigma.argmax())
    one, two = int(hist[: split + 1].argmax()), int(hist[split + 1 :].argmax()) + split + 1 if split + 1 < len(hist) else split
    return split, one, two, int(hist[one]), int(hist[two])


def box_sums(a: np.ndarray, window: int) -> np.ndarray:
    """Sums over a square of side 2 window + 1 about each pixel, cut at the borders."""
    p = np.pad(a.astype(np.float64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = a.shape
    y0, y1 = np.clip(np.arange(h) - window, 0, h), np.clip(np.arange(h) + window + 1, 0, h)
    x0, x1 = np.clip(np.arange(w) - window, 0, w), np.clip(np.arange(w) + window + 1, 0, w)
    return p[y1][:, x1] - p[y0][:, x1] - p[y1][:, x0] + p[y0][:, x0]


def adaptive_otsu(gray: np.ndarray, window: int, bins: int = 20) -> np.ndarray:
    """Black and white by a threshold for each pixel, half-way between the two peaks of the histogram around it.

    Sliding histograms come from prefix sums, a plane for each bin.
    """
    level = np.minimum(gray.astype(int) * bins // 256, bins - 1)
    planes = np.stack([box_sums(level == k, window) for k in range(bins)])
    w, m = planes.cumsum(0), (planes * np.arange(bins)[:, None, None]).cumsum(0)
    total, moment = w[-1], m[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        share = w / total
        sigma = share * (1 - share) * (m / w - (moment - m) / (total - w)) ** 2
    split = np.where(np.isfinite(sigma), sigma, -1).argmax(0)
    k = np.arange(bins)[:, None, None]
    one = np.where(k <= split, planes, -1).argmax(0)
    two = np.where(k > split, planes, -1).argmax(0)
    cut = (one + two + 1) / (2 * bins) * 255
    return np.where(gray > cut, 255, 0).astype(np.uint8)


def to_gray(rgb: np.ndarray, invert: bool = False, adaptive: bool = False) -> tuple[np.ndarray, bool, bool]:
    """(gray, adaptive, inverted) of a page in colour or gray.

    The background is the fullest cell of a 20^3 colour histogram. Where its channels differ by over 0.05, or a pixel's do, the
    channel farthest from the background speaks for the pixel. A 50-bin Otsu decides: peaks nearer than 0.5 ask for the adaptive
    threshold, a taller dark peak for inversion.
    """
    if rgb.ndim == 2:
        rgb = np.repeat(rgb[:, :, None], 3, axis=2)
    shade = rgb.astype(np.float64) / 255
    cell = np.minimum((shade * 20).astype(int), 19)
    code = cell[..., 0] * 400 + cell[..., 1] * 20 + cell[..., 2]
    top = int(np.bincount(code.ravel(), minlength=8000).argmax())
    bg = (np.array([top // 400, top // 20 % 20, top % 20]) + 0.5) / 20
    coloured = (np.ptp(shade, axis=2) > 0.05) | (np.ptp(bg) > 0.05)
    far = np.abs(shade - bg).argmax(axis=2)
    gray = np.where(coloured, np.take_along_axis(shade, far[..., None], 2)[..., 0], shade.mean(axis=2))
    hist = np.bincount(np.minimum((gray * 50).astype(int), 49).ravel(), minlength=50)
    _, dark, light, n_dark, n_light = otsu_peaks(hist)
    adaptive = adaptive or (light - dark) / 50 < 0.5
    flip = invert or n_dark > n_light
    out = np.round((1 - gray if flip else gray) * 255).astype(np.uint8)
    if adaptive:
        window = max(15, min(out.shape) // 41)
        out = adaptive_otsu(despeckle(out), window)
    return out, bool(adaptive), bool(flip)


def despeckle(gray: np.ndarray) -> np.ndarray:
    """The median of each pixel and its eight neighbours."""
    p = np.pad(gray, 1, mode="edge")
    h, w = gray.shape
    return np.median([p[y : y + h, x : x + w] for y in range(3) for x in range(3)], axis=0).astype(np.uint8)


def thin(mask: np.ndarray) -> np.ndarray:
    """Skeleton by the two-step parallel thinning of Zhang and Suen; a part that it would erase keeps its first pixel."""
    m = np.pad(mask, 1).astype(np.uint8)
    while True:
        before = m.sum()
        for step in (0, 1):
            p = [m[:-2, 1:-1], m[:-2, 2:], m[1:-1, 2:], m[2:, 2:], m[2:, 1:-1], m[2:, :-2], m[1:-1, :-2], m[:-2, :-2]]
            around = sum(x.astype(int) for x in p)
            turns = sum((p[k] == 0) & (p[(k + 1) % 8] == 1) for k in range(8))
            one, two = ((p[0], p[2], p[4]), (p[2], p[4], p[6])) if step == 0 else ((p[0], p[2], p[6]), (p[0], p[4], p[6]))
            gone = (m[1:-1, 1:-1] == 1) & (around >= 2) & (around <= 6) & (turns == 1) & (one[0] * one[1] * one[2] == 0) & (two[0] * two[1] * two[2] == 0)
            m[1:-1, 1:-1][gone] = 0
        if m.sum() == before:
            break
    out = m[1:-1, 1:-1].astype(bool)
    lab = components(mask)
    label, first = np.unique(lab, return_index=True)
    lost = ~np.isin(label, np.unique(lab[out])) & (label > 0)
    out[np.unravel_index(first[lost], out.shape)] = True
    return out


def run_histogram(mask: np.ndarray, longest: int = 40) -> np.ndarray:
    """How many runs of ink of each length under `longest` there are in all rows and columns."""
    out = np.zeros(longest, np.int64)
    for m in (mask, mask.T):
        p = np.pad(m, ((0, 0), (1, 1))).astype(np.int8)
        d = np.diff(p, axis=1)
        size = np.argwhere(d == -1)[:, 1] - np.argwhere(d == 1)[:, 1]
        out += np.bincount(size[size < longest], minlength=longest)[:longest]
    return out


def noise_factor(mask: np.ndarray) -> tuple[int, float, float]:
    """(thickness, factor, factor45): see stats.noise_factors; an undefined quotient is NaN."""
    n = run_histogram(mask).astype(float)
    thick = int(n[1:].argmax()) + 1
    top, low = (n[2], n[3]) if thick > 2 else (n[1], n[2]) if thick == 2 else (n[2], n[1])
    return thick, top / low if low else math.nan, n[4] / n[5] if n[5] else 0.0


def smooth(gray: np.ndarray, rounds: int = 10, kappa: float = 30.0, rate: float = 0.2) -> np.ndarray:
    """Edge-preserving smoothing: anisotropic diffusion after Perona and Malik."""
    u = gray.astype(np.float64)
    for _ in range(rounds):
        p = np.pad(u, 1, mode="edge")
        d = [p[:-2, 1:-1] - u, p[2:, 1:-1] - u, p[1:-1, :-2] - u, p[1:-1, 2:] - u]
        u = u + rate * sum(x * np.exp(-((x / kappa) ** 2)) for x in d)
    return np.clip(np.round(u), 0, 255).astype(np.uint8)


def resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear."""
    h, w = gray.shape
    y, x = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1), np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), (y - y0)[:, None], (x - x0)[None, :]
    g = gray.astype(np.float64)
    out = (g[y0][:, x0] * (1 - fx) + g[y0][:, x1] * fx) * (1 - fy) + (g[y1][:, x0] * (1 - fx) + g[y1][:, x1] * fx) * fy
    return np.round(out).astype(np.uint8)


def smooth_scale(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    return smooth(resize(smooth(gray, 5), height, width), 5)


def prepare_box(gray: np.ndarray, dpi: int, working: int, threshold: float, thinning: bool, jaggy: bool) -> tuple[np.ndarray, float, bool]:
    """(mask, scale, thinned) of a box: scaling or smoothing as its resolution and noise ask for, then thinning where lines are thick."""
    thick, factor, _ = noise_factor(ink(gray, threshold))
    scale = 1.0
    if jaggy:
        gray, scale = resize(gray, max(1, gray.shape[0] // 2), max(1, gray.shape[1] // 2)), 0.5
    elif 150 < dpi < 300:
        scale = working / dpi if working > dpi else 300 / dpi
        gray = smooth_scale(gray, max(1, round(gray.shape[0] * scale)), max(1, round(gray.shape[1] * scale)))
    elif dpi >= 300 and 0.5 < factor < 1.0:
        gray = smooth(gray)
    mask = ink(gray, threshold)
    if thinning and thick > 1:
        return thin(mask), scale, True
    return mask, scale, False


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 in reading order of first pixels, 0 for background; eight neighbours connect. Union-find over runs."""
    h, w = mask.shape
    d = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    start, end = np.argwhere(d == 1), np.argwhere(d == -1)
    row, a, b = start[:, 0], start[:, 1], end[:, 1]
    parent = list(range(len(row)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if a[i] <= b[j] and a[j] <= b[i]:
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
            if b[i] < b[j]:
                i += 1
            else:
                j += 1
    roots: dict[int, int] = {}
    out = np.zeros((h, w), np.int32)
    for k in range(len(row)):
        out[row[k], a[k] : b[k]] = roots.setdefault(find(k), len(roots) + 1)
    return out


def flood_area(mask: np.ndarray, x: int, y: int) -> tuple[int, float, float]:
    """(area, mean x, mean y) of the part of the mask that holds (x, y); area 0 where there is no ink."""
    if not mask[y, x]:
        return 0, float(x), float(y)
    lab = components(mask)
    ys, xs = np.nonzero(lab == lab[y, x])
    return len(xs), float(xs.mean()), float(ys.mean())


def run_through(mask: np.ndarray, x: int, y: int, across: bool) -> int:
    """Length of the run of ink through a pixel, along a row or a column; a pixel beside it is tried if it has none."""
    line, at = (mask[y], x) if across else (mask[:, x], y)
    for k in (at, at - 1, at + 1):
        if 0 <= k < len(line) and line[k]:
            lo = hi = k
            while lo > 0 and line[lo - 1]:
                lo -= 1
            while hi + 1 < len(line) and line[hi + 1]:
                hi += 1
            return int(hi - lo + 1)
    return 0


def simplify(points: list[tuple[int, int]], tolerance: float) -> list[tuple[int, int]]:
    """The polyline of Douglas and Peucker."""
    if len(points) < 3:
        return points
    (x0, y0), (x1, y1) = points[0], points[-1]
    size = math.dist(points[0], points[-1])
    off = [abs((y1 - y0) * (x - x0) - (x1 - x0) * (y - y0)) / size if size else math.dist((x, y), (x0, y0)) for x, y in points]
    k = max(range(len(points)), key=off.__getitem__)
    if off[k] <= tolerance:
        return [points[0], points[-1]]
    return simplify(points[: k + 1], tolerance)[:-1] + simplify(points[k:], tolerance)


def trace(skeleton: np.ndarray, tolerance: float = 2.0) -> tuple[list[dict], list[dict]]:
    """Atoms and bonds of a skeleton: paths between ends and junctions, simplified; every vertex is an atom."""
    ink_ = {(int(x), int(y)) for y, x in np.argwhere(skeleton)}
    ring = [(1, 0), (0, 1), (-1, 0), (0, -1), (1, 1), (-1, 1), (-1, -1), (1, -1)]

    def near(p):
        out = []
        for dx, dy in ring:
            q = (p[0] + dx, p[1] + dy)
            # a diagonal step is no step of its own where two straight ones lead there
            if q in ink_ and not (dx and dy and ((p[0] + dx, p[1]) in ink_ or (p[0], p[1] + dy) in ink_)):
                out.append(q)
        return out

    nodes = sorted(p for p in ink_ if len(near(p)) != 2)
    used: set[frozenset] = set()
    index: dict[tuple[int, int], int] = {}
    atoms: list[dict] = []
    bonds: list[dict] = []

    def atom(p):
        if p not in index:
            index[p] = len(atoms)
            atoms.append({"x": float(p[0]), "y": float(p[1]), "label": " "})
        return index[p]

    def walk(p, q):
        path = [p, q]
        used.add(frozenset((p, q)))
        while len(near(path[-1])) == 2:
            nxt = [r for r in near(path[-1]) if r != path[-2]]
            if not nxt or frozenset((path[-1], nxt[0])) in used:
                break
            used.add(frozenset((path[-1], nxt[0])))
            path.append(nxt[0])
        corners = simplify(path, tolerance) if path[0] != path[-1] else simplify(path[: len(path) // 2 + 1], tolerance)[:-1] + simplify(path[len(path) // 2 :], tolerance)
        for a, b in zip(corners[:-1], corners[1:], strict=True):
            bonds.append({"a": atom(a), "b": atom(b)})

    for p in nodes:
        for q in near(p):
            if frozenset((p, q)) not in used:
                walk(p, q)
    for p in sorted(ink_):  # rings without a node
        if not any(frozenset((p, q)) in used for q in near(p)) and len(near(p)) == 2:
            walk(p, near(p)[0])
    return atoms, bonds
