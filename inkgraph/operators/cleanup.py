"""Clean-up of scanned pages: filters, deskewing, masks and borders. Each takes and returns a gray image, 255 is white."""

from __future__ import annotations

import math

import numpy as np

from .raster import box_sums, components


def darkness(gray: np.ndarray, x: int, y: int, w: int, h: int) -> float:
    """Mean darkness of a rectangle, from 0 to 1; 0 outside the page."""
    part = gray[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)]
    return 1 - float(part.mean()) / 255 if part.size else 0.0


def black_filter(gray: np.ndarray, size: int = 20, step: int = 5, least: float = 0.95) -> np.ndarray:
    """Whitens solid black areas: what is connected to squares that are black nearly all over."""
    dark = gray < 128
    solid = np.zeros(gray.shape, bool)
    p = np.pad(dark.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = gray.shape
    for y in range(0, h - size + 1, step):
        for x in range(0, w - size + 1, step):
            if p[y + size, x + size] - p[y, x + size] - p[y + size, x] + p[y, x] >= least * size * size:
                solid[y : y + size, x : x + size] = True
    lab = components(dark)
    gone = np.isin(lab, np.unique(lab[solid & dark])) & dark
    return np.where(gone, 255, gray).astype(np.uint8)


def noise_filter(gray: np.ndarray, most: int = 4) -> np.ndarray:
    """Whitens connected specks of at most `most` pixels."""
    lab = components(gray < 230)
    size = np.bincount(lab.ravel())
    small = size <= most
    small[0] = False
    return np.where(small[lab], 255, gray).astype(np.uint8)


def blur_filter(gray: np.ndarray, size: int = 100, step: int = 50, least: float = 0.01) -> np.ndarray:
    """Whitens squares that hold next to nothing, and whose neighbours do too."""
    dark, out = gray < 230, gray.copy()
    share = box_sums(dark, size // 2) / np.maximum(box_sums(np.ones_like(dark), size // 2), 1)
    around = box_sums(dark, size // 2 + step) / np.maximum(box_sums(np.ones_like(dark), size // 2 + step), 1)
    out[(share < least / 10) & (around < least)] = 255
    return out


def gray_filter(gray: np.ndarray, size: int = 50, most: float = 0.5) -> np.ndarray:
    """Whitens squares without any black but with gray on them."""
    out = gray.copy()
    for y in range(0, gray.shape[0], size // 2):
        for x in range(0, gray.shape[1], size // 2):
            part = out[y : y + size, x : x + size]
            if part.size and part.min() > 85 and darkness(out, x, y, size, size) < most:
                part[:] = 255
    return out


def rotate(gray: np.ndarray, radians: float) -> np.ndarray:
    """About the middle, with white from outside; nearest pixel."""
    h, w = gray.shape
    y, x = np.mgrid[:h, :w]
    c, s, my, mx = math.cos(radians), math.sin(radians), (h - 1) / 2, (w - 1) / 2
    sx = np.round(mx + (x - mx) * c + (y - my) * s).astype(int)
    sy = np.round(my - (x - mx) * s + (y - my) * c).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    return np.where(inside, gray[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 255).astype(np.uint8)


def skew(gray: np.ndarray, most: float = 5.0, step: float = 0.1) -> float:
    """The turn in radians, within `most` degrees, after which rows differ most in darkness. The smallest such turn wins."""
    y, x = np.nonzero(gray < 128)
    if not len(y):
        return 0.0
    best = (-1.0, 0.0, 0.0)
    for a in np.arange(-most, most + step / 2, step):
        r = math.radians(float(a))
        rows = np.bincount((np.round(y * math.cos(r) - x * math.sin(r)) + gray.shape[1]).astype(int))
        sharp = float((np.diff(rows.astype(float)) ** 2).sum())
        best = max(best, (sharp, -abs(r), r))
    return best[2]


def deskew(gray: np.ndarray) -> tuple[np.ndarray, float]:
    turn = skew(gray)
    return (rotate(gray, -turn) if turn else gray), turn


def mask_of(gray: np.ndarray, least: float = 0.001) -> tuple[int, int, int, int]:
    """x1, y1, x2, y2 of what is not blank, where rows and columns of a running mean over 50 are darker than `least`; the page if nothing is."""
    dark = (gray < 200).astype(float)
    edges = []
    for axis in (0, 1):
        line = dark.mean(axis=axis)
        n = min(50, len(line))
        run = np.convolve(line, np.ones(n) / n, "same") if n else line
        used = np.flatnonzero(run > least)
        edges.append((int(used[0]), int(used[-1])) if len(used) else (0, len(line) - 1))
    return edges[0][0], edges[1][0], edges[0][1], edges[1][1]


def shift(gray: np.ndarray, dx: int, dy: int) -> np.ndarray:
    out = np.full_like(gray, 255)
    h, w = gray.shape
    if abs(dx) < w and abs(dy) < h:
        out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = gray[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def centre(gray: np.ndarray) -> tuple[np.ndarray, int, int]:
    """What is not blank moved to the middle of the page."""
    x1, y1, x2, y2 = mask_of(gray)
    dx, dy = (gray.shape[1] - 1 - x1 - x2) // 2, (gray.shape[0] - 1 - y1 - y2) // 2
    return shift(gray, dx, dy), dx, dy


def clear_border(gray: np.ndarray, width: int = 5, most: float = 0.5) -> np.ndarray:
    """Whitens bands along the edges of the page for as long as they are dark."""
    out = gray.copy()
    for turn in range(4):
        view = np.rot90(out, turn)
        at = 0
        while at + width <= view.shape[0] and 1 - view[at : at + width].mean() / 255 > most:
            view[at : at + width] = 255
            at += width
    return out


def unpaper(gray: np.ndarray) -> tuple[np.ndarray, float, int, int]:
    """(page, radians, dx, dy): all filters in order, then deskewing, centring and border clearing."""
    page = gray_filter(blur_filter(noise_filter(black_filter(gray))))
    page, turn = deskew(page)
    page, dx, dy = centre(page)
    return clear_border(page), turn, dx, dy
