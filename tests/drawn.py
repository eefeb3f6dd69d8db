"""Pages drawn for tests: strokes, wedges, hashes, circles, arrows and block letters in black on white."""

import math

import numpy as np

LETTERS = {
    "T": ["#######", "#######", "..###..", "..###..", "..###..", "..###..", "..###..", "..###..", "..###.."],
    "L": ["##.....", "##.....", "##.....", "##.....", "##.....", "##.....", "##.....", "#######", "#######"],
    "H": ["##...##", "##...##", "##...##", "#######", "#######", "##...##", "##...##", "##...##", "##...##"],
}


def paper(height, width):
    return np.full((height, width), 255, np.uint8)


def stroke(a, p, q, w=3.0, w2=None):
    """A line whose width goes from w to w2."""
    ys, xs = np.mgrid[: a.shape[0], : a.shape[1]]
    dx, dy = q[0] - p[0], q[1] - p[1]
    n = math.hypot(dx, dy)
    t = ((xs - p[0]) * dx + (ys - p[1]) * dy) / n
    off = abs((xs - p[0]) * dy - (ys - p[1]) * dx) / n
    a[(t >= 0) & (t <= n) & (off <= (w + ((w if w2 is None else w2) - w) * t / n) / 2)] = 0


def hashed(a, p, q, n=6, w=3.0, w2=13.0):
    dx, dy = q[0] - p[0], q[1] - p[1]
    size = math.hypot(dx, dy)
    for k in range(n):
        t = (k + 1) / (n + 1)
        half = (w + (w2 - w) * t) / 2
        x, y, vx, vy = p[0] + dx * t, p[1] + dy * t, -dy / size * half, dx / size * half
        stroke(a, (x - vx, y - vy), (x + vx, y + vy), 2.6)


def circle(a, x, y, r, w=3.0):
    ys, xs = np.mgrid[: a.shape[0], : a.shape[1]]
    a[abs(np.hypot(xs - x, ys - y) - r) <= w / 2] = 0


def ring(a, x, y, r, turn=0.5, n=6):
    pts = [(x + r * math.cos(2 * math.pi / n * k + turn), y + r * math.sin(2 * math.pi / n * k + turn)) for k in range(n)]
    for p, q in zip(pts, pts[1:] + pts[:1], strict=True):
        stroke(a, p, q)
    return pts


def chain(a, x, y, n, size=48.0):
    """A zigzag of n atoms to the right; the odd ones lie above."""
    pts = [(x + k * size * math.cos(math.pi / 6), y - (k % 2) * size * math.sin(math.pi / 6)) for k in range(n)]
    for p, q in zip(pts[:-1], pts[1:], strict=True):
        stroke(a, p, q)
    return pts


def arrow(a, tail, head):
    stroke(a, tail, head, 3)
    stroke(a, head, (head[0] - 22 * (1 if head[0] > tail[0] else -1), head[1]), 1, 17)


def plus(a, x, y, r=12):
    stroke(a, (x - r, y), (x + r, y), 2.4)
    stroke(a, (x, y - r), (x, y + r), 2.4)


def word(a, x, y, text, scale=2):
    for k, ch in enumerate(text):
        if ch != " ":
            m = np.kron(np.array([[c == "#" for c in line] for line in LETTERS[ch]]), np.ones((scale, scale), bool))
            part = a[y : y + m.shape[0], x + k * 9 * scale : x + k * 9 * scale + m.shape[1]]
            part[m] = 0
