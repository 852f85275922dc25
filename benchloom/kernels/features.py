"""Circles and scale-invariant key points in numpy, by their published definitions."""

from __future__ import annotations

import numpy as np

from benchloom.kernels import pixels as P
from benchloom.kernels.motion import gradients, sample


def hough_circles(g: np.ndarray, votes: int = 40, apart: float = 50.0, least: int = 10, cell: float = 1.2) -> list[tuple[float, float, float]]:
    """(x, y, radius) of circles, most voted first: edge pixels vote along their gradients for centres, then for a radius."""
    smooth = P.blur(g, 9, 2.0)
    y, x = np.nonzero(P.edges(smooth, 50, 100))
    if not len(x):
        return []
    gx, gy = gradients(smooth)
    length = np.hypot(gx[y, x], gy[y, x]) + 1e-9
    ux, uy = gx[y, x] / length, gy[y, x] / length
    h, w = g.shape
    rows, cols = int(h / cell) + 1, int(w / cell) + 1
    ballots = np.zeros(rows * cols)
    for r in range(least, max(h, w)):
        for side in (1, -1):
            i, j = ((y + side * r * uy) / cell).astype(int), ((x + side * r * ux) / cell).astype(int)
            inside = (i >= 0) & (i < rows) & (j >= 0) & (j < cols)
            ballots += np.bincount(i[inside] * cols + j[inside], minlength=rows * cols)
    ballots = ballots.reshape(rows, cols)
    p = np.pad(ballots, 1)
    peak = (ballots > votes) & (ballots > p[1:-1, :-2]) & (ballots >= p[1:-1, 2:]) & (ballots > p[:-2, 1:-1]) & (ballots >= p[2:, 1:-1])
    i, j = np.nonzero(peak)
    out: list[tuple[float, float, float]] = []
    for k in np.argsort(-ballots[i, j], kind="stable"):
        cy, cx = (i[k] + 0.5) * cell, (j[k] + 0.5) * cell
        if any((cx - a) ** 2 + (cy - b) ** 2 < apart**2 for a, b, _ in out):
            continue
        at = np.hypot(x - cx, y - cy)
        counts, edges = np.histogram(at, bins=np.arange(least, max(h, w) + 2, 2.0))
        share = counts / np.maximum(edges[:-1] + 1.0, 1.0)
        best = int(share.argmax())
        if counts[best] > votes:
            out.append((float(cx), float(cy), float(at[(at >= edges[best]) & (at < edges[best + 1])].mean())))
    return out


def circle_rim(g: np.ndarray) -> float | None:
    """Evenness of the rim of a frame's circle; null without circles and with more than three, which are ambiguous."""
    circles = hough_circles(g)
    if not 1 <= len(circles) <= 3:
        return None
    cx, cy, r = (int(v) for v in circles[0])
    got = P.rim_symmetry(g, cy, cx, r)
    return None if got is None else max(0.0, min(1.0, got))


def key_points(g: np.ndarray, scales: int = 3, sigma: float = 1.6, contrast: float = 0.04, edge: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """((x, y, scale, angle), descriptors of 128 numbers) of extrema of differences of Gaussians over octaves."""
    places, signs = [], []
    octave, zoom = g.astype(float), 1.0
    while min(octave.shape) >= 16:
        levels = [P.blur(octave, int(4 * s) | 1, s) for s in sigma * 2.0 ** (np.arange(scales + 3) / scales)]
        d = np.stack([b - a for a, b in zip(levels, levels[1:])])
        p = np.pad(d, 1, mode="edge")
        shape = d.shape
        around = [p[1 + z : 1 + z + shape[0], 1 + y : 1 + y + shape[1], 1 + x : 1 + x + shape[2]] for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (z, y, x) != (0, 0, 0)]
        peak = (np.abs(d) > 0.5 * contrast / scales * 255) & (np.all([d > a for a in around], axis=0) | np.all([d < a for a in around], axis=0))
        peak[[0, -1]] = False
        peak[:, :5] = peak[:, -5:] = peak[:, :, :5] = peak[:, :, -5:] = False
        for z, i, j in np.argwhere(peak):
            f = d[z]
            xx, yy = f[i, j + 1] + f[i, j - 1] - 2 * f[i, j], f[i + 1, j] + f[i - 1, j] - 2 * f[i, j]
            xy = (f[i + 1, j + 1] - f[i + 1, j - 1] - f[i - 1, j + 1] + f[i - 1, j - 1]) / 4
            det = xx * yy - xy**2
            if det <= 0 or (xx + yy) ** 2 * edge >= (edge + 1) ** 2 * det or abs(f[i, j]) < contrast / scales * 255:
                continue
            s = sigma * 2.0 ** (z / scales)
            gy, gx = np.gradient(levels[z])
            for angle in directions(gx, gy, i, j, s):
                places.append((j * zoom, i * zoom, s * zoom, angle))
                signs.append(describe(gx, gy, i, j, s, angle))
        octave, zoom = levels[scales][::2, ::2], zoom * 2
    return np.array(places).reshape(-1, 4), np.array(signs).reshape(-1, 128)


def directions(gx: np.ndarray, gy: np.ndarray, i: int, j: int, s: float) -> list[float]:
    """The directions in which a point's surroundings change most: peaks of 36 bins of at least 0.8 of the highest."""
    r = int(round(4.5 * s))
    y, x = np.mgrid[max(0, i - r) : min(gx.shape[0], i + r + 1), max(0, j - r) : min(gx.shape[1], j + r + 1)]
    u, v = gx[y, x], gy[y, x]
    weight = np.hypot(u, v) * np.exp(-((y - i) ** 2 + (x - j) ** 2) / (2 * (1.5 * s) ** 2))
    bins = (np.rint(np.arctan2(v, u) * 18 / np.pi).astype(int) % 36).ravel()
    h = np.bincount(bins, weight.ravel(), 36)
    h = (np.roll(h, 2) + np.roll(h, -2) + 4 * (np.roll(h, 1) + np.roll(h, -1)) + 6 * h) / 16
    left, right = np.roll(h, 1), np.roll(h, -1)
    top = np.flatnonzero((h > left) & (h > right) & (h >= 0.8 * h.max()))
    return [float((k + 0.5 * (left[k] - right[k]) / (left[k] - 2 * h[k] + right[k])) * np.pi / 18) for k in top]


def describe(gx: np.ndarray, gy: np.ndarray, i: int, j: int, s: float, angle: float) -> np.ndarray:
    """4 x 4 histograms of 8 gradient directions around a point, turned to its own direction."""
    step = 3.0 * s / 4.0
    a, b = np.meshgrid(np.arange(-7.5, 8), np.arange(-7.5, 8))
    c, d = np.cos(angle), np.sin(angle)
    x, y = j + step * (c * a - d * b), i + step * (d * a + c * b)
    u, v = sample(gx, x, y), sample(gy, x, y)
    weight = np.hypot(u, v) * np.exp(-(a**2 + b**2) / (2 * 8.0**2))
    turn = ((np.arctan2(v, u) - angle) * 4 / np.pi) % 8
    out = np.zeros((6, 6, 8))
    for row, col, t, w in zip((b.ravel() + 7.5) / 4 + 0.125, (a.ravel() + 7.5) / 4 + 0.125, turn.ravel(), weight.ravel()):
        p, q, o = int(row + 0.5), int(col + 0.5), int(t)
        fr, fc, fo = row + 0.5 - p, col + 0.5 - q, t - o
        for dp, wp in ((0, 1 - fr), (1, fr)):
            for dq, wq in ((0, 1 - fc), (1, fc)):
                out[p + dp, q + dq, o % 8] += w * wp * wq * (1 - fo)
                out[p + dp, q + dq, (o + 1) % 8] += w * wp * wq * fo
    flat = out[1:5, 1:5].ravel()
    flat = np.minimum(flat / max(np.linalg.norm(flat), 1e-9), 0.2)
    return flat / max(np.linalg.norm(flat), 1e-9)


def good_matches(a: np.ndarray, b: np.ndarray, ratio: float = 0.75, block: int = 512) -> int:
    """Descriptors of ``a`` whose nearest one in ``b`` is clearly nearer than the second."""
    if len(b) < 2:
        return 0
    good = 0
    for k in range(0, len(a), block):
        d = np.sqrt(np.maximum((a[k : k + block] ** 2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a[k : k + block] @ b.T, 0))
        two = np.partition(d, 1, axis=1)[:, :2]
        good += int((two[:, 0] < ratio * two[:, 1]).sum())
    return good


def lattice_match(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(key points of one frame, of the other, good matches between them)."""
    (pa, da), (pb, db) = key_points(a), key_points(b)
    return np.array([len(pa), len(pb), good_matches(da, db) if len(pa) and len(pb) else 0], float)
