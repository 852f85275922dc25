"""Motion between frames in numpy: corners, sparse and dense flow, robust transforms, and the camera's motion over a clip.

Sparse flow is the pyramidal method of Lucas and Kanade, dense flow Farnebäck's polynomial
expansion, robust transforms are found by random sample consensus with a fixed seed.
"""

from __future__ import annotations

import numpy as np

from benchloom.kernels import pixels as P


def box(g: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square window, borders repeated; by running sums."""
    r = size // 2
    p = np.pad(g, ((r, size - 1 - r), (r, size - 1 - r)), mode="edge")
    c = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size]) / size**2


def gradients(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives along x and y."""
    p = np.pad(g, 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    return gx, gy


def structure(g: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The structure tensor (xx, xy, yy), averaged over a window."""
    gx, gy = gradients(g)
    return box(gx * gx, window), box(gx * gy, window), box(gy * gy, window)


def good_corners(g: np.ndarray, most: int = 500, quality: float = 0.01, apart: float = 10.0, window: int = 7) -> np.ndarray:
    """Points (x, y) with the greatest least eigenvalue of the structure tensor, at least ``apart`` from each other."""
    xx, xy, yy = structure(g, window)
    least = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy**2)
    p = np.pad(least, 1, constant_values=-np.inf)
    peak = np.all([least >= p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
    y, x = np.nonzero(peak & (least > max(quality * least.max(), 1e-9)))
    order = np.argsort(-least[y, x], kind="stable")
    cell, taken, kept = max(apart, 1.0), {}, []
    for k in order:
        u, v = int(x[k] // cell), int(y[k] // cell)
        near = (q for a in (u - 1, u, u + 1) for b in (v - 1, v, v + 1) for q in taken.get((a, b), ()))
        if all((x[k] - i) ** 2 + (y[k] - j) ** 2 >= apart**2 for i, j in near):
            taken.setdefault((u, v), []).append((x[k], y[k]))
            kept.append(k)
            if len(kept) == most:
                break
    return np.stack([x[kept], y[kept]], 1).astype(float) if kept else np.zeros((0, 2))


def harris_corners(g: np.ndarray, most: int, window: int = 2, k: float = 0.04, share: float = 0.01) -> np.ndarray:
    """The ``most`` points (x, y) of the strongest Harris response above ``share`` of the greatest, weakest first."""
    xx, xy, yy = structure(g, window)
    r = xx * yy - xy**2 - k * (xx + yy) ** 2
    y, x = np.nonzero(r > share * r.max())
    if len(x) > most:
        top = np.argsort(r[y, x], kind="stable")[-most:]
        y, x = y[top], x[top]
    return np.stack([x, y], 1).astype(float)


def sample(g: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values of a frame at any places; borders are repeated."""
    h, w = g.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    i, j = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    u, v = x - j, y - i
    i2, j2 = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    return (1 - v) * ((1 - u) * g[i, j] + u * g[i, j2]) + v * ((1 - u) * g[i2, j] + u * g[i2, j2])


def halved(g: np.ndarray) -> np.ndarray:
    """The next level of a pyramid."""
    return P.blur(g, 5, 1.0)[::2, ::2]


def track(a: np.ndarray, b: np.ndarray, points: np.ndarray, window: int = 21, levels: int = 3, rounds: int = 30, least: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``b``, whether found) of points of ``a``, by Lucas and Kanade's method from coarse to fine."""
    pyramid = [(a, b)]
    while len(pyramid) <= levels and min(pyramid[-1][0].shape) >= 2 * window:
        pyramid.append((halved(pyramid[-1][0]), halved(pyramid[-1][1])))
    r = np.arange(window) - window // 2
    ox, oy = (o.ravel()[None, :] for o in np.meshgrid(r, r))
    shift, found = np.zeros_like(points), np.ones(len(points), bool)
    for level in reversed(range(len(pyramid))):
        before, after = pyramid[level]
        gx, gy = (d / 8.0 for d in gradients(before))
        px, py = points[:, :1] / 2**level + ox, points[:, 1:] / 2**level + oy
        patch, dx, dy = sample(before, px, py), sample(gx, px, py), sample(gy, px, py)
        xx, xy, yy = (dx * dx).sum(1), (dx * dy).sum(1), (dy * dy).sum(1)
        det = xx * yy - xy**2
        small = (xx + yy - np.sqrt((xx - yy) ** 2 + 4 * xy**2)) / (2 * window**2)
        ok = (small > least) & (det > 1e-9)
        shift = shift * 2 if level < len(pyramid) - 1 else shift
        move = np.flatnonzero(ok)
        for _ in range(rounds):
            if not len(move):
                break
            error = patch[move] - sample(after, px[move] + shift[move, :1], py[move] + shift[move, 1:])
            ex, ey = (error * dx[move]).sum(1), (error * dy[move]).sum(1)
            step = np.stack([yy[move] * ex - xy[move] * ey, xx[move] * ey - xy[move] * ex], 1) / det[move][:, None]
            shift[move] += step
            move = move[np.hypot(*step.T) > 0.01]
        if level == 0:
            found &= ok
    out = points + shift
    h, w = a.shape
    return out, found & (out[:, 0] >= 0) & (out[:, 0] < w) & (out[:, 1] >= 0) & (out[:, 1] < h)


def similarity(a: np.ndarray, b: np.ndarray, within: float = 3.0, trials: int = 500, seed: int = 5) -> tuple[np.ndarray | None, int]:
    """((cos, sin, dx, dy) of the rotation, scale and shift most points agree on, how many do), by sample consensus.

    A point (x, y) goes to (cos x - sin y + dx, sin x + cos y + dy).
    """
    if len(a) < 2:
        return None, 0
    za, zb = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
    rng = np.random.default_rng(seed)
    i = rng.integers(len(a), size=trials)
    j = (i + 1 + rng.integers(len(a) - 1, size=trials)) % len(a)
    apart = np.abs(za[i] - za[j]) > 1e-6
    i, j = i[apart], j[apart]
    if not len(i):
        return None, 0
    turn = (zb[i] - zb[j]) / (za[i] - za[j])
    move = zb[i] - turn * za[i]
    agree = np.abs(turn[:, None] * za + move[:, None] - zb) <= within
    inside = agree[int(agree.sum(axis=1).argmax())]
    for _ in range(5):
        x, y = za[inside] - za[inside].mean(), zb[inside] - zb[inside].mean()
        spread = (np.abs(x) ** 2).sum()
        if spread < 1e-9:
            return None, 0
        t = (np.conj(x) * y).sum() / spread
        m = zb[inside].mean() - t * za[inside].mean()
        now = np.abs(t * za + m - zb) <= within
        if now.sum() < 2 or (now == inside).all():
            break
        inside = now
    return np.array([t.real, t.imag, m.real, m.imag]), int(inside.sum())


def anchor_transform(a: np.ndarray, b: np.ndarray, least: int = 4) -> np.ndarray | None:
    """The similarity from one frame to another by its tracked corners; null where too few agree."""
    points = good_corners(a)
    if len(points) < least:
        return None
    there, found = track(a, b, points, window=max(11, min(a.shape) // 40))
    if found.sum() < least:
        return None
    got, agree = similarity(points[found], there[found])
    return got if got is not None and agree >= least else None


def expansion(g: np.ndarray, n: int = 5, sigma: float = 1.2) -> np.ndarray:
    """Coefficients (x, y, xx, yy, xy) of the quadratic that fits each pixel's neighbourhood best."""
    t = np.arange(-n, n + 1)
    w = np.exp(-(t**2) / (2 * sigma**2))
    w /= w.sum()

    def along(f: np.ndarray, k: np.ndarray, axis: int) -> np.ndarray:
        p = np.pad(f, [(n, n) if d == axis else (0, 0) for d in (0, 1)], mode="edge")
        size = f.shape[axis]
        return sum(k[i] * (p[i : i + size] if axis == 0 else p[:, i : i + size]) for i in range(2 * n + 1))

    down = [along(g, w * t**q, 0) for q in range(3)]
    moment = {(p, q): along(down[q], w * t**p, 1) for p, q in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1))}
    s2, s4 = (w * t**2).sum(), (w * t**4).sum()
    # Least squares over 1, x, y, xx, yy, xy decouples but for 1, xx and yy.
    gram = np.linalg.inv(np.array([[1, s2, s2], [s2, s4, s2**2], [s2, s2**2, s4]]))
    flat = [moment[0, 0], moment[2, 0], moment[0, 2]]
    xx, yy = (sum(gram[k, i] * flat[i] for i in range(3)) for k in (1, 2))
    return np.stack([moment[1, 0] / s2, moment[0, 1] / s2, xx, yy, moment[1, 1] / s2**2])


def dense_flow(a: np.ndarray, b: np.ndarray, window: int = 15, levels: int = 3, rounds: int = 3) -> np.ndarray:
    """(2, height, width): how far each pixel of ``a`` moved along x and y in ``b``, by polynomial expansion from coarse to fine."""
    sizes = [a.shape]
    while len(sizes) < levels and min(sizes[-1]) >= 64:
        sizes.append((round(sizes[-1][0] / 2), round(sizes[-1][1] / 2)))
    flow = np.zeros((2, *sizes[-1]))
    for size in reversed(sizes):
        scale = a.shape[0] / size[0]
        smooth = lambda f: P.resize(P.blur(f, max(3, int(scale) * 2 + 1), scale * 0.5) if scale > 1 else f, *size, area=False)  # noqa: B023, E731
        if flow.shape[1:] != size:
            flow = np.stack([P.resize(flow[k], *size, area=False) * (size[1 - k] / flow.shape[2 - k]) for k in (0, 1)])
        one, two = expansion(smooth(a)), expansion(smooth(b))
        y, x = np.mgrid[: size[0], : size[1]]
        for _ in range(rounds):
            there = np.stack([sample(c, x + flow[0], y + flow[1]) for c in two])
            xx, yy, xy = (one[2] + there[2]) / 2, (one[3] + there[3]) / 2, (one[4] + there[4]) / 4
            bx = (one[0] - there[0]) / 2 + xx * flow[0] + xy * flow[1]
            by = (one[1] - there[1]) / 2 + xy * flow[0] + yy * flow[1]
            g11, g12, g22 = (box(m, window) for m in (xx**2 + xy**2, xy * (xx + yy), yy**2 + xy**2))
            h1, h2 = box(xx * bx + xy * by, window), box(xy * bx + yy * by, window)
            det = g11 * g22 - g12**2 + 1e-3
            flow = np.stack([(g22 * h1 - g12 * h2) / det, (g11 * h2 - g12 * h1) / det])
    return flow


def mean_flow(a: np.ndarray, b: np.ndarray) -> float:
    """Mean length of the dense flow."""
    return float(np.hypot(*dense_flow(a, b)).mean())


def static_flow(a: np.ndarray, b: np.ndarray, dark: bool) -> float:
    """Mean flow between frames, of their centre under a dark background."""
    part = (0.2, 0.8, 0.2, 0.8)
    return mean_flow(P.region(a, part), P.region(b, part)) if dark else mean_flow(a, b)


def belt_flow(a: np.ndarray, b: np.ndarray, part: P.Region = (0.4, 0.7, 0.1, 0.9)) -> float:
    """Mean horizontal flow of a conveyor's region."""
    return float(dense_flow(P.region(a, part), P.region(b, part))[0].mean())


def median_flow(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dx, dy, mean length) of what moves: medians over pixels beyond the 60th percentile of lengths."""
    flow = dense_flow(a, b, window=21)
    length = np.hypot(*flow)
    moving = length > max(0.5, float(np.percentile(length, 60)))
    moving = moving if moving.any() else length > 0
    if not moving.any():
        return 0.0, 0.0, 0.0
    return float(np.median(flow[0][moving])), float(np.median(flow[1][moving])), float(length[moving].mean())


def scissor_angle(g: np.ndarray) -> float | None:
    """The angle between the arms from the two uppermost to the two lowest of the 30 strongest corners."""
    corners = harris_corners(g, 30)
    if len(corners) < 4:
        return None
    order = np.argsort(corners[:, 1], kind="stable")
    low, high = corners[order[-2:]], corners[order[:2]]
    one, two = low[0] - high[0], low[1] - high[1]
    cosine = one @ two / (np.linalg.norm(one) * np.linalg.norm(two) + 1e-8)
    return float(np.arccos(np.clip(cosine, -1.0, 1.0)))


def link_lengths(points: np.ndarray) -> np.ndarray:
    """Distances of all pairs of a frame's points."""
    i, j = np.triu_indices(len(points), 1)
    return np.hypot(*(points[i] - points[j]).T) if len(points) > 1 else np.zeros(0)


def crane_angle(dy: float, height: int) -> float:
    """Degrees of a vertical shift under a field of view of 60 degrees."""
    return float(np.degrees(np.arctan2(abs(dy), height / 2.0 / np.tan(np.deg2rad(30.0)))))


def camera_motion(first: np.ndarray, second: np.ndarray, second_last: np.ndarray | None, last: np.ndarray, frames: int, crane: bool) -> tuple[float | None, str]:
    """(degrees, how they were found) of a clip, from its first, second, second-last and last grey frames.

    A crane's rise is the vertical shift of the frame, another motion its rotation; null where neither can be found.
    """
    if frames < 2:
        return 0.0, "static_detected"
    dark = float(first.mean()) < 40
    still = 0.5 if dark else 0.8
    if crane:
        if (got := anchor_transform(first, last)) is not None:
            dx, dy, pace, how = got[2], got[3], float(np.hypot(got[2], got[3])), "anchor_to_final_crane_translation"
        else:
            dx, dy, pace = P.phase_shift(first, last)
            how = "phase_correlation_crane_translation"
            if pace <= 0.0:
                dx, dy, pace = median_flow(first, last)
                how = "farneback_crane_translation"
        if pace / max(frames - 1, 1) < still:
            return 0.0, "static_detected"
        return round(crane_angle(dy, first.shape[0]), 4), how
    crop = P.centre if dark else lambda g: g
    if mean_flow(crop(first), crop(second)) < still:
        return 0.0, "static_detected"
    got = anchor_transform(crop(first), crop(last))
    if got is None and second_last is not None and frames >= 3:
        got = anchor_transform(crop(first), crop(second_last))
    if got is None:
        return None, "anchor_to_final_ransac"
    return round(abs(float(np.degrees(np.arctan2(got[1], got[0])))), 4), "anchor_to_final_ransac"
