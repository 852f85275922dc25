"""Numpy kernels on single frames and pairs of frames (arrays of 0..255, BGR or grey); definitions as published, no codecs."""

from __future__ import annotations

import numpy as np

FRAME = (1080, 1920)


def grey(frame: np.ndarray) -> np.ndarray:
    """Luma of a BGR frame in whole steps; a frame of one channel is grey already."""
    if frame.ndim == 2:
        return frame.astype(np.float64)
    if frame.shape[2] == 1:
        return frame[..., 0].astype(np.float64)
    return np.rint(frame[..., :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299]))


def colour(frame: np.ndarray) -> np.ndarray:
    """Three equal channels of a grey frame; others as they are."""
    grey_ = frame[..., None] if frame.ndim == 2 else frame
    return np.repeat(grey_, 3, axis=2) if grey_.shape[2] == 1 else grey_


def resize(frame: np.ndarray, height: int, width: int, area: bool = True) -> np.ndarray:
    """Bilinear, but the mean of covered pixels when shrinking with ``area``; equal sizes pass through."""
    h, w = frame.shape[:2]
    if (h, w) == (height, width):
        return frame

    def weights(n: int, m: int) -> np.ndarray:
        out = np.zeros((m, n))
        if m < n and area:
            edges = np.linspace(0, n, m + 1)
            for i in range(m):
                a, b = edges[i], edges[i + 1]
                lo, hi = int(a), min(n, int(np.ceil(b)))
                cover = np.minimum(np.arange(lo, hi) + 1, b) - np.maximum(np.arange(lo, hi), a)
                out[i, lo:hi] = cover / cover.sum()
        else:
            at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
            lo = np.floor(at).astype(int)
            hi = np.minimum(lo + 1, n - 1)
            out[np.arange(m), lo] += 1 - (at - lo)
            out[np.arange(m), hi] += at - lo
        return out

    rows, cols = weights(h, height), weights(w, width)
    if frame.ndim == 2:
        return rows @ frame @ cols.T
    return np.stack([rows @ frame[..., c] @ cols.T for c in range(frame.shape[2])], axis=2)


def normalise_frame(frame: np.ndarray, size: tuple[int, int] = FRAME) -> np.ndarray:
    """A frame at the size at which everything is measured."""
    return resize(frame, *size)


def dark_background(g: np.ndarray, threshold: float = 30.0, share: float = 0.40) -> bool:
    return float((g < threshold).mean()) > share


def centre(g: np.ndarray, fraction: float = 0.6) -> np.ndarray:
    h, w = g.shape
    dy, dx = int(h * (1 - fraction) / 2), int(w * (1 - fraction) / 2)
    return g[dy : h - dy or None, dx : w - dx or None]


def gaussian(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def blur(g: np.ndarray, size: int, sigma: float) -> np.ndarray:
    """Separable Gaussian with mirrored borders."""
    k, r = gaussian(size, sigma), size // 2
    mode = "reflect" if min(g.shape) > r else "edge"
    p = np.pad(g, r, mode=mode)
    p = sum(k[i] * p[i : i + g.shape[0], :] for i in range(size))
    return sum(k[i] * p[:, i : i + g.shape[1]] for i in range(size))


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Mean structural similarity, 11 x 11 Gaussian window of sigma 1.5."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    f = lambda x: blur(x, 11, 1.5)
    ma, mb = f(a), f(b)
    va, vb, vab = f(a * a) - ma * ma, f(b * b) - mb * mb, f(a * b) - ma * mb
    return float((((2 * ma * mb + c1) * (2 * vab + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def histogram_correlation(a: np.ndarray, b: np.ndarray, bins: int = 64) -> float:
    """Pearson correlation of the joint histograms of all channels, scaled to length 1 first."""

    def hist(f: np.ndarray) -> np.ndarray:
        channels = f.reshape(-1, f.shape[2]) if f.ndim == 3 else f.reshape(-1, 1)
        place = np.clip(channels * bins / 256, 0, bins - 1).astype(np.int64) @ (bins ** np.arange(channels.shape[1]))
        h = np.bincount(place, minlength=bins ** channels.shape[1]).astype(float)
        return h / max(np.linalg.norm(h), 1e-12)

    x, y = hist(a), hist(b)
    x, y = x - x.mean(), y - y.mean()
    d = np.sqrt((x @ x) * (y @ y))
    return float(x @ y / d) if d > 0 else 1.0


def bilateral_symmetry(g: np.ndarray) -> float | None:
    """Best likeness of two halves mirrored left-right or top-bottom, or of the frame and its transpose; null below 0.25."""
    h, w = g.shape
    n = min(h, w)
    likeness = lambda x, y: 1.0 - float(np.abs(x - y).mean()) / 255.0
    scores = [0.0]
    if w > 1:
        scores.append(likeness(g[:, : w // 2], g[:, w - w // 2 :][:, ::-1]))
    if h > 1:
        scores.append(likeness(g[: h // 2], g[h - h // 2 :][::-1]))
    if n > 10:
        square = resize(g, n, n, area=False)
        scores.append(likeness(square, square.T))
    best = max(scores)
    return best if best >= 0.25 else None


def otsu(g: np.ndarray) -> float:
    """The threshold with most variance between the two classes."""
    h = np.bincount(np.clip(g, 0, 255).astype(np.int64).ravel(), minlength=256).astype(float)
    n, total = h.cumsum(), (h * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (total[-1] * n / n[-1] - total) ** 2 / (n * (n[-1] - n))
    return float(np.nan_to_num(between).argmax())


def components(mask: np.ndarray, least: float = 0.0) -> int:
    """8-connected components of at least that share of the area, by union of row runs."""
    labels: list[int] = []

    def root(x: int) -> int:
        while labels[x] != x:
            labels[x] = labels[labels[x]]
            x = labels[x]
        return x

    runs, sizes = [], []
    above: list[tuple[int, int, int]] = []
    for row in mask.astype(bool):
        edges = np.flatnonzero(np.diff(np.r_[0, row.astype(np.int8), 0]))
        here = []
        for a, b in zip(edges[::2], edges[1::2]):
            labels.append(len(labels))
            sizes.append(int(b - a))
            me = len(labels) - 1
            for c, d, other in above:
                if c <= b and d >= a:
                    x, y = root(me), root(other)
                    labels[max(x, y)] = min(x, y)
            here.append((int(a), int(b), me))
        above = here
        runs += here
    area: dict[int, int] = {}
    for _, _, k in runs:
        area[root(k)] = area.get(root(k), 0) + sizes[k]
    return sum(v >= least * mask.size for v in area.values())


Region = tuple[float, float, float, float]


def region(g: np.ndarray, part: Region) -> np.ndarray:
    """The part of a frame between shares of its height and width (top, bottom, left, right)."""
    h, w = g.shape[:2]
    return g[int(h * part[0]) : int(h * part[1]), int(w * part[2]) : int(w * part[3])]


def via_holes(g: np.ndarray, part: Region = (0.1, 0.9, 0.1, 0.9)) -> int:
    """Dark blobs: components above Otsu's threshold of the inverted frame."""
    inverse = 255 - region(g, part)
    return components(inverse > otsu(inverse), 0.001)


def merged_components(g: np.ndarray, part: Region = (0.3, 0.7, 0.2, 0.8)) -> int:
    cut = region(g, part)
    return components(cut > otsu(cut), 0.002)


def edges(g: np.ndarray, low: float, high: float) -> np.ndarray:
    """Gradient edges: Sobel, thinning along the gradient, double threshold with linking."""
    p = np.pad(g, 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    m = np.abs(gx) + np.abs(gy)
    q = np.pad(m, 1)
    turn = (np.rad2deg(np.arctan2(gy, gx)) + 180) % 180
    shifts = {0: (q[1:-1, :-2], q[1:-1, 2:]), 45: (q[:-2, :-2], q[2:, 2:]), 90: (q[:-2, 1:-1], q[2:, 1:-1]), 135: (q[:-2, 2:], q[2:, :-2])}
    keep = np.zeros_like(m, bool)
    for angle, (a, b) in shifts.items():
        near = np.minimum(np.abs(turn - angle), 180 - np.abs(turn - angle)) <= 22.5
        keep |= near & (m >= a) & (m >= b)
    strong, weak = keep & (m > high), keep & (m > low)
    while True:
        s = np.pad(strong, 1)
        grown = weak & np.any([s[1 + dy : s.shape[0] - 1 + dy, 1 + dx : s.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        if (grown == strong).all():
            return strong
        strong = grown


def edge_components(g: np.ndarray, part: Region = (0.2, 0.8, 0.1, 0.9)) -> int:
    """Components of the closed edge map."""
    e = edges(region(g, part), 50, 150)
    p = np.pad(e, 1)
    grown = np.any([p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
    p = np.pad(grown, 1, constant_values=True)
    closed = np.all([p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
    return components(closed, 0.00015)


def spectral_peaks(g: np.ndarray) -> float:
    """Share of spectral energy of the edge map in what lies above the 97th percentile of magnitudes."""
    middle = float(np.median(g))
    e = edges(g, int(max(0.0, 0.66 * middle)), int(min(255.0, 1.33 * middle))) * 255.0
    m = np.abs(np.fft.fft2(e))
    energy = m**2
    total = energy.sum()
    return round(float(energy[m > np.percentile(m, 97.0)].sum() / total), 4) if total > 0 else 0.0


def gap_groups(at: np.ndarray, gap: int) -> int:
    """How many groups sorted positions form, a new one opening beyond ``gap`` from the last that opened one."""
    groups, last = 0, None
    for x in at.tolist():
        if last is None or x - last > gap:
            groups, last = groups + 1, x
    return groups


def polar_peaks(g: np.ndarray, bins: int = 360) -> int:
    """Groups of angles about the centre with more edge pixels than the mean and half a standard deviation."""
    h, w = g.shape
    y, x = np.nonzero(edges(g, 50, 150))
    if len(x) < 10:
        return 0
    counts, _ = np.histogram(np.arctan2(y - h // 2, x - w // 2), bins=bins, range=(-np.pi, np.pi))
    width = max(3, bins // 30) | 1
    smooth = np.convolve(counts, np.ones(width) / width, mode="same")
    return gap_groups(np.flatnonzero(smooth > smooth.mean() + 0.5 * smooth.std()), bins // 20)


def track_links(g: np.ndarray, part: Region = (0.55, 0.88, 0.05, 0.95), least: float = 0.3, gap: int = 5) -> int:
    """Groups of lags at which the column means of the edges correlate with themselves above ``least``."""
    line = (edges(region(g, part), 50, 150) * 255.0).mean(axis=0)
    if line.size == 0 or line.std() < 1e-6:
        return 0
    line = line - line.mean()
    r = np.correlate(line, line, "full")[len(line) - 1 :]
    return gap_groups(np.flatnonzero(r[1:] / (r[0] + 1e-8) > least), gap)


def trace_period(g: np.ndarray) -> float:
    """Dominant period, in pixels, of the column means over the centre half; 0 where there is none."""
    line = region(g, (0.25, 0.75, 0.25, 0.75)).mean(axis=0)
    if line.size < 2 or line.std() < 1e-6:
        return 0.0
    f = np.abs(np.fft.rfft(line - line.mean()))
    return float(len(line) / (int(f[1:].argmax()) + 1))


def top_frequencies(g: np.ndarray, k: int = 3, still: int = 5) -> np.ndarray:
    """The k strongest frequencies (vertical, horizontal, as shares of the highest) but the lowest ones, each blanking its neighbourhood."""
    f = np.abs(np.fft.fftshift(np.fft.fft2(g)))
    h, w = f.shape
    cy, cx, around = h // 2, w // 2, max(3, min(h, w) // 50)
    yy, xx = np.ogrid[:h, :w]
    f[(yy - cy) ** 2 + (xx - cx) ** 2 < still**2] = 0
    out: list[float] = []
    for _ in range(k):
        i, j = np.unravel_index(int(f.argmax()), f.shape)
        if f[i, j] <= 0:
            break
        out += [(i - cy) / (h / 2.0), (j - cx) / (w / 2.0)]
        f[max(0, i - around) : i + around + 1, max(0, j - around) : j + around + 1] = 0
    return np.array(out)


def blade_periodicity(g: np.ndarray) -> float:
    """Best share of 2 to 6 equal sectors in the harmonics around the centre, all radii together, times 5, at most 1."""
    h, w = g.shape
    cx, cy = w // 2, h // 2
    most = min(cx, cy, w - cx, h - cy) - 1
    if most < 10:
        return 0.0
    t = np.linspace(0, 2 * np.pi, 360, endpoint=False)
    r = np.arange(1, most)[:, None]
    rings = g[(cy + r * np.sin(t)).astype(int), (cx + r * np.cos(t)).astype(int)]
    harmonics = np.abs(np.fft.rfft(rings, axis=1))[:, 1:].sum(axis=0)
    return float(min(1.0, 5.0 * harmonics[1:6].max() / (harmonics.sum() + 1e-8)))


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dx, dy, length weighted by how clear the peak is) from one frame to the next, by phase correlation of windowed edge maps."""
    x, y = edges(a, 50, 150) * 255.0, edges(b, 50, 150) * 255.0
    if x.std() < 1e-6 or y.std() < 1e-6:
        return 0.0, 0.0, 0.0
    h, w = x.shape
    window = np.outer(np.hanning(h), np.hanning(w))
    f = np.fft.fft2(y * window) * np.conj(np.fft.fft2(x * window))
    r = np.fft.fftshift(np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)).real)
    i, j = np.unravel_index(int(r.argmax()), r.shape)
    rows, cols = np.arange(max(0, i - 2), min(h, i + 3)), np.arange(max(0, j - 2), min(w, j + 3))
    near = r[np.ix_(rows, cols)]
    clear = float(near.sum())
    if abs(clear) < 1e-12:
        return 0.0, 0.0, 0.0
    dy, dx = float((near.sum(axis=1) @ rows) / clear - h // 2), float((near.sum(axis=0) @ cols) / clear - w // 2)
    return dx, dy, abs(clear) * float(np.hypot(dx, dy))


#: Regions in which a track chain may show, the default first.
BANDS: tuple[Region, ...] = ((0.55, 0.88, 0.05, 0.95), (0.0, 0.3, 0.0, 1.0), (0.7, 1.0, 0.0, 1.0), (0.0, 1.0, 0.0, 0.4), (0.0, 1.0, 0.6, 1.0))


def band_correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How alike two frames are in each of the bands."""
    return np.array([roi_correlation(region(a, part), region(b, part)) for part in BANDS])


def rim_symmetry(g: np.ndarray, cy: float, cx: float, radius: float, samples: int = 36) -> float | None:
    """Evenness of brightness along a circle's rim; null with fewer than four samples inside the frame."""
    t = np.linspace(0, 2 * np.pi, samples, endpoint=False)
    y, x = (cy + radius * np.sin(t)).astype(int), (cx + radius * np.cos(t)).astype(int)
    inside = (y >= 0) & (y < g.shape[0]) & (x >= 0) & (x < g.shape[1])
    if inside.sum() < 4:
        return None
    v = g[y[inside], x[inside]]
    return float(1 - min(v.std() / (v.mean() + 1e-6), 1))


def roi_correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson correlation of two crops; 0 for flat ones and for negative values."""
    x, y = a.ravel() - a.mean(), b.ravel() - b.mean()
    if x.std() < 1e-6 or y.std() < 1e-6:
        return 0.0
    return max(0.0, float(x @ y / np.sqrt((x @ x) * (y @ y))))


def contour_points(g: np.ndarray, most: int = 2000) -> np.ndarray:
    """Edge pixels of the blurred frame as points scaled to it, thinned evenly to ``most``."""
    y, x = np.nonzero(edges(blur(g, 5, 1.1), 50, 150))
    p = np.stack([x / max(g.shape[1] - 1, 1), y / max(g.shape[0] - 1, 1)], 1)
    return p if len(p) <= most else p[np.linspace(0, len(p) - 1, most).astype(int)]


def chamfer_distance(a: np.ndarray, b: np.ndarray, block: int = 256) -> float:
    """Mean of both directions' mean nearest distances, in blocks of rows; inf for empty sets."""
    if not len(a) or not len(b):
        return float("inf")
    one = lambda p, q: np.mean(np.concatenate([np.sqrt(((p[i : i + block, None] - q[None]) ** 2).sum(2)).min(1) for i in range(0, len(p), block)]))
    return float((one(a, b) + one(b, a)) / 2)
