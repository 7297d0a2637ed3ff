"""Image kernels in NumPy for Arrow functions: transforms by name, edges, straight lines, scores."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def gray(img: np.ndarray) -> np.ndarray:
    """Luma of a BGR image; gray stays gray."""
    return img.astype(float) if img.ndim == 2 else img[..., 0] * 0.114 + img[..., 1] * 0.587 + img[..., 2] * 0.299


def stretch(x: np.ndarray) -> np.ndarray:
    lo, hi = float(x.min()), float(x.max())
    return np.zeros(x.shape, np.uint8) if hi <= lo else ((x - lo) * (255 / (hi - lo))).astype(np.uint8)


def _taps(sigma: float) -> np.ndarray:
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


def convolve(x: np.ndarray, k: np.ndarray, axis: int) -> np.ndarray:
    r = len(k) // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (r, r)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x.astype(float), pad, mode="edge"), len(k), axis=axis)
    return windows @ k


def blur(x: np.ndarray, sigma: float) -> np.ndarray:
    return convolve(convolve(x, _taps(sigma), 0), _taps(sigma), 1)


def gradients(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    smooth, diff = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    return convolve(convolve(x, smooth, 0), diff, 1), convolve(convolve(x, smooth, 1), diff, 0)


def extreme(x: np.ndarray, size: int, f: Callable) -> np.ndarray:
    r = size // 2
    return f(np.lib.stride_tricks.sliding_window_view(np.pad(x, r, mode="edge"), (size, size)), axis=(2, 3))


def top_hat(x: np.ndarray, size: int = 9) -> np.ndarray:
    return x - extreme(extreme(x, size, np.min), size, np.max)


def equalize(x: np.ndarray, tiles: int = 8, clip: float = 3.0) -> np.ndarray:
    """Histogram equalisation with clipped counts: a table per tile, blended between the centres of the four tiles around.

    Cells beyond the outermost centres take the nearest tables, so values have no step at the borders of tiles.
    """
    values = np.clip(x, 0, 255).astype(int)
    cuts = [np.unique(np.linspace(0, n, min(tiles, n) + 1).astype(int)) for n in x.shape]
    tables = np.empty((len(cuts[0]) - 1, len(cuts[1]) - 1, 256))
    for i, (y0, y1) in enumerate(zip(cuts[0], cuts[0][1:])):
        for j, (x0, x1) in enumerate(zip(cuts[1], cuts[1][1:])):
            h = np.bincount(values[y0:y1, x0:x1].ravel(), minlength=256).astype(float)
            most = max(1.0, clip * h.mean())
            h = np.minimum(h, most) + np.maximum(h - most, 0).sum() / 256
            tables[i, j] = h.cumsum() / h.sum() * 255

    def between(cut: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tile before and after each place, and the share of the latter."""
        at = np.interp(np.arange(n) + 0.5, (cut[:-1] + cut[1:]) / 2, np.arange(len(cut) - 1))
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, len(cut) - 2), at - low

    (i0, i1, v), (j0, j1, u) = (between(c, n) for c, n in zip(cuts, x.shape))
    of = lambda i, j: tables[i[:, None], j[None, :], values]
    v, u = v[:, None], u[None, :]
    return (1 - v) * ((1 - u) * of(i0, j0) + u * of(i0, j1)) + v * ((1 - u) * of(i1, j0) + u * of(i1, j1))


def ridge(x: np.ndarray, scales: tuple[float, ...] = (1.0, 2.0, 3.0, 4.0), beta: float = 0.5, gamma: float | None = None) -> np.ndarray:
    """Bright ridges from 0 to 255: the largest response over scales of the Hessian's eigenvalues, saturating at its 95th percentile.

    At each scale the smaller eigenvalue over the larger tells lines from blobs (beta), and their length tells structure from
    noise (gamma, half its largest value unless given). Second derivatives are scaled by the square of the width.
    """
    best = np.zeros(x.shape)
    for sigma in scales:
        b = blur(x.astype(float) / 255, sigma)
        gy, gx = np.gradient(b)
        yy, yx = np.gradient(gy)
        xx = np.gradient(gx, axis=1)
        yy, yx, xx = (d * sigma * sigma for d in (yy, yx, xx))
        mean, root = (xx + yy) / 2, np.sqrt(((xx - yy) / 2) ** 2 + yx**2)
        low, high = mean - root, mean + root
        large = np.where(np.abs(low) >= np.abs(high), low, high)
        small = np.where(np.abs(low) >= np.abs(high), high, low)
        size = np.hypot(large, small)
        noise = gamma or size.max() / 2
        if noise <= 0:
            continue
        ratio = small / np.where(large == 0, 1, large)
        response = np.exp(-(ratio**2) / (2 * beta**2)) * (1 - np.exp(-(size**2) / (2 * noise**2)))
        best = np.maximum(best, np.where(large < 0, response, 0))
    top = float(np.percentile(best, 95)) if best.size else 0.0
    return np.clip(best / (top if top > 0 else 1e-6), 0, 1) * 255


def _bgr(img: np.ndarray) -> tuple[np.ndarray, ...]:
    x = img.astype(float)
    return (x, x, x) if x.ndim == 2 else (x[..., 0], x[..., 1], x[..., 2])


def _lab(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b, g, r = (np.where(c <= 10.31475, c / 3294.6, ((c / 255 + 0.055) / 1.055) ** 2.4) for c in _bgr(img))
    y, z = 0.2126 * r + 0.7152 * g + 0.0722 * b, (0.0193 * r + 0.1192 * g + 0.9505 * b) / 1.0888
    f = lambda t: np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return 116 * f(y) - 16, 200 * (f(y) - f(z))


def _ratio(img: np.ndarray) -> np.ndarray:
    b, _, r = _bgr(img)
    return (r - b) / np.maximum(r + b, 1)


def _unsaturated(img: np.ndarray) -> np.ndarray:
    top, low = np.max(_bgr(img), axis=0), np.min(_bgr(img), axis=0)
    return 255 * (1 - (top - low) / np.maximum(top, 1))


def _cross(x: np.ndarray) -> np.ndarray:
    gx, gy = gradients(x)
    return np.hypot(gx, gy)


def across(x: np.ndarray, v: tuple[float, float] | None, gain: float = 2.0) -> np.ndarray:
    """Gradient at right angles to the direction of flight; without one, flight is taken to be level."""
    vx, vy = v if v and math.hypot(*v) > 0.1 else (1.0, 0.0)
    gx, gy = gradients(x)
    return np.clip(np.abs(gy * vx - gx * vy) * gain, 0, 255)


def top_hat_along(x: np.ndarray, v: tuple[float, float] | None, length: int = 81, width: int = 5) -> np.ndarray:
    """What is brighter than its surroundings along a bar of length by width cells that lies in the direction of flight."""
    vx, vy = v if v and math.hypot(*v) > 0.1 else (1.0, 0.0)
    n = math.hypot(vx, vy)
    along, aside = np.arange(-(length // 2), length // 2 + 1), np.arange(-(width // 2), width // 2 + 1)
    steps = {(round((a * vy + b * vx) / n), round((a * vx - b * vy) / n)) for a in along for b in aside}
    r = max(max(abs(dy), abs(dx)) for dy, dx in steps)

    def over(y: np.ndarray, f: Callable) -> np.ndarray:
        padded, out = np.pad(y, r, mode="edge"), None
        for dy, dx in steps:
            part = padded[r + dy : r + dy + y.shape[0], r + dx : r + dx + y.shape[1]]
            out = part if out is None else f(out, part)
        return out

    return x - over(over(x, np.minimum), np.maximum)


#: Transforms by name: each takes (image, previous image or None, direction of flight or None).
TRANSFORMS: dict[str, Callable[..., np.ndarray]] = {
    "bgr": lambda i, p, v=None: gray(i),
    "nrbr": lambda i, p, v=None: _ratio(i),
    "hsv_sat_inv": lambda i, p, v=None: _unsaturated(i),
    "lab_L": lambda i, p, v=None: _lab(i)[0],
    "lab_b": lambda i, p, v=None: _lab(i)[1],
    "grey_excess": lambda i, p, v=None: np.min(_bgr(i), axis=0) / (np.max(_bgr(i), axis=0) + 1),
    "local_contrast": lambda i, p, v=None: gray(i) - blur(gray(i), 8.0),
    "dog": lambda i, p, v=None: blur(gray(i), 1.0) - blur(gray(i), 3.0),
    "tophat": lambda i, p, v=None: top_hat(gray(i)),
    "tophat_oriented": lambda i, p, v=None: top_hat_along(gray(i), v),
    "clahe": lambda i, p, v=None: equalize(gray(i)),
    "cross_grad": lambda i, p, v=None: across(gray(i), v),
    "temporal_diff": lambda i, p, v=None: np.zeros(i.shape[:2]) if p is None else np.abs(gray(i) - gray(p)),
    "frangi": lambda i, p, v=None: ridge(gray(i)),
}


def apply_chain(img: np.ndarray, names: list[str], previous: np.ndarray | None = None, vector: tuple[float, float] | None = None) -> np.ndarray:
    """Known transforms one after the other, each stretched to 0 to 255; unknown names are skipped."""
    for name in names:
        if name in TRANSFORMS:
            img = stretch(TRANSFORMS[name](img, previous, vector))
            previous = None if previous is None else gray(previous)
    return img


def edges(x: np.ndarray, low: float = 85.0, high: float = 97.0, floor: float = 20.0) -> np.ndarray:
    """Edge cells: gradient over the high percentile, or over the low one beside such a cell."""
    m = _cross(blur(gray(x), 1.0))
    strong, weak = m > max(floor, np.percentile(m, high)), m > max(floor / 2, np.percentile(m, low))
    return strong | (weak & (extreme(strong.astype(np.uint8), 3, np.max) > 0))


def lines(edge: np.ndarray, least: int = 20, angles: int = 180, most: int = 8, gap: float = 10.0) -> list[tuple[float, float, float, float]]:
    """Straight runs of edge cells by a Hough vote over all cells: (x1, y1, x2, y2), strongest line first; nothing is random.

    The cells on the line with the most votes are put in order along it and split where they are more than `gap` apart; a run
    of length `least` or more is a segment whose ends are cells of it. The cells of a segment and beside it withdraw their
    votes, so what is left of a line, or crosses it, is found by itself. A line without such a run is not asked again.
    """
    ys, xs = np.nonzero(edge)
    if not len(xs):
        return []
    theta = np.deg2rad(np.arange(angles) * 180 / angles)
    rho = np.rint(np.outer(xs, np.cos(theta)) + np.outer(ys, np.sin(theta))).astype(int)
    base = rho.min()
    rho -= base
    votes, every = np.zeros((rho.max() + 1, angles), int), np.arange(angles)
    np.add.at(votes, (rho, every[None, :].repeat(len(xs), 0)), 1)
    left, out = np.ones(len(xs), bool), []
    while len(out) < most:
        r, a = np.unravel_index(int(votes.argmax()), votes.shape)
        if votes[r, a] < least:
            break
        along = -xs * np.sin(theta[a]) + ys * np.cos(theta[a])
        on = np.flatnonzero(left & (np.abs(rho[:, a] - r) <= 1))
        on = on[np.argsort(along[on], kind="stable")]
        runs = [run for run in np.split(on, np.flatnonzero(np.diff(along[on]) > gap) + 1) if along[run[-1]] - along[run[0]] >= least]
        if not runs:
            votes[r, a] = -len(xs) - 1
            continue
        for run in sorted(runs, key=lambda run: along[run[0]] - along[run[-1]])[: most - len(out)]:
            i, j = run[0], run[-1]
            out.append((float(xs[i]), float(ys[i]), float(xs[j]), float(ys[j])))
            gone = np.flatnonzero(left & (np.abs(rho[:, a] - r) <= 3) & (along >= along[i]) & (along <= along[j]))
            np.subtract.at(votes, (rho[gone], every[None, :].repeat(len(gone), 0)), 1)
            left[gone] = False
    return out


def examine(img: np.ndarray, heading: float | None = None, tolerance: float = 15.0, mask: np.ndarray | None = None, excluded: tuple | None = None, **kw) -> dict:
    """All that a detection rests on: edges, lines, aligned lines (off the heading left out), the longest of them and its length.

    excluded is (y0, y1, x0, x1) in the crop's cells, such as a burned-in clock; nothing there counts, nor in the mask.
    """
    e = edges(img)
    if mask is not None:
        e &= ~mask
    if excluded:
        y0, y1, x0, x1 = (max(0, int(v)) for v in excluded)
        e[y0:y1, x0:x1] = False
    found = lines(e, **kw)
    angle = lambda x: math.degrees(math.atan2(x[3] - x[1], x[2] - x[0])) % 180
    apart = lambda a, b: min(abs(a - b) % 180, 180 - abs(a - b) % 180)
    fit = [x for x in found if heading is None or apart(angle(x), heading % 180) <= tolerance]
    best = max(fit, key=lambda x: math.hypot(x[2] - x[0], x[3] - x[1]), default=None)
    return {"edges": e, "lines": found, "aligned": fit, "best": best, "length": math.hypot(best[2] - best[0], best[3] - best[1]) if best else 0.0}


def detect(img: np.ndarray, heading: float | None = None, norm: float = 200.0, **kw) -> dict:
    """score, pixel_line, num_long_lines, aligned_lines of one crop, from what examine() finds."""
    x = examine(img, heading, **kw)
    return {"score": min(1.0, x["length"] / norm), "pixel_line": list(x["best"]) if x["best"] else None, "num_long_lines": len(x["lines"]), "aligned_lines": len(x["aligned"])}


def grown_length(measure: Callable[[int], float], start: int, step: int, most: int) -> float:
    """Largest span while growing the region: stop when it no longer increases."""
    best, size = measure(start), start + step
    while size <= most:
        now = measure(size)
        if now <= best:
            break
        best, size = now, size + step
    return best
