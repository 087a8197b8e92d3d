"""Raster kernels on numpy arrays: filters, edges, masks, components and line segments of one tile."""

from __future__ import annotations

import numpy as np


def gray(bgr: np.ndarray) -> np.ndarray:
    return np.rint(bgr @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue 0-179, saturation and value 0-255."""
    b, g, r = (bgr[..., i].astype(float) for i in range(3))
    v, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    d = v - low
    safe = np.where(d == 0, 1, d)
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60
    return np.stack([np.where(d == 0, 0, h % 360) / 2, np.where(v == 0, 0, d / np.where(v == 0, 1, v)) * 255, v], -1)


def _around(img: np.ndarray, radius: int, mode: str = "reflect") -> np.ndarray:
    """All shifts of an image: axis 0 runs over the (2r+1)^2 neighbours."""
    p = np.pad(img, radius, mode=mode)
    h, w = img.shape
    k = 2 * radius + 1
    return np.stack([p[i : i + h, j : j + w] for i in range(k) for j in range(k)])


def gaussian(img: np.ndarray, size: int = 5, sigma: float = 1.5) -> np.ndarray:
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()
    p = np.pad(img.astype(float), size // 2, mode="reflect")
    rows = sum(k[i] * p[i : i + img.shape[0], :] for i in range(size))
    return sum(k[i] * rows[:, i : i + img.shape[1]] for i in range(size))


def median(img: np.ndarray, size: int = 3) -> np.ndarray:
    return np.median(_around(img, size // 2, "edge"), axis=0).astype(img.dtype)


def bilateral(img: np.ndarray, radius: int = 4, color: float = 75.0, space: float = 75.0) -> np.ndarray:
    near = _around(img.astype(float), radius)
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    w = np.exp(-(x**2 + y**2).reshape(-1, 1, 1) / (2 * space**2)) * np.exp(-((near - img) ** 2) / (2 * color**2))
    return (w * near).sum(0) / w.sum(0)


def box_mean(img: np.ndarray, size: int) -> np.ndarray:
    p = np.pad(img.astype(float), size // 2, mode="edge")
    c = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = img.shape
    return (c[size : size + h, size : size + w] - c[:h, size : size + w] - c[size : size + h, :w] + c[:h, :w]) / size**2


def dilate(mask: np.ndarray, rows: int, cols: int) -> np.ndarray:
    p = np.pad(mask, ((rows // 2, (rows - 1) // 2), (cols // 2, (cols - 1) // 2)))
    h, w = mask.shape
    out = np.zeros_like(mask)
    for i in range(rows):
        for j in range(cols):
            out |= p[i : i + h, j : j + w]
    return out


def erode(mask: np.ndarray, rows: int, cols: int) -> np.ndarray:
    return ~dilate(~mask, rows, cols)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of 8-connected components, 0 outside: least index spreads until nothing changes."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    big = h * w + 1
    while True:
        near = np.where(_around(label, 1, "constant") == 0, big, _around(label, 1, "constant")).min(0)
        new = np.where(mask, near, 0)
        root = np.where(mask, new.ravel()[np.maximum(new, 1) - 1], 0)  # jump to the label's own label
        new = np.where(mask, np.minimum(new, np.where(root == 0, big, root)), 0)
        if (new == label).all():
            return label
        label = new


def component_stats(label: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(label, area, width, height)."""
    y, x = np.nonzero(label)
    out = []
    for k in np.unique(label[y, x]):
        m = label[y, x] == k
        out.append((int(k), int(m.sum()), int(np.ptp(x[m]) + 1), int(np.ptp(y[m]) + 1)))
    return out


def canny(img: np.ndarray, low: float, high: float) -> np.ndarray:
    """Sobel gradient (L1), thinning along its direction, two thresholds joined by components."""
    p = np.pad(img.astype(float), 1, mode="edge")
    s = lambda i, j: p[i : i + img.shape[0], j : j + img.shape[1]]
    gx = s(0, 2) + 2 * s(1, 2) + s(2, 2) - s(0, 0) - 2 * s(1, 0) - s(2, 0)
    gy = s(2, 0) + 2 * s(2, 1) + s(2, 2) - s(0, 0) - 2 * s(0, 1) - s(0, 2)
    mag = np.abs(gx) + np.abs(gy)
    sector = (np.floor((np.degrees(np.arctan2(gy, gx)) % 180 + 22.5) / 45) % 4).astype(int)
    m = np.pad(mag, 1)
    at = lambda dy, dx: m[1 + dy : 1 + dy + mag.shape[0], 1 + dx : 1 + dx + mag.shape[1]]
    keep = np.zeros(mag.shape, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        keep |= (sector == k) & (mag > at(-dy, -dx)) & (mag >= at(dy, dx))
    weak = keep & (mag > low)
    label = components(weak)
    return weak & np.isin(label, np.unique(label[weak & (mag > high)]))


def segments(edges: np.ndarray, threshold: int, min_length: float, max_gap: int) -> list[tuple[int, int, int, int]]:
    """Straight segments: Hough votes at 1 pixel and 1 degree, strongest line first; the pixels of a
    line are walked in order, cut at gaps, and taken out of the votes. Deterministic."""
    y, x = np.nonzero(edges)
    left, out = np.ones(len(x), bool), []
    theta = np.radians(np.arange(180))
    rho = np.rint(np.outer(x, np.cos(theta)) + np.outer(y, np.sin(theta))).astype(int)
    off = int(np.abs(rho).max(initial=0))
    votes = np.zeros((2 * off + 1, 180), int)
    np.add.at(votes, (rho + off, np.arange(180)), 1)
    while left.any():
        r, t = np.unravel_index(int(votes.argmax()), votes.shape)
        if votes[r, t] < threshold:
            break
        on = np.flatnonzero(left & (np.abs(rho[:, t] + off - r) <= 1))
        along = -x[on] * np.sin(theta[t]) + y[on] * np.cos(theta[t])
        on = on[np.argsort(along, kind="stable")]
        along = np.sort(along)
        for run in np.split(np.arange(len(on)), np.flatnonzero(np.diff(along) > max_gap) + 1):
            a, b = on[run[0]], on[run[-1]]
            if np.hypot(x[b] - x[a], y[b] - y[a]) >= min_length:
                out.append((int(x[a]), int(y[a]), int(x[b]), int(y[b])))
        left[on] = False
        np.subtract.at(votes, (rho[on] + off, np.arange(180)), 1)
        votes[r, t] = 0
    return out


def simplify(pts: np.ndarray, eps: float) -> np.ndarray:
    """Douglas-Peucker."""
    if len(pts) < 3:
        return pts
    a, b = pts[0], pts[-1]
    d = b - a
    n = np.hypot(*d)
    off = np.abs(d[0] * (pts[:, 1] - a[1]) - d[1] * (pts[:, 0] - a[0])) / n if n else np.hypot(*(pts - a).T)
    k = int(off.argmax())
    if off[k] <= eps:
        return np.array([a, b])
    return np.concatenate([simplify(pts[: k + 1], eps)[:-1], simplify(pts[k:], eps)])


def corners(ring: np.ndarray, share: float = 0.02) -> np.ndarray:
    """Vertices that stay when a ring (not repeated at its end) is simplified by a share of its length: both chains
    between two vertices far apart."""
    length = np.hypot(*(np.roll(ring, -1, 0) - ring).T).sum()
    far = lambda p: int(np.hypot(*(ring - p).T).argmax())
    i = far(ring[0])
    ring = np.roll(ring, -i, 0)
    j = far(ring[0])
    one, two = simplify(ring[: j + 1], share * length), simplify(np.concatenate([ring[j:], ring[:1]]), share * length)
    return np.concatenate([one[:-1], two[:-1]])


def has_three_corners(ring: np.ndarray, extent: float = 400.0, least: float = 5.0, most: float = 175.0) -> bool:
    """Whether a ring scaled to one extent on both axes has three corners, of `least` to `most` degrees each."""
    size = np.ptp(ring, axis=0)
    if len(ring) < 3 or (size <= 0).any():
        return False
    v = corners((ring - ring.min(0)) / size * extent)
    if len(v) != 3:
        return False
    to, back = np.roll(v, -1, 0) - v, np.roll(v, 1, 0) - v
    cosine = (to * back).sum(1) / (np.hypot(*to.T) * np.hypot(*back.T))
    angle = np.degrees(np.arccos(np.clip(cosine, -1, 1)))
    return bool((angle >= least).all() and (angle <= most).all() and 160 < angle.sum() < 200)


def linearity(pts: np.ndarray) -> float:
    """1 - mean / greatest distance from the least-squares line, in [0, 1]; 0 for under 3 points, 1 on a line."""
    if len(pts) < 3:
        return 0.0
    c = pts - pts.mean(0)
    v = np.linalg.svd(c, full_matrices=False)[2][0]
    d = np.abs(c[:, 0] * v[1] - c[:, 1] * v[0])
    return float(np.clip(1 - d.mean() / d.max(), 0, 1)) if d.max() > 1e-9 else 1.0


def is_straight(pts: np.ndarray, most: float = 15.0) -> bool:
    """Mean angle of consecutive steps against the chord, modulo 180, under most; at least 10 points."""
    if len(pts) < 10:
        return False
    turn = lambda d: np.degrees(np.arctan2(d[..., 1], d[..., 0]))
    diff = np.abs(turn(np.diff(pts, axis=0)) - turn(pts[-1] - pts[0])) % 180
    return float(np.minimum(diff, 180 - diff).mean()) < most


def white_mask(bgr: np.ndarray) -> np.ndarray:
    """White regions: a value threshold that follows the mean, gray and smoothed thresholds, and local means."""
    g, h = gray(bgr), hsv(bgr)
    smooth = bilateral(g)
    v = min(220.0, max(180.0, h[..., 2].mean() + 20))
    out = (h[..., 2] >= v) & (h[..., 1] <= 40)
    out |= (g > 170) | (smooth > 200) | (bgr.min(-1) > 180)
    return out | ((g > box_mean(g, 31) + 4) & (g > 150)) | ((g > gaussian(g, 21, 3.5) + 3) & (g > 150))


def clean_mask(mask: np.ndarray, least_area: int = 30, least_aspect: float = 2.0) -> np.ndarray:
    m = median(mask.astype(np.uint8) * 255) > 127
    m = dilate(erode(m, 2, 2), 2, 2)
    m = erode(dilate(m, 3, 3), 3, 3)
    m = dilate(m, 1, 2)
    label = components(m)
    good = [k for k, area, w, h in component_stats(label) if area >= least_area and max(w, h) / min(w, h) >= least_aspect]
    return gaussian(np.isin(label, good).astype(float) * 255) > 128


def straight_edges(bgr: np.ndarray, low: float = 50, high: float = 150, min_linearity: float = 0.7, min_length: float = 30) -> list[tuple[int, int, int, int]]:
    """Edges of a tile whose components are long and straight, as segments."""
    edges = canny(gaussian(gray(bgr)), low, high)
    label = components(edges)
    keep = np.zeros(edges.shape, bool)
    for k, area, w, h in component_stats(label):
        if area < min_length:
            continue
        y, x = np.nonzero(label == k)
        pts = np.stack([x, y], 1).astype(float)
        pts = pts[np.argsort(pts[:, 0] if w >= h else pts[:, 1], kind="stable")]
        if (linearity(pts) > min_linearity and max(w, h) / min(w, h) > 2) or is_straight(pts):
            keep |= label == k
    return segments(keep, 20, min_length, 10)


def marking_lines(bgr: np.ndarray, min_length: float = 20) -> list[tuple[int, int, int, int]]:
    """Segments along the edges of white markings."""
    mask = clean_mask(white_mask(bgr))
    return segments(canny(mask.astype(float) * 255, 30, 100), 25, min_length, 15)


def strip_cover(p: tuple, q: tuple, lines: list, width: float, n: int = 256) -> float:
    """Area within `width` of a set of segments, by scan lines: each capsule meets a scan line in one interval."""
    if not lines:
        return 0.0
    y = np.linspace(p[1], q[1], n + 1)[:-1] + (q[1] - p[1]) / (2 * n)
    total = 0.0
    for yy in y:
        spans = sorted(s for s in (_capsule(seg, yy, width) for seg in lines) if s)
        end = -np.inf
        for lo, hi in spans:
            total += max(0.0, hi - max(lo, end))
            end = max(end, hi)
    return total * (q[1] - p[1]) / n


def _capsule(seg, y: float, r: float):
    """Interval of x where (x, y) lies within r of a segment, or None."""
    (ax, ay), (bx, by) = seg
    xs = []
    for cx, cy in ((ax, ay), (bx, by)):
        if abs(y - cy) <= r:
            d = np.sqrt(r * r - (y - cy) ** 2)
            xs += [cx - d, cx + d]
    n = np.hypot(bx - ax, by - ay)
    if n:
        ux, uy = (bx - ax) / n, (by - ay) / n
        for sign in (1, -1):
            ox, oy = ax - sign * uy * r, ay + sign * ux * r
            if abs(uy) > 1e-12:
                t = (y - oy) / uy
                if 0 <= t <= n:
                    xs.append(ox + t * ux)
            elif abs(y - oy) < 1e-12:
                xs += [ox, ox + n * ux]
        if abs(uy) <= 1e-12 and abs(y - ay) <= r:
            xs += [ax, bx]
    return (min(xs), max(xs)) if xs else None


def buffer_iou(a: list[tuple], b: list[tuple], r: float) -> float:
    """Intersection over union of the round buffers of two lines."""
    sa, sb = list(zip(a, a[1:], strict=False)), list(zip(b, b[1:], strict=False))
    ys = [p[1] for p in [*a, *b]]
    p, q = (0, min(ys) - r), (0, max(ys) + r)
    one, two, both = strip_cover(p, q, sa, r), strip_cover(p, q, sb, r), strip_cover(p, q, sa + sb, r)
    return (one + two - both) / both if both else 0.0


def closed_region(rings: list[list[tuple]], grow: float, shrink: float, cell: float) -> tuple[np.ndarray, float, float]:
    """Union of polygons grown then shrunk, holes filled, as a mask on a grid; (mask, x0, y0). Off by one cell at most."""
    pts = np.array([p for ring in rings for p in ring])
    x0, y0 = pts.min(0) - 2 * grow - cell
    w, h = np.ceil((pts.max(0) - pts.min(0) + 4 * grow + 2 * cell) / cell).astype(int) + 1
    gx, gy = x0 + (np.arange(w) + 0.5) * cell, y0 + (np.arange(h) + 0.5) * cell
    inside = np.zeros((h, w), bool)
    for ring in rings:
        hit = np.zeros((h, w), bool)
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            rows = (ay > gy) != (by > gy)
            if rows.any():
                cut = (bx - ax) * (gy[rows] - ay) / (by - ay) + ax
                hit[rows] ^= gx[None, :] < cut[:, None]
        inside |= hit
    disc = lambda m, r: _disc(m, int(round(r / cell)))
    m = ~disc(~disc(inside, grow), shrink)
    outside = components(~m)
    return m | ((outside != outside[0, 0]) & ~m), float(x0), float(y0)


def _disc(mask: np.ndarray, r: int) -> np.ndarray:
    out = mask.copy()
    for dy in range(-r, r + 1):
        k = int(np.sqrt(r * r - dy * dy))
        rows = np.zeros_like(mask)
        src = mask[max(0, -dy) : mask.shape[0] - max(0, dy)]
        rows[max(0, dy) : mask.shape[0] - max(0, -dy)] = src
        out |= dilate(rows, 1, 2 * k + 1)
    return out
