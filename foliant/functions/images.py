"""Pixel arrays as binary columns: grey, resize, morphology, labels, contours and contrast by numpy."""

from __future__ import annotations

import numpy as np


def gray(image: np.ndarray, order: str = "rgb") -> np.ndarray:
    """Fixed-point luma of an 8-bit picture."""
    if image.ndim == 2:
        return image
    w = np.array([4899, 9617, 1868] if order == "rgb" else [1868, 9617, 4899], np.int64)
    return ((image[..., :3].astype(np.int64) @ w + 8192) >> 14).astype(np.uint8)


def contrast(image: np.ndarray) -> float:
    """Deviation over mean of the grey values, two places."""
    g = gray(image).astype(np.float64)
    return round(float(g.std() / (g.mean() + 1e-6)), 2)


def resize(image: np.ndarray, width: int, height: int, nearest: bool = False) -> np.ndarray:
    """Pixel-centred bilinear or nearest sampling."""
    h, w = image.shape[:2]
    y, x = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
    if nearest:
        return image[np.clip(np.floor(y + 0.5), 0, h - 1).astype(int)][:, np.clip(np.floor(x + 0.5), 0, w - 1).astype(int)]
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0).reshape(-1, 1, *[1] * (image.ndim - 2)), (x - x0).reshape(1, -1, *[1] * (image.ndim - 2))
    a = image.astype(np.float64)
    out = (a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx) * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy
    return np.clip(np.floor(out + 0.5), 0, 255).astype(image.dtype) if image.dtype == np.uint8 else out.astype(image.dtype)


def _slide(image: np.ndarray, kw: int, kh: int, f, fill) -> np.ndarray:
    padded = np.pad(image, ((kh // 2, kh - 1 - kh // 2), (kw // 2, kw - 1 - kw // 2)), constant_values=fill)
    windows = np.lib.stride_tricks.sliding_window_view(padded, (kh, kw))
    return f(windows, axis=(2, 3))


def morphology(image: np.ndarray, kw: int, kh: int, operation: str) -> np.ndarray:
    """erode, dilate, open or close with a rectangle; outside the picture counts for nothing."""
    erode = lambda m: _slide(m, kw, kh, np.min, 255)
    dilate = lambda m: _slide(m, kw, kh, np.max, 0)
    return {"erode": lambda: erode(image), "dilate": lambda: dilate(image), "open": lambda: dilate(erode(image)), "close": lambda: erode(dilate(image))}[operation]()


def labels(mask: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(count, labels from 1 in reading order, rows of x, y, width, height, area) of eight-connected parts."""
    on = mask > 0
    n = on.sum()
    ids = np.full(mask.shape, -1)
    ids[on] = np.arange(n)
    of = np.arange(n)
    pairs = []
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        a = ids[: mask.shape[0] - dy, max(0, -dx) : mask.shape[1] - max(0, dx)]
        b = ids[dy:, max(0, dx) : mask.shape[1] + min(0, dx)]
        both = (a >= 0) & (b >= 0)
        pairs.append(np.stack([a[both], b[both]], axis=1))
    edges = np.concatenate(pairs) if pairs else np.zeros((0, 2), int)
    while len(edges):
        a, b = of[edges[:, 0]], of[edges[:, 1]]
        off = a != b
        if not off.any():
            break
        np.minimum.at(of, np.maximum(a, b)[off], np.minimum(a, b)[off])
        while (of[of] != of).any():
            of = of[of]
    roots, part = np.unique(of, return_inverse=True)
    out = np.zeros(mask.shape, np.int32)
    out[on] = part + 1
    stats = []
    ys, xs = np.nonzero(on)
    for k in range(len(roots)):
        y, x = ys[part == k], xs[part == k]
        stats.append((x.min(), y.min(), np.ptp(x) + 1, np.ptp(y) + 1, len(x)))
    return len(roots), out, np.array(stats, np.int64).reshape(-1, 5)


def contour_area(points: np.ndarray) -> float:
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def contour_length(points: np.ndarray, closed: bool = True) -> float:
    d = np.diff(np.vstack([points, points[:1]]) if closed else points, axis=0)
    return float(np.hypot(d[:, 0], d[:, 1]).sum())


def simplify(points: np.ndarray, epsilon: float) -> np.ndarray:
    """Douglas-Peucker on an open line, without recursion."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, q = points[a].astype(float), points[b].astype(float)
        d, r = q - p, points[a + 1 : b].astype(float) - p
        n = np.hypot(*d)
        off = np.abs(d[0] * r[:, 1] - d[1] * r[:, 0]) / n if n else np.hypot(r[:, 0], r[:, 1])
        k = int(off.argmax())
        if off[k] > epsilon:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def perspective(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def transform(points: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    p = np.hstack([points, np.ones((len(points), 1))]) @ matrix.T
    return p[:, :2] / p[:, 2:] if matrix.shape[0] == 3 else p


def fill_polygon(shape: tuple[int, int], points: np.ndarray, value: int = 255) -> np.ndarray:
    """Pixels whose centre is inside, by even-odd crossings of each row."""
    out = np.zeros(shape, np.uint8)
    a, b = points.astype(float), np.roll(points, -1, axis=0).astype(float)
    for y in range(shape[0]):
        crosses = (a[:, 1] <= y) != (b[:, 1] <= y)
        xs = np.sort(a[crosses, 0] + (y - a[crosses, 1]) * (b[crosses, 0] - a[crosses, 0]) / (b[crosses, 1] - a[crosses, 1]))
        for lo, hi in zip(xs[::2], xs[1::2]):
            out[y, max(0, int(np.ceil(lo))) : max(0, int(np.floor(hi)) + 1)] = value
    return out
