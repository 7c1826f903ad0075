"""Image kernels in NumPy, for use inside tasks. Images are (H, W) or (H, W, C) arrays; conventions are in each docstring."""

from __future__ import annotations

import numpy as np


def _axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-pixel centres: the two source indices and the weight of the second for each of ``m`` outputs."""
    at = (np.arange(m) + 0.5) * n / m - 0.5
    low = np.floor(at)
    return np.maximum(low, 0).astype(int), np.minimum(np.ceil(at), n - 1).astype(int), at - low


def _like(weights: np.ndarray, image: np.ndarray) -> np.ndarray:
    """Weights in single precision for an image in single precision, which then stays so."""
    return weights.astype(np.float32) if image.dtype == np.float32 else weights


def resize_bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Separable linear interpolation, no antialiasing, edges clamped; an image of that size already is itself."""
    if image.shape[:2] == (height, width):
        return image.astype(np.result_type(image.dtype, np.float32 if image.dtype == np.float32 else np.float64), copy=False)
    y0, y1, wy = _axis(image.shape[0], height)
    x0, x1, wx = _axis(image.shape[1], width)
    tail = (1,) * (image.ndim - 2)
    wy, wx = _like(wy, image).reshape(-1, 1, *tail), _like(wx, image).reshape(1, -1, *tail)
    top = image[y0][:, x0] * (1 - wx) + image[y0][:, x1] * wx
    bottom = image[y1][:, x0] * (1 - wx) + image[y1][:, x1] * wx
    return top * (1 - wy) + bottom * wy


def resize_nearest(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Source index floor((i + 0.5) * n / m)."""
    pick = lambda n, m: np.minimum(((np.arange(m) + 0.5) * n / m).astype(int), n - 1)
    return image[pick(image.shape[0], height)][:, pick(image.shape[1], width)]


def pad(image: np.ndarray, size: int) -> np.ndarray:
    """Zeros at the bottom and right up to ``size``."""
    extra = [(0, max(0, size - n)) for n in image.shape[:2]] + [(0, 0)] * (image.ndim - 2)
    return np.pad(image, extra)


def rotate(image: np.ndarray, angle: float, nearest: bool = False) -> np.ndarray:
    """Rotation about (W/2, H/2) by the map from output to input; coordinates outside are mirrored, the edge repeated."""
    h, w = image.shape[:2]
    cos, sin = np.cos(angle), np.sin(angle)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    u = cos * (x - w / 2) - sin * (y - h / 2) + w / 2
    v = sin * (x - w / 2) + cos * (y - h / 2) + h / 2

    def inside(c: np.ndarray, n: int) -> np.ndarray:
        c = np.mod(c, 2 * n)
        return np.clip(np.where(c >= n, 2 * n - c - 1, c), 0, n - 1)

    def mirrored(c: np.ndarray, n: int) -> np.ndarray:
        return inside(np.where(c < 0, -c - 1, c), n)

    u, v = mirrored(u, w), mirrored(v, h)
    if nearest:
        return image[np.floor(v + 0.5).astype(int).clip(0, h - 1), np.floor(u + 0.5).astype(int).clip(0, w - 1)]
    x0, y0 = np.floor(u).astype(int), np.floor(v).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = _like(u - x0, image), _like(v - y0, image)
    if image.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    top = image[y0, x0] * (1 - fx) + image[y0, x1] * fx
    bottom = image[y1, x0] * (1 - fx) + image[y1, x1] * fx
    return top * (1 - fy) + bottom * fy


def _shifted(image: np.ndarray, dy: int, dx: int, fill: float) -> np.ndarray:
    """``out[y, x] = image[y + dy, x + dx]``, ``fill`` outside."""
    h, w = image.shape[:2]
    out = np.full_like(image, fill)
    ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    if ys.start < ys.stop and xs.start < xs.stop:
        out[ys, xs] = image[ys.start + dy : ys.stop + dy, xs.start + dx : xs.stop + dx]
    return out


def blur(image: np.ndarray, sigma: float, inside: np.ndarray | None = None) -> np.ndarray:
    """A normalised 5x5 Gaussian with zeros outside, so edges darken; clipped to [0, 1]. Columns first, then rows;
    pixels that aren't ``inside`` (and are zero) get no sum of their column."""
    g = np.exp(-(np.arange(-2, 3) ** 2) / (2.0 * sigma * sigma))
    g /= g.sum()
    rows = sum(g[d + 2] * _shifted(image, d, 0, 0.0) for d in range(-2, 3))
    rows = rows if inside is None else rows * inside.reshape(inside.shape + (1,) * (rows.ndim - 2))
    return np.clip(sum(g[d + 2] * _shifted(rows, 0, d, 0.0) for d in range(-2, 3)), 0.0, 1.0)


def sobel(plane: np.ndarray) -> np.ndarray:
    """|Gx| + |Gy| of the 3x3 Sobel kernels with zeros outside."""
    at = {(dy, dx): _shifted(plane, dy, dx, 0.0) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
    gx = sum(k * (at[dy, 1] - at[dy, -1]) for dy, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (at[1, dx] - at[-1, dx]) for dx, k in ((-1, 1), (0, 2), (1, 1)))
    return np.abs(gx) + np.abs(gy)


def _extent(k: int) -> range:
    return range(-(k // 2), k - k // 2)


def dilate(mask: np.ndarray, k: int) -> np.ndarray:
    """Maximum over the offsets -(k//2) ... k-1-(k//2) in both directions; outside never wins."""
    out = np.zeros_like(mask)
    for d in _extent(k):
        out |= _shifted(mask, d, 0, False)
    rows, out = out, np.zeros_like(mask)
    for d in _extent(k):
        out |= _shifted(rows, 0, d, False)
    return out


def erode(mask: np.ndarray, k: int) -> np.ndarray:
    """Minimum over the same offsets; outside never wins."""
    return ~dilate(~mask, k)


def morph_open(mask: np.ndarray, k: int = 2, inside: np.ndarray | bool = True) -> np.ndarray:
    """Erosion, then dilation. Both use the same offsets, so an even ``k`` shifts by one, as documented for the common
    imaging library; it isn't installed here to compare with. Pixels that aren't ``inside`` never win."""
    return dilate(erode(mask | np.logical_not(inside), k) & inside, k)


def morph_close(mask: np.ndarray, k: int = 5, inside: np.ndarray | bool = True) -> np.ndarray:
    return erode(dilate(mask & inside, k) | np.logical_not(inside), k)


def components(mask: np.ndarray) -> np.ndarray:
    """8-connected labels: the smallest row-major index of each component, -1 outside.

    Works on the runs of the rows: runs of adjacent rows that touch are joined, then labels fall to the minimum by
    hooking and pointer jumping.
    """
    h, w = mask.shape
    label = np.full(h * w, -1, np.int64)
    framed = np.zeros((h, w + 1), np.int8)
    framed[:, :w] = mask
    edge = np.diff(framed.ravel(), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # in the framed image, end exclusive
    if not len(begin):
        return label.reshape(h, w)
    # a run touches those of the row above whose columns reach from its begin - 1 to its end
    above = begin - (w + 1)
    first = np.searchsorted(end, above, "left")
    last = np.searchsorted(begin, end - (w + 1), "right")
    n = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(begin)), n)
    b = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    row = begin // (w + 1)
    on = row[b] == row[a] - 1
    a, b = a[on], b[on]
    root = np.arange(len(begin))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    start = begin - row
    size = end - begin
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    label[at] = np.repeat(start[root], size)
    return label.reshape(h, w)


def growth(area: np.ndarray, min_size: int) -> np.ndarray:
    """How often each pixel of a component is to be dilated, plus one, by its component's area; 0 outside and below
    ``min_size``: twice below 30 pixels, once below 100."""
    return np.where(area < max(min_size, 1), 0, np.where(area < 30, 3, np.where(area < 100, 2, 1))).astype(np.uint8)


def grown(growth: np.ndarray) -> np.ndarray:
    """All components dilated by 5x5 as often as told, united."""
    return (growth > 0) | dilate(growth == 2, 5) | dilate(growth == 3, 9)


def grow_small(label: np.ndarray, min_size: int) -> np.ndarray:
    """Components of ``min_size`` pixels or more, dilated by 5x5 twice below 30 pixels and once below 100, united."""
    ids, inverse, area = np.unique(label, return_inverse=True, return_counts=True)
    return grown(growth(np.where(ids < 0, 0, area)[inverse].reshape(label.shape), min_size))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = scores - scores.max(axis=-1, keepdims=True)
    np.exp(e, out=e)
    e /= e.sum(axis=-1, keepdims=True)
    return e


def boosted(probs: np.ndarray, refined: np.ndarray, ship: int, lookalike: int, boost: float, factor: float) -> np.ndarray:
    """Ships boosted and look-alikes suppressed where ``refined`` holds; every pixel is divided by its class sum."""
    out = probs.copy()
    out[..., ship] = np.clip(np.where(refined, out[..., ship] * boost, out[..., ship]), 0.0, 1.0)
    out[..., lookalike] = np.where(refined, out[..., lookalike] * factor, out[..., lookalike])
    return out / out.sum(axis=-1, keepdims=True)


def ship_enhancement(probs: np.ndarray, ship: int, lookalike: int, threshold: float, min_size: int, boost: float, factor: float) -> np.ndarray:
    """Boost ships and suppress look-alikes where a refined ship mask holds; images without a ship pixel stay."""
    mask = probs[..., ship] > threshold
    if not mask.any():
        return probs
    return boosted(probs, grow_small(components(morph_close(morph_open(mask))), min_size), ship, lookalike, boost, factor)
