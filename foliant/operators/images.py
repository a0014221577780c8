"""Page images before they are read: grey, even light, straight, cropped, of a fitting size, cut into tiles. All with numpy; medians of the background are taken
along rows, then along columns, and rotation is bilinear, so that results come near those of an image library and aren't the same bytes. Images are read from and written to PNG (8 bits, not interlaced)."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from foliant.functions import columns as C

LONG, READ_LONG, OVERLAP, LEAST_TILED, MARGIN, STRAIGHT = 2600, 1800, 200, 900, 60, 0.7


# --- PNG ---


def encode_png(img: np.ndarray) -> bytes:
    """Grey (rows x columns) or RGB (rows x columns x 3)."""
    h, w = img.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), img.reshape(h, -1)], axis=1)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if img.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Grey or RGB; transparency is dropped, palettes are looked up."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, parts, palette = 8, [], None
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            w, h, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            parts.append(body)
        at += 12 + size
    if depth != 8 or laced:
        raise ValueError("only PNGs of 8 bits that aren't interlaced")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * n)
    out, above = np.empty((h, w * n), np.uint8), np.zeros(w * n, np.uint8)
    for y in range(h):
        out[y] = above = _unfiltered(rows[y, 0], rows[y, 1:], above, n)
    img = out.reshape(h, w, n)
    if kind == 3:
        return palette[img[..., 0]]
    return img[..., 0] if n < 3 else img[..., :3]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
    out = bytearray(line.tobytes())
    up = above.tobytes()
    for i in range(len(out)):
        a = out[i - n] if i >= n else 0
        b, c = up[i], up[i - n] if i >= n else 0
        if kind == 3:
            add = (a + b) // 2
        else:
            p = a + b - c
            add = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = out[i] + add & 255
    return np.frombuffer(bytes(out), np.uint8)


# --- filters ---


def _padded(x: np.ndarray, r: int, axis: int) -> np.ndarray:
    return np.pad(x, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")


def _smoothed(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    r = len(kernel) // 2
    for axis in (0, 1):
        p = _padded(x.astype(np.float32), r, axis)
        x = sum(k * np.take(p, range(i, i + x.shape[axis]), axis) for i, k in enumerate(kernel.astype(np.float32)))
    return x


def gaussian(x: np.ndarray, sigma: float, size: int | None = None) -> np.ndarray:
    r = (size or 2 * int(round(3 * sigma)) + 1) // 2
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    return _smoothed(x, kernel / kernel.sum())


def _median(x: np.ndarray, size: int) -> np.ndarray:
    """Along rows, then along columns, a few lines at a time."""
    for axis in (1, 0):
        p = _padded(x, size // 2, axis)
        lines = np.moveaxis(p, axis, 1)
        out = np.empty(np.moveaxis(x, axis, 1).shape, x.dtype)
        for a in range(0, len(lines), 64):
            windows = np.lib.stride_tricks.sliding_window_view(lines[a : a + 64], size, axis=1)
            out[a : a + 64] = np.partition(windows, size // 2, axis=2)[..., size // 2]
        x = np.moveaxis(out, 1, axis)
    return x


def _resized(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Each sign of the new image is the mean of what it covers, or lies between its neighbours."""

    def weights(old: int, new: int) -> np.ndarray:
        m = np.zeros((new, old), np.float32)
        if new <= old:
            edges = np.linspace(0, old, new + 1)
            for i in range(new):
                for j in range(int(edges[i]), min(old, int(np.ceil(edges[i + 1])))):
                    m[i, j] = min(j + 1, edges[i + 1]) - max(j, edges[i])
        else:
            at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
            low = np.minimum(at.astype(int), old - 1)
            m[np.arange(new), low] += 1 - (at - low)
            m[np.arange(new), np.minimum(low + 1, old - 1)] += at - low
        return m / m.sum(1, keepdims=True)

    x = np.tensordot(weights(img.shape[0], h), img.astype(np.float32), (1, 0))
    x = np.moveaxis(np.tensordot(weights(img.shape[1], w), x, (1, 1)), 0, 1)
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def grey(img: np.ndarray) -> np.ndarray:
    """The shares of red, green and blue."""
    return img if img.ndim == 2 else np.rint(img.astype(np.float32) @ np.float32([0.299, 0.587, 0.114])).astype(np.uint8)


def equalised(img: np.ndarray, clip: float = 3.0, tiles: int = 8) -> np.ndarray:
    """Histograms of tiles, cut at a multiple of their mean and spread evenly, and between the tiles' centres what lies between their maps."""
    h, w = img.shape
    if h < tiles or w < tiles:
        return img
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.empty((tiles, tiles, 256), np.float32)
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(img[ys[i] : ys[i + 1], xs[j] : xs[j + 1]].ravel(), minlength=256).astype(np.float64)
            area = n.sum()
            most = max(1.0, clip * area / 256)
            n = np.minimum(n, most) + np.maximum(n - most, 0).sum() / 256
            maps[i, j] = np.cumsum(n) * 255 / area
    fy = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1)
    fx = np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = fy.astype(int), fx.astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    ty, tx = (fy - y0)[:, None].astype(np.float32), (fx - x0)[None, :].astype(np.float32)
    at = lambda y, x: maps[y[:, None], x[None, :], img]
    out = (at(y0, x0) * (1 - tx) + at(y0, x1) * tx) * (1 - ty) + (at(y1, x0) * (1 - tx) + at(y1, x1) * tx) * ty
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def enhanced(img: np.ndarray, long: int = LONG) -> np.ndarray:
    """Grey, at most so long, over its background, equalised, sharpened."""
    g = grey(img)
    if long and max(g.shape) > long:
        share = long / max(g.shape)
        g = _resized(g, int(g.shape[1] * share), int(g.shape[0] * share))
    ground = _median(g, 31).astype(np.float32)
    even = np.where(ground > 0, np.rint(g * 255.0 / np.maximum(ground, 1)), 0)
    even = equalised(np.clip(even, 0, 255).astype(np.uint8)).astype(np.float32)
    return np.clip(np.rint(1.35 * even - 0.35 * gaussian(even, 1.1)), 0, 255).astype(np.uint8)


def otsu(g: np.ndarray) -> int:
    """The level that parts the greys with the greatest variance between the two."""
    n = np.bincount(g.ravel(), minlength=256) / g.size
    low, mean = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * low - mean) ** 2 / (low * (1 - low))
    return int(np.argmax(np.nan_to_num(between)))


def skew(g: np.ndarray) -> float:
    """Degrees by which the least rectangle around the dark signs is turned, between -45 and 45; 0 with few of them."""
    y, x = np.nonzero(g <= otsu(g))
    if len(x) < 1000:
        return 0.0
    points = np.unique(np.column_stack([x, y]), axis=0).astype(float)
    hull: list = []
    for run in (points, points[::-1]):
        side: list = []
        for p in run:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                side.pop()
            side.append(p)
        hull += side[:-1]
    h = np.array(hull)
    turns = np.unique(np.arctan2(*np.roll(h, -1, 0).__sub__(h).T[::-1]) % (np.pi / 2))
    areas = [np.prod(np.ptp(h @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]), axis=0)) for t in turns]
    turn = np.degrees(turns[int(np.argmin(areas))])
    return float(turn - 90 if turn > 45 else turn)


def deskewed(g: np.ndarray) -> np.ndarray:
    """Turned back if the skew is STRAIGHT degrees or more; the edges repeat."""
    turn = skew(g)
    if abs(turn) < STRAIGHT:
        return g
    h, w = g.shape
    cos, sin = np.cos(np.radians(turn)), np.sin(np.radians(turn))
    out = np.empty_like(g)
    x = np.arange(w) - w // 2
    for a in range(0, h, 256):
        y = (np.arange(a, min(h, a + 256)) - h // 2)[:, None]
        sx, sy = np.clip(cos * x - sin * y + w // 2, 0, w - 1), np.clip(sin * x + cos * y + h // 2, 0, h - 1)
        x0, y0 = sx.astype(int), sy.astype(int)
        x1, y1, tx, ty = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1), sx - x0, sy - y0
        out[a : a + 256] = np.rint((g[y0, x0] * (1 - tx) + g[y0, x1] * tx) * (1 - ty) + (g[y1, x0] * (1 - tx) + g[y1, x1] * tx) * ty)
    return out


def cropped(g: np.ndarray, margin: int = MARGIN) -> tuple[np.ndarray, tuple[int, int, int, int]]:
    """What lies around signs darker than their surroundings, with a margin, and (x, y, width, height) of it."""
    y, x = np.nonzero(g <= gaussian(g, 0.3 * ((41 - 1) * 0.5 - 1) + 0.8, 41) - 12)
    if not len(x):
        return g, (0, 0, g.shape[1], g.shape[0])
    x0, y0 = max(0, int(x.min()) - margin), max(0, int(y.min()) - margin)
    x1, y1 = min(g.shape[1] - 1, int(x.max()) + margin), min(g.shape[0] - 1, int(y.max()) + margin)
    return g[y0 : y1 + 1, x0 : x1 + 1], (x0, y0, x1 - x0 + 1, y1 - y0 + 1)


def fitted(img: np.ndarray, long: int = READ_LONG, upscale: float = 1.0) -> np.ndarray:
    """The longer side as asked; made larger by the factor upscale at most."""
    side = max(img.shape[:2])
    share = long / side if side else 1.0
    share = min(share, upscale) if share > 1 else share
    if abs(share - 1) < 1e-3:
        return img
    return _resized(img, max(1, round(img.shape[1] * share)), max(1, round(img.shape[0] * share)))


def split(img: np.ndarray, parts: int = 2, overlap: int = OVERLAP) -> list[np.ndarray]:
    """Parts from top to bottom that overlap; low images stay whole."""
    h = img.shape[0]
    if parts <= 1 or h < LEAST_TILED:
        return [img]
    step = h // parts
    return [img[max(0, i * step - (overlap if i else 0)) : min(h, (i + 1) * step + (overlap if i < parts - 1 else 0))] for i in range(parts)]


def prepared(img: np.ndarray, tile: bool = True) -> tuple[list[np.ndarray], tuple[int, int, int, int]]:
    """The tiles of a page as a reader gets them, and where the page was cropped."""
    part, box = cropped(deskewed(enhanced(img)))
    ready = fitted(part)
    return split(ready) if tile else [ready], box


tiles_of = C.arrow(lambda png, tile: [encode_png(t) for t in prepared(decode_png(bytes(png)), bool(tile))[0]] if png is not None else [], "array<binary>")
