"""Image operators over whole images in NumPy, for Arrow batches of pages.

``pixels`` has their declarative form; tests hold one against the other.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(a: np.ndarray) -> np.ndarray:
    return np.floor(a + 0.5)


def to_gray(rgb: np.ndarray) -> np.ndarray:
    """I01."""
    return rounded(rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114).astype(np.uint8)


def _box(a: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sizes of the windows, clipped at the borders, by an integral image."""
    h, w = a.shape
    s = np.zeros((h + 1, w + 1))
    s[1:, 1:] = a.cumsum(0).cumsum(1)
    top, bottom = np.maximum(np.arange(h) - half, 0)[:, None], np.minimum(np.arange(h) + half + 1, h)[:, None]
    left, right = np.maximum(np.arange(w) - half, 0)[None], np.minimum(np.arange(w) + half + 1, w)[None]
    return s[bottom, right] - s[top, right] - s[bottom, left] + s[top, left], (bottom - top) * (right - left)


def box_mean(g: np.ndarray, half: int) -> np.ndarray:
    s, n = _box(g.astype(float), half)
    return s / n


def contrast(g: np.ndarray, tiles: int = 8, clip: float = 40.0) -> np.ndarray:
    """Equalisation by tiles with a clipped histogram, blended between tiles.

    Tiles beyond the image map every value to 0, and so darken the edge of a
    small image.
    """
    h, w = g.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    maps = np.zeros((tiles, tiles, 256))
    for r in range(tiles):
        for c in range(tiles):
            tile = g[r * th : (r + 1) * th, c * tw : (c + 1) * tw]
            n = tile.size
            most = max(1, int(rounded(np.float64(clip * n / 256))))
            hist = np.bincount(tile.ravel(), minlength=256)
            excess = int(np.maximum(hist - most, 0).sum())
            hist = np.minimum(hist, most) + excess // 256
            hist[: excess % 256] += 1
            maps[r, c] = rounded(hist.cumsum() * 255 / max(n, 1)) % 256

    def between(size: int, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(size) / tile - 0.5
        low = np.clip(np.floor(at), 0, tiles - 1).astype(int)
        return low, np.minimum(low + 1, tiles - 1), np.clip(at - low, 0, 1)

    y0, y1, dy = (a[:, None] for a in between(h, th))
    x0, x1, dx = (a[None] for a in between(w, tw))
    top = maps[y0, x0, g] * (1 - dx) + maps[y0, x1, g] * dx
    low = maps[y1, x0, g] * (1 - dx) + maps[y1, x1, g] * dx
    return rounded(top * (1 - dy) + low * dy).astype(np.uint8)


def sharpen(g: np.ndarray, radius: int = 2, amount: float = 0.5) -> np.ndarray:
    """I03."""
    return np.clip(rounded(g + amount * (g - box_mean(g, radius))), 0, 255).astype(np.uint8)


def _windows(g: np.ndarray, half: int) -> np.ndarray:
    k = 2 * half + 1
    return np.lib.stride_tricks.sliding_window_view(np.pad(g, half, mode="edge"), (k, k))


def median3(g: np.ndarray) -> np.ndarray:
    """W03, I04."""
    return np.median(_windows(g, 1), axis=(2, 3)).astype(np.uint8)


def erode(b: np.ndarray, k: int = 3) -> np.ndarray:
    """W04."""
    return _windows(b, k // 2).min(axis=(2, 3))


def dilate(b: np.ndarray, k: int = 3) -> np.ndarray:
    """W04."""
    return _windows(b, k // 2).max(axis=(2, 3))


def skew(g: np.ndarray) -> float:
    """The first of the angles from -5 to 5 degrees whose projection of dark pixels varies most."""
    h, w = g.shape
    y, x = np.mgrid[0:h, 0:w:2]
    dark = (g < g.mean())[:, ::2]
    best, angle = -1.0, 0.0
    for degrees in np.arange(-5, 5.5, 0.5):
        c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
        rx, ry = rounded(c * (x - w / 2) - s * (y - h / 2) + w / 2), rounded(s * (x - w / 2) + c * (y - h / 2) + h / 2)
        inside = (rx >= 0) & (rx < w) & (ry >= 0) & (ry < h) & dark
        profile = np.bincount(ry[inside].astype(int), minlength=h).astype(float)
        variance = (profile**2).mean() - profile.mean() ** 2
        if variance > best:
            best, angle = variance, float(degrees)
    return angle


def rotate(g: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the centre so that lines at this skew become level; outside is white."""
    h, w = g.shape
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    y, x = np.mgrid[0:h, 0:w]
    sx = rounded(c * (x - w / 2) + s * (y - h / 2) + w / 2).astype(int)
    sy = rounded(-s * (x - w / 2) + c * (y - h / 2) + h / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    return np.where(inside, g[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 255).astype(np.uint8)


def adaptive(g: np.ndarray, block: int, c: float) -> np.ndarray:
    """I07."""
    return np.where(g > box_mean(g, block // 2) - c, 255, 0).astype(np.uint8)


def sauvola(g: np.ndarray, window: int, k: float) -> np.ndarray:
    """I08."""
    (s, n), (q, _) = _box(g.astype(float), window // 2), _box(g.astype(float) ** 2, window // 2)
    mean = s / n
    deviation = np.sqrt(np.maximum(q / n - mean**2, 0))
    return np.where(g > mean * (1 + k * (deviation / 128 - 1)), 255, 0).astype(np.uint8)


def otsu(g: np.ndarray) -> np.ndarray:
    """I09."""
    n = np.bincount(g.ravel(), minlength=256).astype(float)
    w0, s0 = n.cumsum(), (n * np.arange(256)).cumsum()
    w1 = w0[-1] - w0
    with np.errstate(invalid="ignore", divide="ignore"):
        between = np.nan_to_num(w0 * w1 * (s0 / w0 - (s0[-1] - s0) / w1) ** 2)
    return np.where(g > int(between.argmax()), 255, 0).astype(np.uint8)


@dataclass(frozen=True)
class Preparation:
    """Which steps a page goes through; one way of binarising is taken, in the order sauvola, otsu, adaptive."""

    contrast: bool = False
    sharpen: bool = False
    denoise: bool = False
    deskew: bool = False
    adaptive: bool = False
    sauvola: bool = False
    otsu: bool = False
    opened: bool = False
    closed: bool = False
    block: int = 15
    c: float = 10.0
    k: float = 0.2
    amount: float = 0.5

    def _clear(self, g: np.ndarray) -> np.ndarray:
        g = contrast(g) if self.contrast else g
        g = sharpen(g, 2, self.amount) if self.sharpen else g
        return median3(g) if self.denoise else g

    def apply(self, gray: np.ndarray) -> np.ndarray:
        g = self._clear(gray)
        if self.deskew and abs(angle := skew(g)) > 0.3:
            g = self._clear(rotate(gray, angle))
        if not (self.sauvola or self.otsu or self.adaptive):
            return g
        b = sauvola(g, self.block, self.k) if self.sauvola else otsu(g) if self.otsu else adaptive(g, self.block, self.c)
        b = dilate(erode(b)) if self.opened else b
        return erode(dilate(b)) if self.closed else b


def png(g: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""
    h, w = g.shape
    raw = np.zeros((h, w + 1), np.uint8)
    raw[:, 1:] = g

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def unfiltered(raw: bytes, width: int, size: int) -> bytes:
    """Rows of so many bytes without the PNG filters that stand before each; ``size`` are the bytes of a pixel."""
    out, old = bytearray(), bytes(width)
    for at in range(0, len(raw), width + 1):
        kind, row = raw[at], np.frombuffer(raw[at + 1 : at + 1 + width].ljust(width, b"\0"), np.uint8).copy()
        if kind == 2:
            row += np.frombuffer(old, np.uint8)
        elif kind in (1, 3, 4):
            up = old
            line = bytearray(row.tobytes())
            for k in range(width):
                a, b, c = (line[k - size] if k >= size else 0), up[k], (up[k - size] if k >= size else 0)
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[k] = (line[k] + guess) & 255
            row = np.frombuffer(bytes(line), np.uint8)
        old = row.tobytes()
        out += old
    return bytes(out)


def decode_png(data: bytes) -> np.ndarray:
    """The gray values of a PNG file of 8 bits that is not interlaced; an error for others.

    Colours are made gray, transparency is left out of account.
    """
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, rows, palette, head = 8, b"", b"", None
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" and len(body) == 13 else head
        palette = body if kind == b"PLTE" else palette
        rows += body if kind == b"IDAT" else b""
        at += size + 12
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(head[3]) if head else None
    if not channels or head[2] != 8 or head[6] or not head[0] or not head[1]:
        raise ValueError("a kind of PNG that isn't read")
    w, h = head[:2]
    raw = unfiltered(zlib.decompress(rows), w * channels, channels)
    a = np.frombuffer(raw, np.uint8)[: h * w * channels].reshape(h, w, channels)
    if head[3] == 3:
        return to_gray(np.frombuffer(palette, np.uint8).reshape(-1, 3)[a[..., 0]])
    return a[..., 0].copy() if channels < 3 else to_gray(a[..., :3])


def resized(g: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image in another size, between its pixels' centres by straight lines."""
    h, w = g.shape

    def place(n: int, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, old - 1), at - lo

    (top, bottom, down), (left, right, across) = place(height, h), place(width, w)
    f = g.astype(float)
    upper = f[top][:, left] * (1 - across) + f[top][:, right] * across
    lower = f[bottom][:, left] * (1 - across) + f[bottom][:, right] * across
    return rounded(upper * (1 - down[:, None]) + lower * down[:, None]).astype(np.uint8)


def prepared(data: bytes | None, preparation: Preparation, least_width: int = 0, least_height: int = 0) -> bytes | None:
    """I11-I13 of one page: its prepared PNG, of a small page enlarged by two at most; what can't be prepared stays as it is."""
    try:
        g = decode_png(data or b"")
    except (ValueError, zlib.error, struct.error, IndexError):
        return data
    h, w = g.shape
    if w < least_width or h < least_height:
        scale = min(2.0, max(least_width / w, least_height / h, 1.0))
        g = resized(g, int(rounded(np.float64(w * scale))), int(rounded(np.float64(h * scale))))
    return png(preparation.apply(g))


def filtered(df: DataFrame, key: str, values: str, width: int, step: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A filter over images that are arrays of values from -1 to 1: a row a pixel, ``img``, ``y``, ``x``, ``g``.

    An image stays one row until the filter is done, so no pixel is shuffled.
    Null and empty arrays, and those that are no full rows, give no pixels.
    """
    schema = pa.schema([("img", pa.int64()), ("pixels", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if v and not len(v) % width:
                    g = np.clip(rounded((np.array(v, float) + 1) * 127.5), 0, 255).astype(np.uint8).reshape(-1, width)
                    out.append((k, step(g).ravel().tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 2, schema)], schema=schema)

    flat = df.select(key, values).mapInArrow(run, "img bigint, pixels array<int>").select("img", F.posexplode("pixels").alias("_at", "g"))
    return flat.select("img", F.floor(F.col("_at") / width).cast("int").alias("y"), (F.col("_at") % width).cast("int").alias("x"), "g")


def prepare_images(images: DataFrame, preparation: Preparation) -> DataFrame:
    """Rows of Spark's ``image`` source as prepared gray PNGs.

    Gives ``origin``, ``width``, ``height``, ``png`` and ``error``; an image that
    can't be prepared keeps a null ``png`` and says why.
    """
    columns = images.select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")
    schema = pa.schema([("origin", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("png", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for origin, w, h, n, data in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    if w <= 0 or h <= 0:
                        raise ValueError(f"invalid image dimensions: {w}x{h}")
                    a = np.frombuffer(data, np.uint8).reshape(h, w, n)
                    gray = a[..., 0] if n == 1 else to_gray(a[..., 2::-1])  # the source's order is blue, green, red
                    out.append((origin, w, h, png(preparation.apply(gray)), None))
                except (ValueError, TypeError) as e:
                    out.append((origin, w, h, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 5, schema)], schema=schema)

    return columns.mapInArrow(run, "origin string, width int, height int, png binary, error string")


def prepare_values(df: DataFrame, key: str, values: str, width: int, preparation: Preparation) -> DataFrame:
    """I12 over arrays of values from -1 to 1: key, ``skew`` and the prepared pixels.

    Null and empty arrays, and those that are no full rows, give null.
    """
    schema = pa.schema([(key, pa.int64()), ("skew", pa.float64()), ("pixels", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not v or len(v) % width:
                    out.append((k, None, None))
                    continue
                g = np.clip(rounded((np.array(v, float) + 1) * 127.5), 0, 255).astype(np.uint8).reshape(-1, width)
                out.append((k, skew(g), preparation.apply(g).ravel().tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 3, schema)], schema=schema)

    return df.select(key, values).mapInArrow(run, f"{key} bigint, skew double, pixels array<int>")
