"""Box expressions. A box is a struct with x, y, w, h; impossible boxes become null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageframe.functions.text import filled, js_round

INFINITE = float("inf")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INFINITE)


def clamp(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, c))


def clip_box(r: Column, width: Column, height: Column, before: bool) -> Column:
    """The box inside its page, null if it isn't finite or nothing of it is left.

    ``before`` rejects sizes of zero or less before clipping, as the export does;
    native text is clipped first. A null page size gives null.
    """
    zero = F.lit(0.0)
    ok = finite(r["x"]) & finite(r["y"]) & finite(r["w"]) & finite(r["h"])
    if before:
        ok = ok & (r["w"] > 0) & (r["h"] > 0)
    x, y = clamp(r["x"], zero, width), clamp(r["y"], zero, height)
    w, h = clamp(r["w"], zero, width - x), clamp(r["h"], zero, height - y)
    return F.when(ok & (w > 0) & (h > 0), F.struct(r["text"].alias("text"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), r["confidence"].alias("confidence")))


def clean_regions(regions: Column, width: Column, height: Column, before: bool) -> Column:
    """P14 with P12 or P13 over an array: regions with text and a possible box."""
    full = F.filter(F.coalesce(regions, F.array()), lambda r: filled(r["text"]))
    return F.filter(F.transform(full, lambda r: clip_box(r, width, height, before)), lambda r: r.isNotNull())


def overlay(r: Column, width: Column, height: Column) -> Column:
    """P20: the box in percent of the page."""
    return F.struct((r["x"] / width * 100).alias("left"), (r["y"] / height * 100).alias("top"), (r["w"] / width * 100).alias("width"), (r["h"] / height * 100).alias("height"))


def from_corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """P21."""
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def from_polygon(points: Column, width: Column, height: Column) -> Column:
    """The box around points [x, y]; the whole page for null or fewer than four."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    box = F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))
    page = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), width.cast("double").alias("w"), height.cast("double").alias("h"))
    return F.when(F.size(points) >= 4, box).otherwise(page)


def crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: int = 4) -> Column:
    """A padded line box inside the image."""
    px, py = F.greatest(F.lit(0.0), x - pad), F.greatest(F.lit(0.0), y - pad)
    return F.struct(px.alias("x"), py.alias("y"), F.least(width - px, w + 2 * pad).alias("w"), F.least(height - py, h + 2 * pad).alias("h"))


def native_item(x: Column, y: Column, w: Column, h: Column, fallback: Column, length: Column, page_height: Column, scale: float = 3.0) -> Column:
    """A text item of a PDF page (lower left origin) as a box (upper left, scaled).

    A height of null, zero or NaN falls back to the matrix' and then to 12; a
    width of zero or less is estimated from the number of characters.
    """
    own = F.when(h.isNull() | (h == 0) | F.isnan(h), F.abs(fallback)).otherwise(h)
    h0 = F.abs(F.when(own.isNull() | (own == 0) | F.isnan(own), 12.0).otherwise(own))
    tall = h0 * scale
    wide = F.when(w * scale > 0, w * scale).otherwise(F.greatest(length * (tall * 0.4), F.lit(6.0)))
    return F.struct((x * scale).alias("x"), ((page_height - y - h0) * scale).alias("y"), wide.alias("w"), tall.alias("h"))


def upscaled(w: Column, h: Column, least_w: float, least_h: float) -> Column:
    """The size after upscaling a small image, by two at most."""
    scale = F.least(F.greatest(least_w / w, least_h / h, F.lit(1.0)), F.lit(2.0))
    small = (w < least_w) | (h < least_h)
    return F.struct(F.when(small, js_round(w * scale)).otherwise(w).alias("w"), F.when(small, js_round(h * scale)).otherwise(h).alias("h"))


def font_half_points(h: Column) -> Column:
    """F21."""
    return F.greatest(F.lit(16), js_round(h * 0.75 * 2))


def pdf_baseline(y: Column, h: Column, font: Column, page_height: Column) -> Column:
    """F24."""
    return clamp(page_height - y - h + font * 0.2, F.lit(0.0), page_height)
