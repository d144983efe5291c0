"""Scalar expressions: axis scales, boxes, angles, colours, styles. All stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALES = ("linear", "log10", "inverse")
#: Largest distance of two RGB colours (a fixed value of the similarity).
RGB_DIAGONAL = 441.67295593


def check_scale(vmin: float, vmax: float, scale: str) -> None:
    """Raises for an unknown scale or bounds that it doesn't allow."""
    if scale not in SCALES:
        raise ValueError(f"unknown scale: {scale}")
    if scale == "log10" and (vmin <= 0 or vmax <= 0):
        raise ValueError("log10 needs positive bounds")
    if scale == "inverse" and (vmin == 0 or vmax == 0):
        raise ValueError("inverse needs bounds other than zero")


def map_coords(norm: Column, vmin: float, vmax: float, scale: str = "linear") -> Column:
    """A normalised coordinate on a data axis; null where an inverse axis has no value."""
    check_scale(vmin, vmax, scale)
    if scale == "linear":
        return F.lit(vmin) + norm * (vmax - vmin)
    if scale == "log10":
        low, high = math.log10(vmin), math.log10(vmax)
        return F.pow(F.lit(10.0), F.lit(low) + norm * (high - low))
    return F.try_divide(F.lit(1.0), F.lit(1.0 / vmin) + norm * (1.0 / vmax - 1.0 / vmin))


def unmap_coords(value: Column, vmin: float, vmax: float, scale: str = "linear") -> Column:
    """The normalised coordinate of a data value: the inverse of ``map_coords``."""
    check_scale(vmin, vmax, scale)
    if scale == "log10":
        low, high = math.log10(vmin), math.log10(vmax)
        return (F.log10(value) - low) / (high - low)
    if scale == "inverse":
        return (F.try_divide(F.lit(1.0), value) - 1.0 / vmin) / (1.0 / vmax - 1.0 / vmin)
    return (value - vmin) / (vmax - vmin)


def pixel_to_data(px: Column, py: Column, box: tuple, rng: tuple, x_scale: str = "linear", y_scale: str = "linear") -> tuple[Column, Column]:
    """Data coordinates of a pixel; ``box`` and ``rng`` are (x_min, y_min, x_max, y_max) and (x_min, x_max, y_min, y_max). Pixel rows grow downwards."""
    x0, y0, x1, y1 = box
    if x1 <= x0 or y1 <= y0 or rng[0] == rng[1] or rng[2] == rng[3]:
        raise ValueError("plot box and data range must not be empty")
    return map_coords((px - x0) / (x1 - x0), rng[0], rng[1], x_scale), map_coords(1.0 - (py - y0) / (y1 - y0), rng[2], rng[3], y_scale)


def data_to_pixel(x: Column, y: Column, box: tuple, rng: tuple, x_scale: str = "linear", y_scale: str = "linear") -> tuple[Column, Column]:
    """The pixel of data coordinates, the inverse of ``pixel_to_data``."""
    x0, y0, x1, y1 = box
    return F.lit(x0) + unmap_coords(x, rng[0], rng[1], x_scale) * (x1 - x0), F.lit(y1) - unmap_coords(y, rng[2], rng[3], y_scale) * (y1 - y0)


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Shared area of two boxes (x_min, y_min, x_max, y_max)."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def area(a: tuple[Column, ...]) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def bbox_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    shared = overlap(a, b)
    return F.when(shared <= 0, 0.0).otherwise(shared / F.greatest(area(a) + area(b) - shared, F.lit(1.0)))


def bbox_containment(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return overlap(a, b) / F.greatest(F.lit(1.0), F.least(area(a), area(b)))


def contains(box: tuple[Column, ...], x: Column, y: Column) -> Column:
    """Whether a closed box holds a point."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def angle_degrees(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def angle_difference(a: Column, b: Column) -> Column:
    """The smaller angle between two directions in degrees."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Unsigned angle of two vectors in degrees, 0 if one has no length."""
    n = F.hypot(ax, ay) * F.hypot(bx, by)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(ax * bx + ay * by, n)))
    return F.when(n == 0, 0.0).otherwise(F.degrees(F.acos(cos)))


def hex_channels(color: Column) -> list[Column]:
    """The three channels of ``#rrggbb``."""
    return [F.conv(F.substring(color, 2 + 2 * i, 2), 16, 10).cast("int") for i in range(3)]


def rgb_distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0)))


def rgb_similarity(a: list[Column], b: list[Column]) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - rgb_distance(a, b) / RGB_DIAGONAL)


def is_achromatic(rgb: list[Column], tolerance: float = 18.0) -> Column:
    return F.greatest(*[F.abs(a - b) for i, a in enumerate(rgb) for b in rgb[i + 1 :]]) <= tolerance


def normalize_label(text: Column) -> Column:
    """Trimmed, with each run of white space (Unicode's) as one blank."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def safe_ratio(a: Column, b: Column) -> Column:
    """Null unless the divisor is positive."""
    return F.when(b > 0, F.try_divide(a, b))


def marker_shape(fill: Column, circularity: Column, aspect: Column) -> Column:
    return F.when((aspect <= 1.18) & (fill >= 0.82), "square_like").when((aspect <= 1.25) & (circularity >= 0.72), "circle_like").when(fill <= 0.45, "cross_like").otherwise("unknown")


def marker_confidence(fill: Column, circularity: Column, aspect: Column) -> Column:
    one = F.lit(1.0)
    score = 0.25 + 0.35 * F.least(one, fill) + 0.25 * F.least(one, circularity) + 0.15 * F.greatest(F.lit(0.0), 1.0 - F.abs(aspect - 1.0))
    return F.greatest(F.lit(0.0), F.least(one, score))


def ordinal_similarity(i: Column, j: Column, n: Column, m: Column) -> Column:
    scale = F.greatest(n - 1, m - 1, F.lit(1))
    return F.when((n <= 1) | (m <= 1), 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(i - j) / scale))


def style_similarity(a: Column, b: Column) -> Column:
    """Agreement of two line styles."""
    broken = ("dashed", "dotted")
    return (
        F.when((a == "unknown") | (b == "unknown"), 0.45)
        .when(a == b, 1.0)
        .when(a.isin(*broken) & b.isin(*broken), 0.65)
        .when(((a == "solid") & b.isin(*broken)) | ((b == "solid") & a.isin(*broken)), 0.20)
        .otherwise(0.35)
    )
