"""Colours and masks over tables of pixels ``(image_id, x, y, ...)``.

Predicates and aggregates are plain expressions. Labelling and thinning work on one image's mask at a time,
whose size an image bounds. Pixels with a null place are left out, repeated ones count once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    """8-bit CIE Lab (D65): L scaled to 0..255, a and b shifted by 128, unrounded."""

    def linear(c: Column) -> Column:
        c = c / 255.0
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))

    def root(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, 1 / 3)).otherwise(7.787 * t + 16 / 116)

    r, g, b = linear(r), linear(g), linear(b)
    x = (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456
    y = 0.212671 * r + 0.715160 * g + 0.072169 * b
    z = (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754
    light = F.when(y > 0.008856, 116 * root(y) - 16).otherwise(903.3 * y)
    return [light * 2.55, 500 * (root(x) - root(y)) + 128, 200 * (root(y) - root(z)) + 128]


def with_lab(pixels: DataFrame) -> DataFrame:
    """``pixels(r, g, b)`` with l, a, b2 (Lab's b)."""
    light, a, b = lab(F.col("r"), F.col("g"), F.col("b"))
    return pixels.select("*", light.alias("l"), a.alias("a"), b.alias("b2"))


def color_mask(pixels: DataFrame, prototype: tuple[float, float, float], l_range: float = 55.0, ab_range: float = 16.0) -> DataFrame:
    """Pixels (with Lab) close to a prototype: |dL| <= l_range and the distance in a, b <= ab_range."""
    light, a, b = prototype
    return pixels.where((F.abs(F.col("l") - light) <= l_range) & (F.hypot(F.col("a") - a, F.col("b2") - b) <= ab_range))


def suppress_dark(mask: DataFrame, pixels: DataFrame, dark: float = 80.0) -> DataFrame:
    """Mask pixels that neither are dark nor touch a dark pixel by an edge. The dark pixels expand fivefold, and the join is by place."""
    near = F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)))))
    shade = pixels.where(F.col("l") <= dark).select("image_id", near.alias("p")).select("image_id", "p.x", "p.y").distinct()
    return mask.join(shade, ["image_id", "x", "y"], "left_anti")


def exclude(pixels: DataFrame, boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Pixels outside all boxes; bounds are cut to whole pixels, the upper ones excluded."""
    for x0, y0, x1, y1 in boxes:
        pixels = pixels.where(~((F.col("x") >= int(x0)) & (F.col("x") < int(x1)) & (F.col("y") >= int(y0)) & (F.col("y") < int(y1))))
    return pixels


def _placed(pixels: DataFrame) -> DataFrame:
    return pixels.where("x is not null and y is not null").select("image_id", F.col("x").cast("long"), F.col("y").cast("long"))


def _find(key: np.ndarray, step: int) -> np.ndarray:
    """The place in the sorted keys of each key moved by ``step``, -1 where there is none."""
    at = np.searchsorted(key, key + step)
    return np.where((at < len(key)) & (key[np.minimum(at, len(key) - 1)] == key + step), at, -1)


def _keys(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of places in (x, y) order, and how far columns lie apart; neighbours never wrap around."""
    width = int(y.max() - y.min()) + 3
    return (x - x.min()) * width + (y - y.min() + 1), width


def _unite(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Component numbers of n nodes under the links (u, v), in the order of their first nodes."""
    root = np.arange(n)
    while len(u):
        least = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], least)
        np.minimum.at(root, root[v], least)
        while not np.array_equal(up := root[root], root):
            root = up
        open_ = root[u] != root[v]
        u, v = u[open_], v[open_]
    return np.unique(root, return_inverse=True)[1]


def _labels(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Component numbers of pixels sorted by (x, y), 8-connected."""
    key, width = _keys(x, y)
    found = [_find(key, step) for step in (1, width - 1, width, width + 1)]
    u = np.concatenate([np.flatnonzero(f >= 0) for f in found])
    return _unite(len(x), u, np.concatenate([f[f >= 0] for f in found]))


def label_components(pixels: DataFrame) -> DataFrame:
    """``(image_id, x, y, component)``: 8-connected components of each image, numbered from 0 by their first pixel in (x, y) order."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["x", "y"]).sort_values(["x", "y"], ignore_index=True)
        return group.assign(component=_labels(group["x"].to_numpy(), group["y"].to_numpy()))

    pixels = _placed(pixels)
    return pixels.groupBy("image_id").applyInPandas(run, f"image_id {pixels.schema['image_id'].dataType.simpleString()}, x long, y long, component long")


def component_stats(labelled: DataFrame) -> DataFrame:
    """Area and bounding box of each component; width and height count pixels."""
    out = labelled.groupBy("image_id", "component").agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return out.select("*", (F.col("x1") - F.col("x0") + 1).alias("width"), (F.col("y1") - F.col("y0") + 1).alias("height"))


def keep_components(stats: DataFrame, w: int | Column, h: int | Column, min_area: int = 4, min_x_span: int = 3, margin: int = 4, tick_span: int = 3, tick_thickness: int = 4) -> DataFrame:
    """Components of w x h masks that aren't frames, grid lines, axis ticks, small or narrow."""
    width, height = F.col("width"), F.col("height")

    def side(near: int) -> tuple[Column, Column]:
        return (F.col("x0") <= near) | (F.col("x1") + 1 >= w - near), (F.col("y0") <= near) | (F.col("y1") + 1 >= h - near)

    touch_x, touch_y = side(0)
    near_x, near_y = side(margin)
    frame = (touch_y & (width >= 0.75 * w) & (height <= 6)) | (touch_x & (height >= 0.75 * h) & (width <= 6))
    grid = ((width >= 0.35 * w) & (height <= 4)) | ((height >= 0.35 * h) & (width <= 4))
    tick = (near_x & (width <= tick_span) & (height <= tick_thickness)) | (near_y & (height <= tick_span) & (width <= tick_thickness))
    return stats.where(~frame & ~grid & ~tick & (F.col("area") >= min_area) & (width >= min_x_span))


def filter_mask(pixels: DataFrame, w: int, h: int, **limits: int) -> DataFrame:
    """Pixels of the components that ``keep_components`` keeps."""
    labelled = label_components(pixels)
    kept = keep_components(component_stats(labelled), w, h, **limits)
    return labelled.join(kept.select("image_id", "component"), ["image_id", "component"], "left_semi")


def _thin(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zhang and Suen's thinning in two alternating passes until nothing changes."""
    x0, y0 = x.min() - 1, y.min() - 1
    img = np.zeros((y.max() - y0 + 2, x.max() - x0 + 2), bool)
    img[y - y0, x - x0] = True
    changed = True
    while changed:
        changed = False
        for odd in (False, True):
            p = np.pad(img, 1)
            n, e, s, w = p[:-2, 1:-1], p[1:-1, 2:], p[2:, 1:-1], p[1:-1, :-2]
            ring = np.stack([n, p[:-2, 2:], e, p[2:, 2:], s, p[2:, :-2], w, p[:-2, :-2]])
            count = ring.sum(axis=0)
            rises = (~ring & np.roll(ring, -1, axis=0)).sum(axis=0)
            corner = ~(n & e & w) & ~(n & s & w) if odd else ~(n & e & s) & ~(e & s & w)
            gone = img & (count >= 2) & (count <= 6) & (rises == 1) & corner
            if gone.any():
                img, changed = img & ~gone, True
    ys, xs = np.nonzero(img)
    return xs + x0, ys + y0


def skeleton(pixels: DataFrame) -> DataFrame:
    """``(image_id, x, y)``: each image's mask thinned to lines one pixel wide."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        xs, ys = _thin(group["x"].to_numpy(), group["y"].to_numpy())
        return pd.DataFrame({"image_id": group["image_id"].iloc[0], "x": xs, "y": ys})

    pixels = _placed(pixels)
    return pixels.groupBy("image_id").applyInPandas(run, f"image_id {pixels.schema['image_id'].dataType.simpleString()}, x long, y long")


def skeleton_nodes(skeleton: DataFrame) -> DataFrame:
    """Each skeleton pixel's number of 8-neighbours and kind: alone (0), endpoint (1), path (2) or junction."""
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    votes = skeleton.select("image_id", F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps))).alias("p")).select("image_id", "p.x", "p.y", F.lit(1).alias("vote"), F.lit(0).alias("own"))
    every = votes.unionByName(skeleton.select("image_id", "x", "y", F.lit(0).alias("vote"), F.lit(1).alias("own")))
    out = every.groupBy("image_id", "x", "y").agg(F.sum("vote").alias("degree"), F.max("own").alias("own")).where("own = 1").drop("own")
    return out.withColumn("kind", F.when(F.col("degree") == 0, "alone").when(F.col("degree") == 1, "endpoint").when(F.col("degree") == 2, "path").otherwise("junction"))


def _links(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between pixels sorted by (x, y): edges, and corners where no pixel joins both by edges."""
    key, width = _keys(x, y)
    up, down, right, left = (_find(key, s) for s in (-1, 1, width, -width))
    pairs = [(np.arange(len(x)), down), (np.arange(len(x)), right)]
    for step, beside in ((width + 1, down), (width - 1, up)):
        pairs.append((np.arange(len(x)), np.where((right < 0) & (beside < 0), _find(key, step), -1)))
    u, v = (np.concatenate(c) for c in zip(*pairs))
    return u[v >= 0], v[v >= 0]


def _without_spurs(x: np.ndarray, y: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    while len(x) >= 4:
        u, v = _links(x, y)
        degree = np.bincount(np.concatenate([u, v]), minlength=len(x))
        joint = degree >= 3
        inner = ~joint[u] & ~joint[v]
        chain = _unite(len(x), u[inner], v[inner])
        size = np.bincount(chain[~joint], minlength=len(x))
        ends = np.bincount(chain[degree == 1], minlength=len(x))
        # links from a chain to a junction, either way round
        both = np.concatenate([np.stack([u, v]), np.stack([v, u])], axis=1)
        src, dst = both[:, joint[both[1]] & ~joint[both[0]]]
        held = np.bincount(chain[src], minlength=len(x))
        spur = (size <= longest) & (ends == 1) & (held == 1)
        for i, j in zip(src[spur[chain[src]]].tolist(), dst[spur[chain[src]]].tolist()):
            others = both[1][both[0] == j]
            others = others[others != i]
            step, on = (x[j] - x[i], y[j] - y[i]), (x[others] - x[j], y[others] - y[j])
            cosine = (step[0] * on[0] + step[1] * on[1]) / (np.hypot(*step) * np.hypot(*on))
            if (cosine >= np.sqrt(0.5) - 1e-9).any():
                spur[chain[i]] = False
        kept = joint | ~spur[chain]
        if kept.all() or kept.sum() < 2:
            break
        x, y = x[kept], y[kept]
    return x, y


def prune_spurs(skeleton: DataFrame, longest: int = 12) -> DataFrame:
    """``(image_id, x, y)`` without chains of up to ``longest`` pixels that lead from an end to a junction and don't go straight on there (within 45 degrees); again until none is left."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["x", "y"]).sort_values(["x", "y"])
        xs, ys = _without_spurs(group["x"].to_numpy(), group["y"].to_numpy(), longest)
        return pd.DataFrame({"image_id": group["image_id"].iloc[0], "x": xs, "y": ys})

    pixels = _placed(skeleton)
    return pixels.groupBy("image_id").applyInPandas(run, f"image_id {pixels.schema['image_id'].dataType.simpleString()}, x long, y long")


def _longest(n: int, u: np.ndarray, v: np.ndarray) -> list[int]:
    """The longest of the shortest paths from an end (the first node where there is none); the first of equals."""
    near: list[list[int]] = [[] for _ in range(n)]
    for i, j in zip(u.tolist(), v.tolist()):
        near[i].append(j)
        near[j].append(i)
    best: list[int] = []
    for start in [i for i in range(n) if len(near[i]) == 1] or [0]:
        came, order = {start: -1}, [start]
        for i in order:
            for j in sorted(near[i]):
                if j not in came:
                    came[j] = i
                    order.append(j)
        path, at = [], order[-1]
        while at >= 0:
            path.append(at)
            at = came[at]
        if len(path) > len(best):
            best = path[::-1]
    return best


def trace_paths(skeleton: DataFrame) -> DataFrame:
    """``(image_id, component, seq, x, y)``: the longest path through each component of a skeleton, in order.

    It begins at the first end in (x, y) order that gives the longest path; a ring is followed from its first
    pixel to the farthest. A component costs its pixels times its ends, so spurs should be pruned before.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["x", "y"], ignore_index=True)
        x, y = group["x"].to_numpy(), group["y"].to_numpy()
        path = _longest(len(x), *_links(x, y))
        return pd.DataFrame({"image_id": group["image_id"].iloc[0], "component": group["component"].iloc[0], "seq": range(len(path)), "x": x[path], "y": y[path]})

    labelled = label_components(skeleton)
    kind = labelled.schema["image_id"].dataType.simpleString()
    return labelled.groupBy("image_id", "component").applyInPandas(run, f"image_id {kind}, component long, seq long, x long, y long")
