"""Pieces of masks: what they are like, lines or markers, and candidates of markers.

Classes and shapes are expressions over one row a piece. Outlines and distances need an image's mask as an
array; they work on one image a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .masks import _labels, _placed, component_stats, label_components, skeleton_nodes, trace_paths

#: What makes a piece of a skeleton compact, or a line.
COMPACT_SPAN, COMPACT_ASPECT, LINE_PIXELS, LINE_SPAN, ELONGATED_SPAN = 18, 1.8, 40, 35, 8
#: Limits of marker candidates, the depth of a marker's core, the margin around it, and how near two candidates may be.
MARKER_AREA, MARKER_SPAN, MARKER_ASPECT, CORE_DEPTH, CORE_MARGIN, CORE_APART = 12, 36, 2.0, 2.8, 7.0, 8.0
#: Lengths of a step along an edge, across a corner and of a knight's move in the distance of cores.
STEPS = (1.0, 1.4, 2.1969)


def described(stats: DataFrame) -> DataFrame:
    """``component_stats`` with ``max_span`` and ``aspect``, and whether a piece is ``compact`` or an ``anchor`` (a line)."""
    longer, shorter = F.greatest("width", "height"), F.greatest(F.least("width", "height"), F.lit(1))
    rows = stats.withColumns({"max_span": longer, "aspect": longer / shorter})
    compact = (F.col("width") <= COMPACT_SPAN) & (F.col("height") <= COMPACT_SPAN) & (F.col("aspect") <= COMPACT_ASPECT)
    anchor = (F.col("area") >= LINE_PIXELS) | (F.col("max_span") >= LINE_SPAN) | ((F.col("aspect") > COMPACT_ASPECT) & (F.col("max_span") >= ELONGATED_SPAN))
    return rows.withColumns({"compact": compact, "anchor": anchor})


def drop_marker_like(stats: DataFrame) -> DataFrame:
    """``described`` pieces without the compact ones of images that have a line; an image of nothing else keeps them all. ``skipped`` counts an image's dropped pieces."""
    w = Window.partitionBy("image_id")
    rows = stats.withColumns({"__line": F.max("anchor").over(w), "__left": F.count_if(~F.col("compact")).over(w), "__all": F.count("*").over(w)})
    some = F.col("__line") & (F.col("__left") > 0)
    rows = rows.withColumn("skipped", F.when(some, F.col("__all") - F.col("__left")).otherwise(0))
    return rows.where(~some | ~F.col("compact")).drop("__line", "__left", "__all")


def classified(stats: DataFrame) -> DataFrame:
    """``described`` pieces with ``class_label`` (line_like, marker_like or noise), ``confidence`` and ``warnings``."""
    one, tiny = F.lit(1.0), F.col("area") <= 2
    label = F.when(tiny, "noise").when(F.col("anchor"), "line_like").when(F.col("compact"), "marker_like").otherwise("noise")
    sure = F.when(tiny, 0.70).when(F.col("anchor"), F.least(one, 0.55 + F.col("max_span") / (2.0 * LINE_SPAN))).when(F.col("compact"), F.least(one, 0.55 + F.col("area") / float(LINE_PIXELS))).otherwise(0.45)
    odd = F.when(tiny | F.col("anchor") | F.col("compact"), F.array().cast("array<string>")).otherwise(F.array(F.lit("ambiguous_component")))
    return stats.withColumns({"class_label": label, "confidence": sure, "warnings": odd})


def line_components(skeleton: DataFrame) -> DataFrame:
    """One row for each piece of an image's skeleton ``(image_id, x, y)``.

    ``classified`` with the numbers of ends and junctions, the length of the longest path, and its points
    ``path`` (line-like pieces only). Boxes include their last pixels: x1 and y1 are one beyond.
    """
    labelled = label_components(skeleton)
    nodes = skeleton_nodes(labelled.select("image_id", "x", "y")).select("image_id", "x", "y", "degree")
    ends = labelled.join(nodes, ["image_id", "x", "y"]).groupBy("image_id", "component").agg(F.count_if(F.col("degree") == 1).alias("endpoints"), F.count_if(F.col("degree") >= 3).alias("junctions"))
    traced = trace_paths(skeleton)
    w = Window.partitionBy("image_id", "component").orderBy("seq")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    paths = traced.withColumn("step", step).groupBy("image_id", "component").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_length"), F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("path"))
    rows = classified(described(component_stats(labelled))).join(ends, ["image_id", "component"]).join(paths, ["image_id", "component"])
    points = F.transform("path", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    none = F.array().cast("array<struct<x: double, y: double>>")
    return rows.withColumns({"path": F.when(F.col("class_label") == "line_like", points).otherwise(none), "x1": F.col("x1") + 1, "y1": F.col("y1") + 1})


_AROUND = np.array([(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)])


def outline(mask: np.ndarray) -> np.ndarray:
    """The border pixels ``(x, y)`` around the piece of a mask that holds its first pixel, in order; a pixel may come twice where the piece is thin."""
    framed = np.pad(mask, 1)
    ys, xs = np.nonzero(framed)
    if not len(xs):
        return np.zeros((0, 2), int)
    at = start = (int(xs[0]), int(ys[0]))
    found, way, first = [], 6, None
    while True:
        found.append(at)
        # the next pixel clockwise, from the one after where the walk came from
        for turn in range(1, 9):
            d = (way + turn) % 8
            x, y = at[0] + int(_AROUND[d][0]), at[1] + int(_AROUND[d][1])
            if framed[y, x]:
                break
        else:
            break
        if at == start and first is not None and d == first:
            found.pop()
            break
        first = d if first is None else first
        at, way = (x, y), (d + 4) % 8
    return np.array(found) - 1


def circularity(mask: np.ndarray) -> float:
    """4 pi area / perimeter squared of the outline with the largest area, 0 for pieces without area. Area and perimeter are those of the polygon through the border pixels' centres."""
    best, out = 0.0, 0.0
    ys, xs = np.nonzero(mask)
    order = np.lexsort((ys, xs))
    xs, ys = xs[order], ys[order]
    if not len(xs):
        return 0.0
    label = _labels(xs, ys)
    for k in range(label.max() + 1):
        piece = np.zeros_like(mask, bool)
        piece[ys[label == k], xs[label == k]] = True
        p = outline(piece)
        q = np.roll(p, -1, axis=0)
        area = abs(float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())) / 2
        around = float(np.hypot(*(q - p).T).sum())
        if area > best and around > 0:
            best, out = area, 4 * np.pi * area / around**2
    return float(out)


def depth(mask: np.ndarray) -> np.ndarray:
    """The distance of each mask pixel from the background by steps to the sixteen pixels around it; what lies beyond the array doesn't count."""
    moves = [(dx, dy, STEPS[0] if not dx or not dy else STEPS[1] if abs(dx) == abs(dy) else STEPS[2]) for dx in range(-2, 3) for dy in range(-2, 3) if max(abs(dx), abs(dy)) == 1 or {abs(dx), abs(dy)} == {1, 2}]
    h, w = mask.shape
    now = np.where(mask, np.inf, 0.0)
    while True:
        framed, new = np.pad(now, 2, constant_values=np.inf), now
        for dx, dy, far in moves:
            new = np.minimum(new, framed[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w] + far)
        if np.array_equal(new, now) or not np.isfinite(new).any():
            return new
        now = new


def _marks(mask: np.ndarray) -> list[tuple]:
    """``(core, center_x, center_y, x0, y0, x1, y1, pixels, circularity)`` of a mask's compact pieces, and of the deep spots that lie on other pieces."""
    out: list[tuple] = []

    def fits(width: int, height: int, pixels: int) -> bool:
        return pixels >= MARKER_AREA and max(width, height) <= MARKER_SPAN and max(width, height) <= MARKER_ASPECT * max(1, min(width, height))

    def pieces(of: np.ndarray):
        ys, xs = np.nonzero(of)
        order = np.lexsort((ys, xs))
        xs, ys = xs[order], ys[order]
        label = _labels(xs, ys) if len(xs) else np.zeros(0, int)
        by = np.argsort(label, kind="stable")
        cuts = np.split(by, np.cumsum(np.bincount(label))[:-1]) if len(xs) else []
        # in the order of first pixels, row by row
        return sorted(((xs[c], ys[c]) for c in cuts), key=lambda p: (p[1].min(), p[0][p[1] == p[1].min()].min()))

    for xs, ys in pieces(mask):
        x0, y0, x1, y1 = int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1
        if fits(x1 - x0, y1 - y0, len(xs)):
            own = np.zeros((y1 - y0, x1 - x0), bool)
            own[ys - y0, xs - x0] = True
            out.append((False, x0 + (x1 - x0) / 2, y0 + (y1 - y0) / 2, x0, y0, x1, y1, len(xs), circularity(own)))
    deep = depth(mask)
    for xs, ys in pieces(mask & (deep >= CORE_DEPTH)):
        cx, cy = float(xs.mean()), float(ys.mean())
        reach = max(CORE_DEPTH, float(deep[ys, xs].max())) + CORE_MARGIN
        x0, y0 = max(0, round(cx - reach)), max(0, round(cy - reach))
        x1, y1 = min(mask.shape[1], round(cx + reach + 1)), min(mask.shape[0], round(cy + reach + 1))
        around = mask[y0:y1, x0:x1]
        if fits(x1 - x0, y1 - y0, int(around.sum())) and all(np.hypot(m[1] - cx, m[2] - cy) > CORE_APART for m in out):
            out.append((True, cx, cy, x0, y0, x1, y1, int(around.sum()), circularity(around)))
    return out


def marker_candidates(pixels: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """Candidates of markers in masks ``pixels(image_id, x, y)`` of a known size, or of masks that end well inside their image.

    ``(image_id, id, core, x, y, x0, y0, x1, y1, pixel_count, width, height, area_ratio, fill_ratio, aspect,
    circularity, shape, confidence, warnings)``: whole compact pieces, and spots of other pieces that are deep enough
    (``core``) and not near a candidate before them. Pixels outside the size are left out.
    """
    pixels = _placed(pixels).where("x >= 0 and y >= 0")
    if width is not None:
        pixels = pixels.where(f"x < {width} and y < {height}")
    names = ["core", "x", "y", "x0", "y0", "x1", "y1", "pixel_count", "circularity"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        size = (height, width) if width is not None else (int(group["y"].max()) + MARKER_SPAN, int(group["x"].max()) + MARKER_SPAN)
        mask = np.zeros(size, bool)
        mask[group["y"].to_numpy(), group["x"].to_numpy()] = True
        out = pd.DataFrame(_marks(mask), columns=names)
        out.insert(0, "image_id", group["image_id"].iloc[0])
        out.insert(1, "id", range(len(out)))
        return out

    kind = pixels.schema["image_id"].dataType.simpleString()
    rows = pixels.groupBy("image_id").applyInPandas(run, f"image_id {kind}, id long, core boolean, x double, y double, x0 double, y0 double, x1 double, y1 double, pixel_count long, circularity double")
    return with_shapes(rows.withColumns({"width": F.col("x1") - F.col("x0"), "height": F.col("y1") - F.col("y0")}))


def with_shapes(rows: DataFrame) -> DataFrame:
    """``rows(width, height, pixel_count, circularity, core)`` with their ratios, ``shape``, ``confidence`` and ``warnings``."""
    c = F.col
    longer, shorter = F.greatest("width", "height"), F.least("width", "height")
    rows = rows.withColumns({"area_ratio": c("pixel_count") / (longer * longer), "fill_ratio": c("pixel_count") / F.greatest(F.lit(1.0), c("width") * c("height")), "aspect": longer / F.greatest(F.lit(1.0), shorter)})
    shape = S.marker_shape(c("fill_ratio"), c("circularity"), c("aspect"))
    warnings = F.array_compact(F.array(F.when(shape == "unknown", F.lit("uncertain_shape")), F.when(c("core"), F.lit("distance_transform_candidate"))))
    return rows.withColumns({"shape": shape, "confidence": S.marker_confidence(c("fill_ratio"), c("circularity"), c("aspect")), "warnings": warnings})


def near_marker(points: DataFrame, markers: DataFrame, within: float = CORE_APART) -> DataFrame:
    """``points(image_id, id, x, y)`` that have a marker within a distance, found through cells of that width."""
    cell = lambda c, d=0: F.floor(F.col(c) / within) + d
    spots = markers.select("image_id", F.col("x").alias("mx"), F.col("y").alias("my"), cell("x").alias("gx"), cell("y").alias("gy"))
    asked = points.withColumn("g", F.explode(F.array(*[F.struct(cell("x", i).alias("gx"), cell("y", j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))).select(*points.columns, "g.gx", "g.gy")
    near = asked.join(spots, ["image_id", "gx", "gy"]).where(F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")) <= within)
    return points.join(near.select("image_id", "id").distinct(), ["image_id", "id"], "left_semi")


def summary(rows: DataFrame, kind: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of an image's rows by one of its columns, and their mean confidence."""
    return rows.groupBy("image_id").agg(F.count("*").alias("n"), *[F.count_if(F.col(kind) == v).alias(v) for v in values], F.avg("confidence").alias("mean_confidence"))
