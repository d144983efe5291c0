"""Colours of curves in an image: regions of like colour, their palette, prototypes and masks.

Regions grow from pixel to pixel and need an image as an array; one image is a group. All else is expressions
over a row a region, prototype or pixel.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import masks as K
from .matching import palette


@dataclass(frozen=True)
class Coloring:
    """Tolerance and least sizes of regions, bounds of lightness and chroma, and how near merged colours are."""

    step: int = 1
    tolerance: int = 15
    least_area: int = 2
    lightness: tuple[int, int] = (10, 240)
    least_chroma: int = 10
    merge_l: float = 80.0
    merge_ab: float = 20.0
    share: tuple[float, float] = (0.001, 0.90)
    inset: int = 3
    achromatic: bool = True
    achromatic_area: int = 8
    dark: int = 95
    gray: tuple[int, int] = (95, 195)
    gray_chroma: float = 12.0


#: For gray curves that a legend tells apart: finer merging and lighter grays.
FINE = replace(Coloring(), merge_l=18.0, gray=(95, 240), lightness=(10, 255))
_TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def lab8(rgb: np.ndarray) -> np.ndarray:
    """8-bit Lab of 8-bit RGB, rounded; see ``masks.lab``."""
    c = np.asarray(rgb, float) / 255
    t = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4) @ _TO_XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    light = np.where(t[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * t[..., 1])
    out = np.stack([light * 2.55, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)
    return np.clip(np.rint(out), 0, 255)


def rgb8(lab: np.ndarray) -> np.ndarray:
    """8-bit RGB of 8-bit Lab, the inverse of ``lab8`` but for rounding and colours that RGB lacks."""
    lab = np.asarray(lab, float)
    light = lab[..., 0] / 2.55
    y = np.where(light > 7.9996, ((light + 16) / 116) ** 3, light / 903.3)
    fy = np.where(light > 7.9996, (light + 16) / 116, 7.787 * y + 16 / 116)
    f = np.stack([fy + (lab[..., 1] - 128) / 500, fy, fy - (lab[..., 2] - 128) / 200], axis=-1)
    t = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787) * _WHITE
    c = np.clip(t @ np.linalg.inv(_TO_XYZ).T, 0, 1)
    return np.clip(np.rint(255 * np.where(c <= 0.0031308, 12.92 * c, 1.055 * c ** (1 / 2.4) - 0.055)), 0, 255)


def crop_bounds(plots: DataFrame, inset: int = Coloring.inset) -> DataFrame:
    """``(image_id, cx0, cy0, cx1, cy1)``: whole-pixel bounds of ``plots(image_id, width, height, x_min, y_min, x_max, y_max)`` within the image, moved in on all sides where that leaves something; a null box is the image."""
    c = F.col
    low = lambda e: F.greatest(F.lit(0), F.coalesce(e, F.lit(0)).cast("int"))
    high = lambda e, side: F.least(c(side), F.coalesce(e.cast("int"), c(side)))
    rows = plots.select("image_id", low(c("x_min")).alias("x0"), low(c("y_min")).alias("y0"), high(c("x_max"), "width").alias("x1"), high(c("y_max"), "height").alias("y1"), c("x_min").isNotNull().alias("boxed"))
    room = c("boxed") & (c("x1") - c("x0") > 2 * inset) & (c("y1") - c("y0") > 2 * inset)
    by = F.when(room, inset).otherwise(0)
    return rows.select("image_id", *[(c(n) + s * by).cast("int").alias(f"c{n}") for n, s in (("x0", 1), ("y0", 1), ("x1", -1), ("y1", -1))])


def cropped(pixels: DataFrame, bounds: DataFrame) -> DataFrame:
    """``pixels`` inside the bounds of their image, with these."""
    c = F.col
    return pixels.join(bounds, "image_id").where((c("x") >= c("cx0")) & (c("x") < c("cx1")) & (c("y") >= c("cy0")) & (c("y") < c("cy1")))


def _grow(lab: np.ndarray, start: int, width: int, tolerance: int) -> np.ndarray:
    """Places of the flat array that edges join to ``start`` over colours within the tolerance of its colour."""
    seed, size = lab[start], len(lab)
    seen, front, found = {start}, [start], [start]
    while front:
        at = np.array(front)
        around = np.concatenate([at[at % width > 0] - 1, at[at % width < width - 1] + 1, at[at >= width] - width, at[at < size - width] + width])
        around = around[(np.abs(lab[around] - seed) <= tolerance).all(axis=1)]
        front = [i for i in set(around.tolist()) if i not in seen]
        seen.update(front)
        found += front
    return np.array(found)


def regions(lab: np.ndarray, excluded: np.ndarray, rule: Coloring = Coloring()) -> tuple[np.ndarray, np.ndarray]:
    """Mean colours and areas of an image's regions: coloured ones grown from each pixel not yet in one, then pieces of dark and of gray pixels."""
    h, w = excluded.shape
    flat, centred = lab.reshape(-1, 3), lab.reshape(-1, 3)[:, 1:] - 128
    light, chroma = flat[:, 0], np.hypot(centred[:, 0], centred[:, 1])
    done = (light < rule.lightness[0]) | (light > rule.lightness[1]) | (chroma < rule.least_chroma) | excluded.ravel()
    on_step = np.zeros((h, w), bool)
    on_step[:: rule.step, :: rule.step] = True
    colours, areas = [], []
    for start in np.flatnonzero(~done & on_step.ravel()).tolist():
        if done[start]:
            continue
        mine = _grow(flat, start, w, rule.tolerance)
        done[mine] = True
        mean = flat[mine].mean(axis=0)
        if len(mine) >= rule.least_area and rule.lightness[0] <= mean[0] <= rule.lightness[1] and np.hypot(*(mean[1:] - 128)) >= rule.least_chroma:
            colours.append(mean)
            areas.append(len(mine))
    if rule.achromatic:
        for spots in (light <= rule.dark, (chroma <= rule.gray_chroma) & (light >= rule.gray[0]) & (light <= rule.gray[1])):
            ys, xs = np.nonzero(spots.reshape(h, w))
            if not len(xs):
                continue
            order = np.lexsort((ys, xs))
            label = K._labels(xs[order], ys[order])
            at = (ys * w + xs)[order]
            size = np.bincount(label)
            means = np.stack([np.bincount(label, flat[at, k]) / size for k in range(3)], axis=1)
            colours += list(means[size >= rule.achromatic_area])
            areas += size[size >= rule.achromatic_area].tolist()
    return np.array(colours).reshape(-1, 3), np.array(areas, float)


PROTOTYPE = "curve_id string, r int, g int, b int, l double, a double, b2 double, area long, ratio double, confidence double, source string"


def prototypes(pixels: DataFrame, plots: DataFrame, exclusions: DataFrame | None = None, rule: Coloring = Coloring(), source: str = "direct") -> DataFrame:
    """The colours of each image's curves: ``image_id`` and PROTOTYPE, numbered as they were found.

    ``pixels(image_id, x, y, r, g, b)``; ``plots`` as in ``crop_bounds``; ``exclusions(image_id, x_min, y_min,
    x_max, y_max)`` are boxes whose pixels start no coloured region. Repeated pixels count once. An image
    without regions has no rows.
    """
    kind = pixels.schema["image_id"].dataType.simpleString()
    rows = cropped(pixels.select("image_id", "x", "y", "r", "g", "b"), crop_bounds(plots, rule.inset))
    rows = rows.withColumn("out", F.lit(False)) if exclusions is None else _marked(rows, exclusions)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x0, y0, x1, y1 = (int(group[c].iloc[0]) for c in ("cx0", "cy0", "cx1", "cy1"))
        w, h = x1 - x0, y1 - y0
        at = (group["y"].to_numpy() - y0, group["x"].to_numpy() - x0)
        rgb, out = np.full((h, w, 3), 255), np.zeros((h, w), bool)
        rgb[at] = group[["r", "g", "b"]].to_numpy()
        out[at] = group["out"].to_numpy()
        found, areas = regions(lab8(rgb), out, rule)
        centres, mass, _ = palette(found, areas, rule.merge_l, rule.merge_ab)
        share = mass / max(w * h, 1)
        kept = (share >= rule.share[0]) & (share <= rule.share[1])
        centres, mass, share = centres[kept], mass[kept], share[kept]
        colour = rgb8(np.floor(centres)).astype(int)
        frame = pd.DataFrame({"curve_id": pd.Series([f"curve_color_{i}" for i in range(len(mass))], dtype=object), "r": colour[:, 0], "g": colour[:, 1], "b": colour[:, 2], "l": centres[:, 0], "a": centres[:, 1], "b2": centres[:, 2], "area": mass.astype(int), "ratio": share, "confidence": np.clip(share / max(10 * rule.share[0], 1e-9), 0, 1), "source": pd.Series([source] * len(mass), dtype=object)})
        frame.insert(0, "image_id", group["image_id"].iloc[0])
        return frame

    return rows.groupBy("image_id").applyInPandas(run, f"image_id {kind}, {PROTOTYPE}")


def _marked(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cropped ``rows`` with ``out``: whether a box holds the pixel; bounds are cut to whole pixels counted from the crop's corner."""
    c = F.col
    held = boxes.groupBy("image_id").agg(F.collect_list(F.struct("x_min", "y_min", "x_max", "y_max")).alias("__boxes"))

    def inside(b: Column) -> Column:
        cut = lambda v, o: F.greatest((v - o).cast("int"), F.lit(0)) + o
        return (c("x") >= cut(b["x_min"], c("cx0"))) & (c("x") < cut(b["x_max"], c("cx0"))) & (c("y") >= cut(b["y_min"], c("cy0"))) & (c("y") < cut(b["y_max"], c("cy0")))

    return rows.join(held, "image_id", "left").withColumn("out", F.coalesce(F.exists("__boxes", inside), F.lit(False))).drop("__boxes")


def guided_prototypes(pixels: DataFrame, plots: DataFrame, levels: DataFrame, wanted: int, exclusions: DataFrame | None = None) -> DataFrame:
    """``prototypes``, found again with finer grays (source ``guided_gray``) in images that have fewer than ``wanted`` though the lightness ``levels(image_id, l)`` of their legend tells so many apart; the finer ones stand if they are more."""
    found = prototypes(pixels, plots, exclusions)
    spread = levels.where("l is not null").groupBy("image_id").agg(F.count("*").alias("n"), (F.max("l") - F.min("l")).alias("range"))
    counts = found.groupBy("image_id").agg(F.count("*").alias("found"))
    asked = spread.join(counts, "image_id", "left").where((F.col("n") >= wanted) & (F.col("range") >= 18) & (F.coalesce("found", F.lit(0)) < wanted))
    fine = prototypes(pixels.join(asked.select("image_id"), "image_id", "left_semi"), plots, exclusions, FINE, "guided_gray")
    more = fine.groupBy("image_id").agg(F.count("*").alias("fine")).join(counts, "image_id", "left").where(F.col("fine") > F.coalesce("found", F.lit(0))).select("image_id")
    return found.join(more, "image_id", "left_anti").unionByName(fine.join(more, "image_id", "left_semi"))


def is_gray_prototype(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    """Whether a prototype is a gray that isn't dark: dark pixels' edges look like it."""
    return (F.hypot(a - 128.0, b - 128.0) <= 14.0) & (l > 80)


def prototype_masks(pixels: DataFrame, plots: DataFrame, prototypes: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """``(image_id, curve_id, x, y)``: each prototype's pixels in the plot, cleaned.

    Close in colour (closer in lightness for guided grays), outside the exclusions, away from dark pixels
    for grays, and in pieces that aren't frames, grid lines, ticks or specks.
    """
    c = F.col
    rows = cropped(pixels, crop_bounds(plots))
    light, a, b = K.lab(c("r"), c("g"), c("b"))
    rows = rows.select("image_id", "x", "y", "cx0", "cy0", "cx1", "cy1", *[F.round(v).alias(n) for v, n in ((light, "pl"), (a, "pa"), (b, "pb"))])
    if exclusions is not None:
        rows = _marked(rows, exclusions).where("not out").drop("out")
    reach = F.when(c("source") == "guided_gray", 24.0).otherwise(55.0)
    near = rows.join(prototypes.select("image_id", "curve_id", "l", "a", "b2", "source"), "image_id")
    near = near.where((F.abs(c("pl") - c("l")) <= reach) & (F.hypot(c("pa") - c("a"), c("pb") - c("b2")) <= 16.0))
    near = near.withColumn("gray", is_gray_prototype(c("l"), c("a"), c("b2"))).select("image_id", "curve_id", "x", "y", "gray", "cx0", "cy0", "cx1", "cy1")
    bright = K.suppress_dark(near.where("gray"), rows.select("image_id", "x", "y", c("pl").alias("l"))).select(*near.columns)
    near = near.where("not gray").unionByName(bright)
    # one mask a prototype: its key stands for the image from here on
    key = F.struct("image_id", "curve_id")
    near = near.select(key.alias("mask"), (c("x") - c("cx0")).alias("x"), (c("y") - c("cy0")).alias("y"), "cx0", "cy0", (c("cx1") - c("cx0")).alias("w"), (c("cy1") - c("cy0")).alias("h"))
    text = F.to_json("mask")
    near = near.withColumn("image_id", text)
    labelled = K.label_components(near)
    of = near.groupBy("image_id").agg(*[F.first(n).alias(n) for n in ("mask", "cx0", "cy0", "w", "h")])
    stats = K.component_stats(labelled).join(of, "image_id")
    kept = K.keep_components(stats, c("w"), c("h")).select("image_id", "component", "mask", "cx0", "cy0")
    return labelled.join(kept, ["image_id", "component"]).select("mask.image_id", "mask.curve_id", (c("x") + c("cx0")).alias("x"), (c("y") + c("cy0")).alias("y"))


def mask_rows(masks: DataFrame, prototypes: DataFrame) -> DataFrame:
    """One row for each prototype: pixels, box (last pixels included) and confidence of its mask, the share of the prototype's area; an empty mask has a warning."""
    c = F.col
    found = masks.groupBy("image_id", "curve_id").agg(F.count("*").alias("pixel_count"), *[f(n).cast("double").alias(o) for f, n, o in ((F.min, "x", "x_min"), (F.min, "y", "y_min"), (F.max, "x", "x_max"), (F.max, "y", "y_max"))])
    rows = prototypes.select("image_id", "curve_id", "area").join(found, ["image_id", "curve_id"], "left").withColumn("pixel_count", F.coalesce("pixel_count", F.lit(0)))
    confidence = F.when(c("area") > 0, F.least(F.lit(1.0), c("pixel_count") / c("area"))).otherwise(0.0)
    return rows.withColumns({"confidence": confidence, "warnings": F.array_compact(F.array(F.when(c("pixel_count") == 0, F.lit("empty mask"))))}).drop("area")
