"""Legends: boxes found from texts or pixels, their rows, samples and labels, and the prototypes these give.

Boxes of texts and pieces are filtered by expressions over a row each. A legend's crop is an array of bounded
size; its rows are read one legend a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import masks as K
from .colors import crop_bounds, cropped, lab8
from .matching import suppress

#: Padding, the gray below which a pixel counts, and what a framed or unframed legend looks like.
PAD, GRAY, MOST_TEXTS = 10.0, 245, 12
AREA, WIDTH, HEIGHT = 300, 55, 35
SHARE, DENSITY, TOP, CORNER, FRAME = (0.004, 0.20), (0.025, 0.35), 0.25, 0.06, 0.65
SEARCH, OPEN_DARK, OPEN_SIZE, OPEN_DENSITY, OPEN_SHARE, OPEN_WIDTH = (0.38, 0.45), 260, (80, 45), (0.015, 0.30), 0.14, 0.36
#: Rows and samples.
ROW_DARK, ROW_PIXELS, ROW_GAP, ROW_WIDTH, ROW_HEIGHT = 8, 12, 7, 26, (6, 40)
SAMPLE_MOST, SAMPLE_USUAL, TEXT_GAP = 70, 46, 7
BOX = ("x_min", "y_min", "x_max", "y_max")


def luma(pixels: DataFrame) -> DataFrame:
    """``pixels(r, g, b)`` with ``gray``."""
    return pixels.withColumn("gray", F.bround(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).cast("int"))


# from texts


def text_clusters(texts: DataFrame) -> DataFrame:
    """``(image_id, id, cluster)`` of ``texts(image_id, id, x_min, y_min, x_max, y_max, cx, cy)``: texts of one row are together, and rows that follow each other and overlap in x.

    A text joins the row above if it's no further from that row's height than its own height lets it; the
    height follows the row's texts slowly. One image's texts are read in order.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["cy", "id"], kind="stable", ignore_index=True)
        cy, tall = frame["cy"].to_numpy(float), (frame["y_max"] - frame["y_min"]).to_numpy(float)
        low, high = frame["x_min"].to_numpy(float), frame["x_max"].to_numpy(float)
        starts, level = [0], cy[0]
        for i in range(1, len(cy)):
            if abs(cy[i] - level) <= max(14.0, 1.2 * tall[i]):
                level = 0.7 * level + 0.3 * cy[i]
            else:
                starts.append(i)
                level = cy[i]
        left, right = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
        cluster, label, reach = -1, [], (np.inf, -np.inf)
        for a, b in zip(left, right):
            if cluster < 0 or reach[1] < a or b < reach[0]:
                cluster, reach = cluster + 1, (a, b)
            else:
                reach = (min(reach[0], a), max(reach[1], b))
            label.append(cluster)
        return pd.DataFrame({"image_id": frame["image_id"], "id": frame["id"], "cluster": np.repeat(label, np.diff([*starts, len(cy)]))})

    kind = texts.schema["image_id"].dataType.simpleString()
    return texts.select("image_id", "id", *BOX, "cx", "cy").groupBy("image_id").applyInPandas(run, f"image_id {kind}, id long, cluster int")


def _padded(x0: Column, y0: Column, x1: Column, y1: Column, left: float = PAD) -> list[Column]:
    """A box with padding, cut to the plot's (columns ``plot_`` ...)."""
    c = F.col
    return [F.greatest(c("plot_x_min"), x0 - left).alias("x_min"), F.greatest(c("plot_y_min"), y0 - PAD).alias("y_min"), F.least(c("plot_x_max"), x1 + PAD).alias("x_max"), F.least(c("plot_y_max"), y1 + PAD).alias("y_max")]


def _plots(plots: DataFrame) -> DataFrame:
    return plots.select("image_id", *[F.col(n).cast("double").alias(f"plot_{n}") for n in BOX])


def _area(prefix: str = "") -> Column:
    return (F.col(f"{prefix}x_max") - F.col(f"{prefix}x_min")) * (F.col(f"{prefix}y_max") - F.col(f"{prefix}y_min"))


def text_legends(texts: DataFrame, plots: DataFrame) -> DataFrame:
    """``(image_id, x_min, y_min, x_max, y_max, confidence, text_ids, source)``: boxes around clusters of few texts inside the plot."""
    c = F.col
    box = tuple(c(f"plot_{n}") for n in BOX)
    inside = texts.join(_plots(plots), "image_id").where(S.contains(box, c("cx"), c("cy"))).select(*texts.columns)
    rows = inside.join(text_clusters(inside), ["image_id", "id"]).groupBy("image_id", "cluster").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("text_ids"), F.min("x_min").alias("x0"), F.min("y_min").alias("y0"), F.max("x_max").alias("x1"), F.max("y_max").alias("y1"))
    rows = rows.where(c("n") <= MOST_TEXTS).join(_plots(plots), "image_id")
    rows = rows.select("*", *_padded(c("x0"), c("y0"), c("x1"), c("y1"), PAD + 35.0)).where("x_max > x_min and y_max > y_min")
    rows = rows.where(_area() / F.greatest(_area("plot_"), F.lit(1.0)) <= 0.25)
    return rows.select("image_id", *BOX, F.least(F.lit(1.0), 0.25 + 0.15 * c("n")).alias("confidence"), "text_ids", F.lit("heuristic").alias("source"))


# from pixels


def frame_scores(labelled: DataFrame, stats: DataFrame) -> DataFrame:
    """``stats`` with ``frame``: the least share of a side of the piece's box that its pixels along that side cover; 0 for boxes under six pixels."""
    c = F.col
    shorter = F.least("height", "width")
    t = F.least(F.lit(3), F.greatest(F.lit(1), F.floor(shorter / 12)))
    rows = labelled.join(stats.withColumn("t", t), ["image_id", "component"])
    on = lambda test, across: F.count_distinct(F.when(test, c(across)))
    covered = rows.groupBy("image_id", "component").agg(
        on(c("y") < c("y0") + c("t"), "x").alias("top"), on(c("y") > c("y1") - c("t"), "x").alias("bottom"),
        on(c("x") < c("x0") + c("t"), "y").alias("left"), on(c("x") > c("x1") - c("t"), "y").alias("right"),
    )
    out = stats.join(covered, ["image_id", "component"])
    score = F.least(c("top") / c("width"), c("bottom") / c("width"), c("left") / c("height"), c("right") / c("height"))
    return out.withColumn("frame", F.when(shorter < 6, 0.0).otherwise(score)).drop("top", "bottom", "left", "right")


def candidate_score(share: Column, density: Column, frame: Column) -> Column:
    one = F.lit(1.0)
    score = 0.35 + 0.30 * F.least(one, share / 0.05) + 0.20 * (1.0 - F.least(one, F.abs(density - 0.08) / 0.08)) + 0.15 * frame
    return F.greatest(F.lit(0.15), F.least(one, score))


def near_corner(x: Column, y: Column, width: Column, height: Column, w: Column, h: Column) -> Column:
    w, h = F.greatest(w, F.lit(1)), F.greatest(h, F.lit(1))
    side = (x / w <= CORNER) | ((x + width) / w >= 1.0 - CORNER)
    return side & ((y / h <= CORNER) | ((y + height) / h >= 1.0 - CORNER))


def _framed(dark: DataFrame, plots: DataFrame) -> DataFrame:
    """Boxes and scores of compact pieces of middling density near the top, a corner, or with a frame."""
    c = F.col
    labelled = K.label_components(dark)
    size = plots.select("image_id", (c("cx1") - c("cx0")).alias("w"), (c("cy1") - c("cy0")).alias("h"))
    stats = K.component_stats(labelled).join(size, "image_id")
    box = F.greatest(F.lit(1), c("width") * c("height"))
    stats = stats.withColumns({"share": box / F.greatest(F.lit(1), c("w") * c("h")), "density": c("area") / box})
    stats = stats.where((c("area") >= AREA) & (c("width") >= WIDTH) & (c("height") >= HEIGHT) & c("share").between(*SHARE) & c("density").between(*DENSITY))
    rows = frame_scores(labelled, stats)
    near = (c("y0") / F.greatest(c("h"), F.lit(1)) <= TOP) | near_corner(c("x0"), c("y0"), c("width"), c("height"), c("w"), c("h")) | (c("frame") >= FRAME)
    rows = rows.where(near)
    return rows.select("image_id", "x0", "y0", "width", "height", candidate_score(c("share"), c("density"), c("frame")).alias("confidence"))


def _open_boxes(dark: np.ndarray) -> list[tuple]:
    """``(x, y, width, height, confidence)`` of clusters in the upper right part of a plot: pixels that are joined when grown to 13 by 5, drawn down over rows that follow."""
    h, w = dark.shape
    left, bottom = int(max(0, w * (1.0 - SEARCH[0]))), int(max(1, h * SEARCH[1]))
    part, out = dark[:bottom, left:], []
    ys, xs = np.nonzero(part)
    if not len(xs):
        return out
    sums = np.pad(np.cumsum(np.cumsum(np.pad(part.astype(int), ((2, 2), (6, 6))), axis=0), axis=1), ((1, 0), (1, 0)))
    grown = (sums[5:, 13:] - sums[:-5, 13:] - sums[5:, :-13] + sums[:-5, :-13]) > 0
    gy, gx = np.nonzero(grown)
    order = np.lexsort((gy, gx))
    gx, gy = gx[order], gy[order]
    label = K._labels(gx, gy)
    for k in range(label.max() + 1):
        x0, x1, y0, y1 = (int(v) for v in (gx[label == k].min(), gx[label == k].max() + 1, gy[label == k].min(), gy[label == k].max() + 1))
        below = np.flatnonzero(part[y1:, max(0, x0 - 8) : x1 + 8].sum(axis=1) >= 4)
        # rows of the legend follow while no gap is over 28 pixels
        if len(below) and below[0] <= 28:
            far = np.flatnonzero(np.diff(below) > 29)
            y1 += int(below[far[0] if len(far) else -1]) + 1
        width, height, n = x1 - x0, y1 - y0, int(part[y0:y1, x0:x1].sum())
        density = n / max(1, width * height)
        if n >= OPEN_DARK and width >= OPEN_SIZE[0] and height >= OPEN_SIZE[1] and width / max(w, 1) <= OPEN_WIDTH and OPEN_DENSITY[0] <= density <= OPEN_DENSITY[1]:
            out.append((left + x0, y0, width, height, min(1.0, 0.45 + 0.30 * min(1.0, n / 900.0) + 0.25 * min(1.0, width / 180.0))))
    return out


def pixel_legends(pixels: DataFrame, plots: DataFrame) -> DataFrame:
    """``(image_id, x_min, y_min, x_max, y_max, confidence, source)``: legends found in the pixels of a plot, the surest first of those that overlap.

    ``plots`` as in ``colors.crop_bounds``. Images without a framed legend are searched for an unframed one.
    """
    c = F.col
    bounds = crop_bounds(plots, 0)
    dark = cropped(luma(pixels).where(c("gray") < GRAY), bounds).select("image_id", (c("x") - c("cx0")).alias("x"), (c("y") - c("cy0")).alias("y"), "cx0", "cy0", "cx1", "cy1")
    framed = _framed(dark, bounds)
    kind = pixels.schema["image_id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        w, h = (int(group[f"c{n}1"].iloc[0] - group[f"c{n}0"].iloc[0]) for n in "xy")
        spots = np.zeros((h, w), bool)
        spots[group["y"].to_numpy(), group["x"].to_numpy()] = True
        out = pd.DataFrame(_open_boxes(spots), columns=["x0", "y0", "width", "height", "confidence"])
        out.insert(0, "image_id", group["image_id"].iloc[0])
        return out

    rest = dark.join(framed.select("image_id").distinct(), "image_id", "left_anti")
    open_ = rest.groupBy("image_id").applyInPandas(run, f"image_id {kind}, x0 long, y0 long, width long, height long, confidence double").withColumn("open", F.lit(True))
    rows = framed.withColumn("open", F.lit(False)).unionByName(open_).join(bounds, "image_id").join(_plots(plots), "image_id")
    x0, y0 = c("cx0") + c("x0"), c("cy0") + c("y0")
    rows = rows.select("*", *_padded(x0, y0, x0 + c("width"), y0 + c("height"))).where("x_max > x_min and y_max > y_min")
    rows = rows.where(~c("open") | (_area() / F.greatest(_area("plot_"), F.lit(1.0)) <= OPEN_SHARE))
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("y_min", "x_min", "x_max", "y_max"))
    boxes = rows.select("image_id", number.cast("long").alias("id"), c("x_min").alias("x0"), c("y_min").alias("y0"), c("x_max").alias("x1"), c("y_max").alias("y1"), c("confidence").alias("score"))
    kept = suppress(boxes, 0.4, 0.85)
    return kept.select("image_id", *[c(a).alias(b) for a, b in zip(("x0", "y0", "x1", "y1"), BOX)], c("score").alias("confidence"), F.lit("image_heuristic").alias("source"))


def merge_legends(legends: DataFrame) -> DataFrame:
    """``legends`` without those that overlap a surer one of their image, numbered from 0 by falling confidence as ``legend_index``."""
    c = F.col
    order = Window.partitionBy("image_id").orderBy(c("confidence").desc(), "y_min", "x_min", "x_max", "y_max", "source")
    rows = legends.withColumn("id", F.row_number().over(order).cast("long"))
    boxes = rows.select("image_id", "id", c("x_min").alias("x0"), c("y_min").alias("y0"), c("x_max").alias("x1"), c("y_max").alias("y1"), c("confidence").alias("score"))
    kept = suppress(boxes, 0.4).select("image_id", "id")
    rows = rows.join(kept, ["image_id", "id"], "left_semi")
    return rows.withColumn("legend_index", F.row_number().over(Window.partitionBy("image_id").orderBy("id")) - 1).drop("id")


# rows of a legend


def without_frame(mask: np.ndarray) -> np.ndarray:
    """The mask without rows and columns at its edges that are dark for nearly half their length."""
    h, w = mask.shape
    out = mask.copy()
    if min(h, w) < 8:
        return out
    t = min(4, max(1, min(h, w) // 20))
    rows, cols = np.r_[0:t, h - t : h], np.r_[0:t, w - t : w]
    out[rows[out[rows].sum(axis=1) > 0.45 * w]] = False
    out[:, cols[out[:, cols].sum(axis=0) > 0.45 * h]] = False
    return out


def item_rows(mask: np.ndarray) -> list[tuple[int, int]]:
    """First and last row (excluded) of each item of a legend's mask without its frame."""
    active = np.flatnonzero(mask.sum(axis=1) >= ROW_DARK)
    found: list[tuple[int, int]] = []
    for run in np.split(active, np.flatnonzero(np.diff(active) > ROW_GAP) + 1) if len(active) else []:
        y0, y1 = max(0, int(run[0]) - 2), min(len(mask), int(run[-1]) + 4)
        columns = np.flatnonzero(mask[y0:y1].any(axis=0))
        if not len(columns) or mask[y0:y1].sum() < ROW_PIXELS or columns[-1] - columns[0] + 1 < ROW_WIDTH or not ROW_HEIGHT[0] <= y1 - y0 <= ROW_HEIGHT[1]:
            continue
        # a low row close under another is that one's tail
        if found and y0 <= found[-1][1] + 4 and y1 - y0 <= 12:
            continue
        found.append((y0, y1))
    return found


def sample_end(active: np.ndarray, x0: int, x1: int) -> int:
    """Where the sample ends in a row whose dark columns are ``active``: before the widest gap that lies where a sample can end, else at the usual width."""
    if len(active) > 1:
        gaps = np.diff(active) - 1
        ends = active[:-1]
        fits = (gaps >= TEXT_GAP) & (ends >= x0 + 12) & (ends <= min(x1, x0 + SAMPLE_MOST))
        if fits.any():
            return int(ends[np.where(fits, gaps, -1).argmax()]) + 1
    return min(x1, x0 + SAMPLE_USUAL)


def _pieces(mask: np.ndarray) -> list[tuple[int, int, int]]:
    """Width, height and area of a mask's pieces."""
    ys, xs = np.nonzero(mask)
    if not len(xs):
        return []
    order = np.lexsort((ys, xs))
    xs, ys = xs[order], ys[order]
    label = K._labels(xs, ys)
    return [(int(np.ptp(xs[label == k])) + 1, int(np.ptp(ys[label == k])) + 1, int((label == k).sum())) for k in range(label.max() + 1)]


def sample_line_style(mask: np.ndarray) -> str:
    """solid, dashed, dotted or unknown, by the pieces of a sample that two by two pixels fit in (all pieces, where none does)."""
    blocks = mask[:-1, :-1] & mask[1:, :-1] & mask[:-1, 1:] & mask[1:, 1:]
    opened = np.zeros_like(mask)
    for dy in (0, 1):
        for dx in (0, 1):
            opened[dy : dy + blocks.shape[0], dx : dx + blocks.shape[1]] |= blocks
    pieces = [p for p in _pieces(opened if opened.any() else mask) if p[2] >= 2]
    if not pieces:
        return "unknown"
    if len(pieces) <= 2 and max(w for w, _, _ in pieces) >= 18:
        return "solid"
    if sum(max(w, h) <= 8 for w, h, _ in pieces) >= 4:
        return "dotted"
    return "dashed" if len(pieces) >= 3 else "unknown"


def sample_marker_style(mask: np.ndarray) -> str:
    """repeated_compact, single_compact or unknown, by the small pieces about as wide as high."""
    n = sum(a >= 3 and max(w, h) <= 14 and abs(w - h) <= 5 for w, h, a in _pieces(mask))
    return "repeated_compact" if n >= 2 else "single_compact" if n else "unknown"


def sample_color(rgb: np.ndarray, gray: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None, int]:
    """Mean colour of a sample's typical dark pixels, its Lab, and the number of dark pixels."""
    dark = gray < GRAY
    n = int(dark.sum())
    if not n:
        return None, None, 0
    tones = gray[dark]
    typical = np.abs(tones - np.percentile(tones, 20)) <= 8
    if typical.sum() < max(3, n // 12):
        typical = tones <= np.percentile(tones, 35)
    mean = rgb[dark][typical].mean(axis=0)
    return np.rint(mean), lab8(np.floor(mean)), n


ITEM = (
    "row int, x_min double, y_min double, x_max double, y_max double, sample array<double>, text array<double>, r int, g int, b int, l double, a double, b2 double, "
    "foreground long, line_style string, marker_style string, confidence double, warnings array<string>"
)


def legend_items(pixels: DataFrame, legends: DataFrame, sizes: DataFrame) -> DataFrame:
    """The items of ``legends(image_id, legend_index, x_min, ...)``: ``image_id``, ``legend_index``, ``item_id`` and ITEM.

    ``sample`` and ``text`` are boxes (x_min, y_min, x_max, y_max), ``text`` null where none is left of it.
    ``sizes`` has ``(image_id, width, height)``. A legend is read with a margin of two pixels, which samples reach into.
    """
    c = F.col
    cut = [F.greatest(F.lit(0), F.bround("x_min").cast("int")).alias("lx0"), F.greatest(F.lit(0), F.bround("y_min").cast("int")).alias("ly0")]
    cut += [F.least(c("width"), F.bround("x_max").cast("int")).alias("lx1"), F.least(c("height"), F.bround("y_max").cast("int")).alias("ly1")]
    boxes = legends.join(sizes.select("image_id", "width", "height"), "image_id").select("image_id", "legend_index", *cut).where("lx1 > lx0 and ly1 > ly0")
    rows = luma(pixels).join(boxes, "image_id").where((c("x") >= c("lx0") - 2) & (c("x") < c("lx1") + 2) & (c("y") >= c("ly0") - 2) & (c("y") < c("ly1") + 2))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x0, y0, x1, y1 = (int(group[n].iloc[0]) for n in ("lx0", "ly0", "lx1", "ly1"))
        rgb, gray = np.full((y1 - y0 + 4, x1 - x0 + 4, 3), 255), np.full((y1 - y0 + 4, x1 - x0 + 4), 255)
        at = (group["y"].to_numpy() - y0 + 2, group["x"].to_numpy() - x0 + 2)
        rgb[at], gray[at] = group[["r", "g", "b"]].to_numpy(), group["gray"].to_numpy()
        mask, out = without_frame(gray[2:-2, 2:-2] < GRAY), []

        def box(a: int, top: int, b: int, bottom: int) -> list[float]:
            return [x0 + a - 2.0, y0 + top - 2.0, x0 + b + 2.0, y0 + bottom + 2.0]

        for row, (top, bottom) in enumerate(item_rows(mask)):
            active = np.flatnonzero(mask[top:bottom].any(axis=0))
            first, last = int(active[0]), int(active[-1]) + 1
            split = sample_end(active, first, last)
            end = split if split - first >= 8 else min(last, first + SAMPLE_USUAL)
            end = min(end, first + SAMPLE_MOST)
            words = min(last, max(end + TEXT_GAP, split + 1))
            # the box of the sample, padded by two pixels, in the padded array
            colour, lab, n = sample_color(rgb[top : bottom + 4, first : end + 4], gray[top : bottom + 4, first : end + 4])
            sample, said = mask[top:bottom, first:end], []
            confidence = min(1.0, 0.35 + n / 80.0)
            if n < ROW_PIXELS:
                said.append("low_sample_foreground")
            if words >= last:
                said.append("text_region_not_found")
                confidence = min(confidence, 0.65)
            text = box(words, top, last, bottom) if words < last else None
            out.append((row, *box(first, top, last, bottom), box(first, top, end, bottom), text, *(colour.astype(int) if n else (None,) * 3), *(lab if n else (None,) * 3), n, sample_line_style(sample), sample_marker_style(sample), confidence, said))
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in ITEM.split(", ")])
        frame.insert(0, "image_id", group["image_id"].iloc[0])
        frame.insert(1, "legend_index", group["legend_index"].iloc[0])
        return frame

    kind = pixels.schema["image_id"].dataType.simpleString()
    found = rows.groupBy("image_id", "legend_index").applyInPandas(run, f"image_id {kind}, legend_index int, {ITEM}")
    two = lambda e: F.lpad(e.cast("string"), 2, "0")
    return found.withColumn("item_id", F.concat(F.lit("legend_"), two(c("legend_index")), F.lit("_item_"), two(c("row"))))


def assign_labels(items: DataFrame, texts: DataFrame) -> DataFrame:
    """``items`` with ``label``: the texts ``(image_id, id, text, x_min, ..., cx, cy)`` whose centre lies in the item's text box or that share a fifth with it, from top to bottom and left to right.

    Without one the label is null and a warning says why; images without any text stay as they are.
    """
    c = F.col
    spot = tuple(F.get("text", F.lit(i)) for i in range(4))
    clean = S.normalize_label(c("said"))
    words = texts.select("image_id", c("id").alias("text_id"), c("text").alias("said"), *[c(n).alias(f"t_{n}") for n in BOX], "cx", "cy").where(F.length(clean) > 0)
    box = tuple(c(f"t_{n}") for n in BOX)
    met = items.select("image_id", "item_id", "text").join(words, "image_id").where(S.contains(spot, c("cx"), c("cy")) | (S.bbox_containment(box, spot) >= 0.2))
    found = met.groupBy("image_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("t_y_min", "t_x_min", "text_id", "said"))).alias("m"))
    found = found.select("image_id", "item_id", S.normalize_label(F.array_join(F.transform("m", lambda s: s["said"]), " ")).alias("label"))
    any_ = texts.select("image_id").distinct().withColumn("__any", F.lit(True))
    rows = items.join(found, ["image_id", "item_id"], "left").join(any_, "image_id", "left")
    why = F.when(c("text").isNull(), "legend_label_missing_text_bbox").when(c("label").isNull(), "legend_label_missing")
    more = F.when(c("__any") & why.isNotNull(), F.array(why)).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("warnings", F.concat("warnings", more)).drop("__any")


def visual_prototypes(items: DataFrame) -> DataFrame:
    """The items with a colour as prototypes, numbered through an image's legends."""
    rows = items.where("r is not null and l is not null")
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("legend_index", "row")) - 1
    name = F.concat(F.lit("legend_proto_"), F.lpad(number.cast("string"), 2, "0"))
    label = F.col("label") if "label" in items.columns else F.lit(None).cast("string").alias("label")
    return rows.select("image_id", number.alias("number"), name.alias("prototype_id"), F.col("item_id").alias("legend_item_id"), "r", "g", "b", "l", "a", "b2", F.col("sample"), label, "line_style", "marker_style", "confidence", F.lit("legend_item").alias("source"))
