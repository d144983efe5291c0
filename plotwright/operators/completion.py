"""Loose ends and short lines joined: the best matching of ends, and lines in one direction made into longer ones.

An image's ends and lines are few; each image is a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import masks as K

#: A cost that stands for "not allowed".
NEVER = 1e9


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in the cheapest one-to-one choice of a square matrix, by shortest augmenting paths."""
    n = len(cost)
    u, v, row_of = np.zeros(n), np.zeros(n + 1), np.full(n + 1, -1)
    for row in range(n):
        row_of[n], at = row, n
        least, before, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[at] >= 0:
            done[at] = True
            i, free = row_of[at], ~done[:n]
            new = cost[i] - u[i] - v[:n]
            better = free & (new < least)
            least[better], before[better] = new[better], at
            step = least[free].min()
            nearest = int(np.flatnonzero(free)[least[free].argmin()])
            u[row_of[done]] += step
            v[done] -= step
            least[free] -= step
            at = nearest
        while at != n:
            row_of[at] = row_of[before[at]]
            at = before[at]
    out = np.empty(n, int)
    out[row_of[:n]] = np.arange(n)
    return out


def segments(skeleton: DataFrame, least: int = 5) -> DataFrame:
    """``(image_id, component, x, y)``: the pixels of a skeleton's pieces of at least so many pixels."""
    labelled = K.label_components(skeleton)
    n = F.count("*").over(Window.partitionBy("image_id", "component"))
    return labelled.withColumn("__n", n).where(F.col("__n") >= least).drop("__n")


def connect_ends(ends: DataFrame, most: float = 50.0) -> DataFrame:
    """``(image_id, a, b, distance)``: ends ``(image_id, id, piece, x, y)`` of different pieces matched for the least total distance, none over ``most``.

    Each end is given a partner in one assignment of all ends to all ends; of two ends that choose differently the
    earlier one's choice counts, and each end is used once.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        x, y, piece, ids = (frame[c].to_numpy() for c in ("x", "y", "piece", "id"))
        far = np.hypot(x[:, None] - x, y[:, None] - y)
        cost = np.where((far > most) | (piece[:, None] == piece), NEVER, far)
        used, out = set(), []
        for i, j in enumerate(assignment(cost).tolist()):
            if i < j and cost[i, j] < NEVER / 10 and not {i, j} & used:
                used |= {i, j}
                out.append((frame["image_id"].iloc[0], ids[i], ids[j], far[i, j]))
        return pd.DataFrame(out, columns=["image_id", "a", "b", "distance"])

    kind = ends.schema["image_id"].dataType.simpleString()
    return ends.select("image_id", "id", "piece", F.col("x").cast("double"), F.col("y").cast("double")).groupBy("image_id").applyInPandas(run, f"image_id {kind}, a long, b long, distance double")


def directed(lines: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """``lines(image_id, x0, y0, x1, y1)`` with ``angle`` (0 to 180), ``length`` and ``way``: ``h``, ``v`` or null."""
    c = F.col
    dx, dy = c("x1") - c("x0"), c("y1") - c("y0")
    turn = F.degrees(F.atan2(dy, dx))
    angle = F.when(turn < 0, turn + 180).otherwise(turn)
    rows = lines.withColumns({"angle": angle, "length": F.hypot(dx, dy)})
    return rows.withColumn("way", F.when((c("angle") < tolerance) | (c("angle") > 180 - tolerance), "h").when((c("angle") > 90 - tolerance) & (c("angle") < 90 + tolerance), "v"))


def connect_lines(lines: DataFrame, gap: float = 30.0, turn: float = 2.0, least: float = 50.0) -> DataFrame:
    """``(image_id, way, x0, y0, x1, y1, length, lines)``: short lines ``(image_id, id, x0, y0, x1, y1)`` joined into longer ones of at least a length.

    Lines go by their place across their direction. Each one not yet used takes up those after it that lie within
    half a gap of what it has become, at a like angle, and overlap it or end near it; the joined line runs
    straight from its first to its last end at the mean place of all ends.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        along, across = ("x", "y") if frame["way"].iloc[0] == "h" else ("y", "x")
        a, b = (frame[[f"{n}0", f"{n}1"]].to_numpy(float) for n in (along, across))
        order = np.lexsort((frame["id"].to_numpy(), b.mean(axis=1)))
        a, b, angle = a[order], b[order], frame["angle"].to_numpy(float)[order]
        used, out = np.zeros(len(a), bool), []
        for i in range(len(a)):
            if used[i]:
                continue
            mine, lo, hi, place, at = [i], a[i].min(), a[i].max(), b[i].mean(), angle[i]
            for j in range(i + 1, len(a)):
                if used[j] or abs(at - angle[j]) > turn or abs(place - b[j].mean()) > gap / 2:
                    continue
                left, right = a[j].min(), a[j].max()
                apart = hi < left - gap or lo > right + gap
                if not apart or min(abs(hi - left), abs(lo - right)) <= gap:
                    mine.append(j)
                    used[j] = True
                    lo, hi, place = a[mine].min(), a[mine].max(), b[mine].mean()
                    at = 0.0 if along == "x" else 90.0
            if hi - lo >= least or len(mine) == 1 and np.hypot(np.ptp(a[i]), np.ptp(b[i])) >= least:
                ends = (lo, place, hi, place) if along == "x" else (place, lo, place, hi)
                out.append((*ends, hi - lo, len(mine)))
        found = pd.DataFrame(out, columns=["x0", "y0", "x1", "y1", "length", "lines"])
        found.insert(0, "image_id", frame["image_id"].iloc[0])
        found.insert(1, "way", pd.Series([frame["way"].iloc[0]] * len(found), dtype=object))
        return found

    kind = lines.schema["image_id"].dataType.simpleString()
    rows = directed(lines).where("way is not null").select("image_id", "id", "x0", "y0", "x1", "y1", "angle", "way")
    return rows.groupBy("image_id", "way").applyInPandas(run, f"image_id {kind}, way string, x0 double, y0 double, x1 double, y1 double, length double, lines int")


def axis_pairs(lines: DataFrame, images: DataFrame, share: float = 0.4) -> DataFrame:
    """One row for each of ``images(image_id, width, height)`` that has them: its lowest long horizontal and its leftmost long vertical line, and whether the pair is ``valid``.

    Long lines span ``share`` of their side and over 70 % of the longest. Images without such a pair take the
    longest lines of at least 70 % of that share.
    """
    c = F.col
    place, side = F.when(c("way") == "h", c("y0")).otherwise(c("x0")), F.when(c("way") == "h", c("width")).otherwise(c("height"))
    rows = lines.join(images.select("image_id", "width", "height"), "image_id").withColumns({"place": place, "side": side})
    w = Window.partitionBy("image_id", "way")
    long_ = rows.where(c("length") >= c("side") * share).withColumn("most", F.max("length").over(w)).where(c("length") > 0.7 * c("most"))
    first = w.orderBy(F.when(c("way") == "h", -c("place")).otherwise(c("place")), c("length").desc())
    pick = lambda d, o: d.withColumn("n", F.row_number().over(o)).where("n = 1")

    def paired(d: DataFrame) -> DataFrame:
        of = lambda way: F.max(F.when(c("way") == way, F.struct("place", "length", F.greatest("y0", "y1").alias("bottom"))))
        return d.groupBy("image_id").agg(of("h").alias("h"), of("v").alias("v")).where("h is not null and v is not null")

    strict = paired(pick(long_, first))
    loose = paired(pick(rows.where(c("length") >= c("side") * share * 0.7), w.orderBy(c("length").desc(), "place")))
    both = strict.unionByName(loose.join(strict.select("image_id"), "image_id", "left_anti")).join(images.select("image_id", "width", "height"), "image_id")
    return both.select("image_id", c("h.place").alias("y"), c("v.place").alias("x"), c("h.length").alias("h_length"), c("v.length").alias("v_length"), valid_pair(c("h.place"), c("v.place"), c("h.length"), c("v.length"), c("v.bottom"), c("width"), c("height")).alias("valid"))


def valid_pair(y: Column, x: Column, h_length: Column, v_length: Column, bottom: Column, width: Column, height: Column) -> Column:
    """Whether axes at these places lie in the image, are long enough, and the horizontal one isn't far above the vertical one's end."""
    return y.between(0, height) & x.between(0, width) & (h_length >= 0.3 * width) & (v_length >= 0.3 * height) & (y >= bottom - 0.2 * height)


def regions(plots: DataFrame) -> DataFrame:
    """``(image_id, region, polygon)``: the plot (0) and the strips left, below, right and above (1 to 4) of ``plots(image_id, width, height, x_min, y_min, x_max, y_max)``; strips share the image's corners."""
    c = F.col
    at = lambda x, y: F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, Column) else x.cast("double").alias("x"), F.lit(y).cast("double").alias("y") if not isinstance(y, Column) else y.cast("double").alias("y"))
    l, t, r, b, w, h = c("x_min"), c("y_min"), c("x_max"), c("y_max"), c("width") - 1, c("height") - 1  # noqa: E741
    shapes = [
        [(l, t), (r, t), (r, b), (l, b)],
        [(0, 0), (0, t), (l, t), (l, b), (0, b), (0, h)],
        [(0, h), (0, b), (l, b), (r, b), (w, b), (w, h)],
        [(w, 0), (w, t), (r, t), (r, b), (w, b), (w, h)],
        [(0, 0), (0, t), (l, t), (r, t), (w, t), (w, 0)],
    ]
    each = F.array(*[F.struct(F.lit(i).alias("region"), F.array(*[at(*p) for p in shape]).alias("polygon")) for i, shape in enumerate(shapes)])
    return plots.select("image_id", F.inline(each))


def region_bounds(regions: DataFrame) -> DataFrame:
    """Each region's whole-pixel box, whose corner is what its crop is moved by."""
    c = F.col
    part = lambda n, f: f(F.transform("polygon", lambda p: p[n])).cast("int")
    return regions.select("image_id", "region", part("x", F.array_min).alias("x0"), part("y", F.array_min).alias("y0"), (part("x", F.array_max) + 1).alias("x1"), (part("y", F.array_max) + 1).alias("y1"))
