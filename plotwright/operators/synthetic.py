"""Drawn charts with known curves: their truth, images and masks, as tables.

Lines are drawn from the points by expressions: each step between two points is a run of round stamps, kept
where the dash pattern is on. Nothing smooths edges; pixels are either drawn or white.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import families, scalar as S

#: Colours and line styles in turn, of the plain and of the achromatic palette, the gray variants, and the markers.
BASIC = (("#1f77b4", "-"), ("#ff7f0e", "--"), ("#2ca02c", "-."), ("#d62728", ":"), ("#9467bd", "-"), ("#8c564b", "--"))
ACHROMATIC = (("#000000", "-"), ("#777777", "--"), ("#1f77b4", "-."), ("#d62728", ":"), ("#2ca02c", "-"), ("#ff7f0e", "--"))
LINE_GRAYS = ("#222222", "#555555", "#777777", "#999999", "#bbbbbb", "#444444")
LINE_STYLES = ("-", "--", "-.", ":", "(0, (5, 1))", "(0, (1, 1))")
MARKER_GRAYS = ("#222222", "#5a5a5a", "#888888", "#b6b6b6", "#707070", "#a0a0a0")
MARKERS = ("o", "s", "^", "D", "x", "+", "v", "P", "*", "h")
#: Lengths of dashes and gaps in widths of the line.
DASHES = {"--": (3.7, 1.6), "-.": (6.4, 1.6, 1.0, 1.6), ":": (1.0, 1.65), "(0, (5, 1))": (5.0, 1.0), "(0, (1, 1))": (1.0, 1.0)}


@dataclass(frozen=True)
class Chart:
    """What to draw; see the fields' names. The axes' position is (left, bottom, width, height) as shares of the image."""

    name: str = "basic_curves"
    seed: int = 42
    curves: int = 6
    points: int = 800
    width: int = 1200
    height: int = 750
    dpi: int = 150
    axes: tuple[float, float, float, float] = (0.12, 0.14, 0.66, 0.74)
    x_range: tuple[float, float] = (0.0, 30.0)
    y_range: tuple[float, float] = (-1.0, 5.0)
    palette: str = "basic"
    legend_inside: bool = False
    occlusion: bool = False
    occluded: tuple[float, ...] = (10.0, 18.2, 24.4)
    occlusion_width: float = 0.55
    crossing: bool = False
    markers_only: bool = False
    line_markers: bool = False
    one_color: bool = False
    gray_markers: bool = False
    gray_lines: bool = False
    dense_legend: bool = False

    def normalized(self) -> Chart:
        """With what some options bring along: dense legends lie inside and have ten curves, gray markers stand on lines."""
        if self.dense_legend:
            return replace(self, curves=max(self.curves, 10), legend_inside=True)
        return replace(self, line_markers=True) if self.gray_markers else self

    @property
    def plot(self) -> tuple[float, float, float, float]:
        """The plot's box in pixels: x_min, y_min, x_max, y_max."""
        left, bottom, width, height = self.axes
        return left * self.width, (1 - bottom - height) * self.height, (left + width) * self.width, (1 - bottom) * self.height

    @property
    def title(self) -> str:
        """What the chart shows, in words."""
        words = [w for w, on in (("Crossing", self.crossing), ("Same Gray", self.gray_markers or self.gray_lines), ("Same Color", self.one_color), ("Line", self.line_markers), ("Linestyle", self.gray_lines), ("Marker", self.markers_only or self.line_markers or self.one_color)) if on]
        rest = ["Dense Legend"] if self.dense_legend else ["Local Occlusion"] if self.occlusion else ["Achromatic"] if self.palette == "achromatic" else ["Basic"]
        return " ".join([*(words or rest), "Curves"])

    @property
    def font_size(self) -> int:
        """Of the legend's texts in points."""
        return 7 if self.dense_legend or self.curves > 8 else 8

    def style(self, i: int) -> tuple[str, str, str | None, int | None]:
        """Colour, line style, marker and the number of points from one marker to the next of a curve."""
        color, line = (ACHROMATIC if self.palette == "achromatic" else BASIC)[i % 6]
        marker, every = None, None
        if self.gray_lines:
            color, line = LINE_GRAYS[i % 6], LINE_STYLES[i % 6]
        if self.markers_only:
            marker, every, line = MARKERS[i % 10], 35, "None"
        if self.line_markers or self.one_color:
            marker, every, line = MARKERS[i % 10], 45, "-"
        if self.gray_markers:
            color = MARKER_GRAYS[i % 6]
        if self.one_color:
            color = "#555555"
        if self.dense_legend:
            marker, every = marker or MARKERS[i % 10], every or 70
        return color, line, marker, every


#: The cases that the suite draws.
SUITE = (
    Chart(),
    Chart("achromatic_curves", seed=7, palette="achromatic"),
    Chart("local_occlusion_curves", occlusion=True),
    Chart("crossing_curves", seed=13, crossing=True),
    Chart("legend_inside_curves", legend_inside=True),
)


def truth(spark: SparkSession, charts: Sequence[Chart]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, curves and points of charts, the truth that goes with their pixels.

    ``(image_id, width, height, x_min, y_min, x_max, y_max, dx_min, dx_max, dy_min, dy_max, ...)``,
    ``(image_id, number, curve_id, color, linestyle, marker, marker_every, marker_size, label, ...)`` and
    ``(image_id, curve_id, point_index, x, y)``. Bends are drawn from the chart's seed.
    """
    images, curves = [], []
    for chart in map(Chart.normalized, charts):
        rng = np.random.default_rng(chart.seed)
        scale = chart.dpi / 72
        images.append((chart.name, chart.width, chart.height, *chart.plot, *chart.x_range, *chart.y_range, chart.points, chart.legend_inside))
        for i in range(chart.curves):
            color, line, marker, every = chart.style(i)
            size = 0.0 if not marker else 3.0 if chart.line_markers else 4.0
            bend = None if chart.crossing else 18.0 + rng.normal(0, 0.4)
            hidden = list(chart.occluded) if chart.occlusion else []
            curves.append((chart.name, i, f"curve_{i:02d}", color, line, marker, every, size, f"Curve {i + 1}", bend, chart.curves, hidden, chart.occlusion_width / 2, 1.7 * scale, 2.2 * scale, scale))
    images = spark.createDataFrame(images, "image_id string, width int, height int, x_min double, y_min double, x_max double, y_max double, dx_min double, dx_max double, dy_min double, dy_max double, points int, legend_inside boolean")
    curves = spark.createDataFrame(curves, "image_id string, number int, curve_id string, color string, linestyle string, marker string, marker_every int, marker_size double, label string, bend double, family int, hidden array<double>, hidden_reach double, line_px double, mask_px double, scale double")
    c = F.col
    rows = curves.join(images, "image_id").select("image_id", "curve_id", "number", "bend", "family", "points", "dx_min", "dx_max", F.explode(F.sequence(F.lit(0), c("points") - 1)).alias("point_index"))
    x = c("dx_min") + c("point_index") * ((c("dx_max") - c("dx_min")) / (c("points") - 1))
    rows = rows.withColumn("x", x)
    y = F.when(c("bend").isNull(), families.crossing(c("x"), c("number"), c("family"), (c("dx_min") + c("dx_max")) / 2)).otherwise(families.overlapping(c("x"), c("number"), c("bend")))
    return images, curves, rows.select("image_id", "curve_id", "point_index", "x", y.alias("y"))


def to_pixels(points: DataFrame, images: DataFrame) -> DataFrame:
    """``points`` with their place ``px``, ``py`` in the image."""
    c = F.col
    rows = points.join(images.select("image_id", "x_min", "y_min", "x_max", "y_max", "dx_min", "dx_max", "dy_min", "dy_max"), "image_id")
    px = c("x_min") + (c("x") - c("dx_min")) / (c("dx_max") - c("dx_min")) * (c("x_max") - c("x_min"))
    py = c("y_max") - (c("y") - c("dy_min")) / (c("dy_max") - c("dy_min")) * (c("y_max") - c("y_min"))
    return rows.select(*points.columns, px.alias("px"), py.alias("py"), *[c(n).alias(f"plot_{n}") for n in ("x_min", "y_min", "x_max", "y_max")])


def _stamped(spots: DataFrame, by: list[str], radius: Column, most: int) -> DataFrame:
    """The distinct pixels within ``radius`` of ``spots(*by, x, y, ...)``; no radius is over ``most``."""
    c = F.col
    rows = spots.withColumn("r", radius)
    for n, d in (("x", "i"), ("y", "j")):
        rows = rows.withColumn(d, F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn(f"p{n}", F.bround(n).cast("int") + c(d))
    return rows.where(F.hypot(c("px") - c("x"), c("py") - c("y")) <= c("r")).select(*by, c("px").alias("x"), c("py").alias("y")).distinct()


def lines(points: DataFrame, curves: DataFrame, images: DataFrame, mask: bool = False) -> DataFrame:
    """The pixels ``(image_id, curve_id, x, y)`` of curves: lines by their style without what is hidden, and markers; those of a mask are wider. All within the plot."""
    c = F.col
    rows = to_pixels(points, images).join(curves.select("image_id", "curve_id", "linestyle", "marker", "marker_every", "marker_size", "hidden", "hidden_reach", "line_px", "mask_px", "scale"), ["image_id", "curve_id"])
    rows = rows.withColumn("shown", ~F.exists("hidden", lambda h: F.abs(c("x") - h) <= c("hidden_reach"))).withColumn("wide", c("mask_px") if mask else c("line_px"))
    w = Window.partitionBy("image_id", "curve_id").orderBy("point_index")
    rows = rows.withColumns({"nx": F.lead("px").over(w), "ny": F.lead("py").over(w), "next": F.lead("shown").over(w)})
    rows = rows.withColumn("far", F.coalesce(F.hypot(c("nx") - c("px"), c("ny") - c("py")), F.lit(0.0)))
    rows = rows.withColumn("along", F.coalesce(F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    drawn = rows.where("shown and next and linestyle <> 'None'").withColumn("n", F.greatest(F.lit(1), F.ceil(c("far") * 2)))
    t = c("k") / c("n")
    drawn = drawn.withColumn("k", F.explode(F.sequence(F.lit(0), c("n") - 1))).select("image_id", "curve_id", "linestyle", "wide", (c("px") + (c("nx") - c("px")) * t).alias("x"), (c("py") + (c("ny") - c("py")) * t).alias("y"), ((c("along") + c("far") * t) / c("wide")).alias("at"), *[c(f"plot_{n}") for n in ("x_min", "y_min", "x_max", "y_max")])
    on = F.lit(True)
    for style, lengths in DASHES.items():
        place, seen, inside = F.pmod(c("at"), F.lit(sum(lengths))), 0.0, F.lit(False)
        for k, length in enumerate(lengths):
            if k % 2 == 0:
                inside = inside | ((place >= seen) & (place < seen + length))
            seen += length
        on = F.when(c("linestyle") == style, inside).otherwise(on)
    by = ["image_id", "curve_id"]
    out = _stamped(drawn.where(on), by, c("wide") / 2, 3)
    spots = rows.where((c("marker_every") > 0) & (c("point_index") % c("marker_every") == 0) & c("shown")).select(*by, c("px").alias("x"), c("py").alias("y"), ((F.lit(6.0) if mask else c("marker_size")) * c("scale") / 2).alias("r0"))
    out = out.unionByName(_stamped(spots, by, c("r0"), 8)).distinct()
    box = images.select("image_id", *[c(n).alias(f"b_{n}") for n in ("x_min", "y_min", "x_max", "y_max")])
    return out.join(box, "image_id").where("x >= b_x_min and x <= b_x_max and y >= b_y_min and y <= b_y_max").select("image_id", "curve_id", "x", "y")


def legend_pixels(curves: DataFrame, images: DataFrame) -> DataFrame:
    """``(image_id, x, y, r, g, b, z)``: a framed legend in the upper left of charts that have one inside: a sample of each curve and blocks for its words."""
    c = F.col
    x0, y0 = F.bround(c("x_min")).cast("int") + 16, F.bround(c("y_min")).cast("int") + 16
    inside = curves.join(images.where("legend_inside").select("image_id", "x_min", "y_min"), "image_id")
    n = F.count("*").over(Window.partitionBy("image_id"))
    rows = inside.withColumns({"x0": x0, "y0": y0, "n": n, "top": y0 + 10 + 20 * c("number")})
    rgb = S.hex_channels(c("color"))
    area = lambda rows, x, y, *more: rows.withColumn("x", F.explode(x)).withColumn("y", F.explode(y)).select("image_id", "x", "y", *more)
    sample = area(rows, F.sequence(c("x0") + 10, c("x0") + 50), F.sequence(c("top") + 4, c("top") + 7), *[v.alias(k) for k, v in zip("rgb", rgb)], F.lit(101).alias("z"), "linestyle", "x0")
    gap = F.when(c("linestyle").isin("--", "-."), (c("x") - c("x0")) % 14 < 10).when(c("linestyle") == ":", (c("x") - c("x0")) % 8 < 4).otherwise(c("linestyle") != "None")
    sample = sample.where(gap).drop("linestyle", "x0")
    ink = [F.lit(20).alias(k) for k in "rgb"]
    words = area(rows, F.sequence(c("x0") + 64, c("x0") + 120), F.sequence(c("top"), c("top") + 10), *ink, F.lit(101).alias("z"), "number")
    words = words.where((c("x") * 7 + c("y") * 13 + c("number") * 31) % 5 < 2).drop("number")
    box = rows.select("image_id", "x0", "y0", (c("x0") + 136).alias("x1"), (c("y0") + 14 + 20 * c("n")).alias("y1")).distinct()
    edge = [F.lit(204).alias(k) for k in "rgb"]
    frame = area(box, F.sequence("x0", "x1"), F.array("y0", "y1"), *edge, F.lit(100).alias("z")).unionByName(area(box, F.array("x0", "x1"), F.sequence("y0", "y1"), *edge, F.lit(100).alias("z")))
    return sample.unionByName(words).unionByName(frame)


def image_pixels(points: DataFrame, curves: DataFrame, images: DataFrame) -> DataFrame:
    """``(image_id, x, y, r, g, b)`` of what isn't white: the axes' frame, curves over each other in their order, and a legend inside."""
    c = F.col
    rgb = S.hex_channels(c("color"))
    drawn = lines(points, curves, images).join(curves.select("image_id", "curve_id", "number", "color"), ["image_id", "curve_id"]).select("image_id", "x", "y", *[v.alias(k) for k, v in zip("rgb", rgb)], (c("number") + 1).alias("z"))
    at = {n: F.bround(c(n)).cast("int") for n in ("x_min", "y_min", "x_max", "y_max")}
    black = [F.lit(0).alias(k) for k in "rgb"]
    flat = images.withColumn("x", F.explode(F.sequence(at["x_min"], at["x_max"]))).withColumn("y", F.explode(F.array(at["y_min"], at["y_min"] + 1, at["y_max"] - 1, at["y_max"])))
    tall = images.withColumn("x", F.explode(F.array(at["x_min"], at["x_min"] + 1, at["x_max"] - 1, at["x_max"]))).withColumn("y", F.explode(F.sequence(at["y_min"], at["y_max"])))
    frame = flat.select("image_id", "x", "y", *black, F.lit(1000).alias("z")).unionByName(tall.select("image_id", "x", "y", *black, F.lit(1000).alias("z")))
    every = drawn.unionByName(frame).unionByName(legend_pixels(curves, images))
    top = every.groupBy("image_id", "x", "y").agg(F.max(F.struct("z", "r", "g", "b")).alias("p"))
    return top.select("image_id", "x", "y", "p.r", "p.g", "p.b")
