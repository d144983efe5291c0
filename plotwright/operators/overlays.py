"""What was found, drawn over its image: layers of pixels ``(image_id, x, y, r, g, b, z)``, and one picture of them.

Layers are tables like the pixels themselves; higher z hides lower. Texts aren't drawn; ``labels`` says where they belong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Colours (red, green, blue) of classes, completed points, marker crosses and instances in turn.
CLASSES = {"line_like": (0, 180, 0), "marker_like": (0, 128, 255), "noise": (255, 0, 0)}
COMPLETED, CROSS = (255, 200, 0), (255, 0, 0)
INSTANCES = ((255, 0, 0), (0, 180, 0), (0, 0, 255), (255, 180, 0), (255, 0, 180), (0, 128, 255), (128, 0, 128), (128, 128, 0))
#: Longest step of a path that is drawn.
STEP = 8.0
LAYER = ("image_id", "x", "y", "r", "g", "b", "z")


def color(rgb: tuple[int, int, int]) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip("rgb", rgb)])


def class_color(label: Column) -> Column:
    """Of a piece's class."""
    return F.when(label == "line_like", color(CLASSES["line_like"])).when(label == "marker_like", color(CLASSES["marker_like"])).otherwise(color(CLASSES["noise"]))


def instance_color(number: Column) -> Column:
    """Of an instance by its number, in turn."""
    return F.element_at(F.array(*map(color, INSTANCES)), (number % len(INSTANCES) + 1).cast("int"))


def curve_color(rgb: Column) -> Column:
    """A curve's own colour, green where it has none."""
    return F.coalesce(rgb, color((0, 255, 0)))


def _layer(rows: DataFrame, z: int) -> DataFrame:
    """``rows(image_id, p, color)`` as a layer; ``p`` is a place."""
    return rows.select("image_id", F.col("p.x").cast("int").alias("x"), F.col("p.y").cast("int").alias("y"), "color.r", "color.g", "color.b", F.lit(z).alias("z")).distinct()


def lines(rows: DataFrame, z: int = 1, thickness: int = 1) -> DataFrame:
    """Straight lines ``(image_id, x0, y0, x1, y1, color)``; ends are rounded to pixels."""
    at = {n: F.bround(n).cast("int") for n in ("x0", "y0", "x1", "y1")}
    n = F.greatest(F.abs(at["x1"] - at["x0"]), F.abs(at["y1"] - at["y0"]))
    rows = rows.select("image_id", "color", *[e.alias(k) for k, e in at.items()], n.alias("n"))
    wide = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range((1 - thickness) // 2, thickness // 2 + 1) for j in range((1 - thickness) // 2, thickness // 2 + 1)]
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), "n"))).withColumn("w", F.explode(F.array(*wide)))
    t = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0)
    place = [(F.bround(F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * t) + F.col(f"w.{d}")).alias(a) for a, d in (("x", "i"), ("y", "j"))]
    return _layer(rows.select("image_id", "color", F.struct(*place).alias("p")), z)


def boxes(rows: DataFrame, z: int = 2, thickness: int = 1) -> DataFrame:
    """Outlines of ``(image_id, x_min, y_min, x_max, y_max, color)``."""
    c = F.col
    sides = F.array(*[F.struct(c(a).alias("x0"), c(b).alias("y0"), c(d).alias("x1"), c(e).alias("y1")) for a, b, d, e in (("x_min", "y_min", "x_max", "y_min"), ("x_min", "y_max", "x_max", "y_max"), ("x_min", "y_min", "x_min", "y_max"), ("x_max", "y_min", "x_max", "y_max"))])
    return lines(rows.select("image_id", "color", F.inline(sides)), z, thickness)


def paths(points: DataFrame, by: list[str], z: int = 3, thickness: int = 1, faint: bool = False) -> DataFrame:
    """Paths ``(*by, seq, x, y, color)`` step by step, without long steps; with ``faint``, steps with an end under a ``confidence`` of 0.5 in the colour of completed points."""
    w, c = Window.partitionBy(*by).orderBy("seq"), F.col
    rows = points.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w)}).where("x1 is not null")
    rows = rows.where(F.hypot(c("x1") - c("x"), c("y1") - c("y")) <= STEP)
    if faint:
        low = F.least("confidence", F.lead("confidence").over(w)) < 0.5
        rows = points.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w), "low": low}).where("x1 is not null").where(F.hypot(c("x1") - c("x"), c("y1") - c("y")) <= STEP).withColumn("color", F.when(c("low"), color(COMPLETED)).otherwise(c("color")))
    return lines(rows.select("image_id", c("x").alias("x0"), c("y").alias("y0"), "x1", "y1", "color"), z, thickness)


def crosses(markers: DataFrame, z: int = 4, reach: int = 4) -> DataFrame:
    """Upright crosses at ``(image_id, x, y)``."""
    c = F.col
    arms = F.array(F.struct((c("x") - reach).alias("x0"), c("y").alias("y0"), (c("x") + reach).alias("x1"), c("y").alias("y1")), F.struct(c("x").alias("x0"), (c("y") - reach).alias("y0"), c("x").alias("x1"), (c("y") + reach).alias("y1")))
    return lines(markers.select("image_id", color(CROSS).alias("color"), F.inline(arms)), z)


def circles(spots: DataFrame, z: int = 4, radius: int = 4) -> DataFrame:
    """Circles around ``(image_id, x, y, color)``."""
    ring = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs((i * i + j * j) ** 0.5 - radius) < 0.5]
    place = F.explode(F.array(*[F.struct((F.bround("x") + i).alias("x"), (F.bround("y") + j).alias("y")) for i, j in ring]))
    return _layer(spots.select("image_id", "color", place.alias("p")), z)


def marker_curves(instances: DataFrame, z: int = 4) -> DataFrame:
    """Marker curves (see ``instances.marker_instances``): circles at their markers and lines from one to the next, in colours by their number."""
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("instance_id")) - 1
    rows = instances.withColumn("color", instance_color(number)).select("image_id", "instance_id", "color", F.posexplode("points").alias("seq", "p")).select("image_id", "instance_id", "color", "seq", "p.x", "p.y")
    w = Window.partitionBy("image_id", "instance_id").orderBy("seq")
    steps = rows.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w)}).where("x1 is not null")
    return circles(rows, z).unionByName(lines(steps.select("image_id", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1", "color"), z))


def line_curves(instances: DataFrame, z: int = 4) -> DataFrame:
    """Line curves (see ``instances.line_instances``): their boxes in colours by their number."""
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("instance_id")) - 1
    return boxes(instances.withColumn("color", instance_color(number)), z, 2)


def swatches(curves: DataFrame, most: int = 12, z: int = 5) -> DataFrame:
    """Filled boxes in the upper left with the colours of an image's first curves, framed in dark gray."""
    c = F.col
    rows = curves.withColumn("n", F.row_number().over(Window.partitionBy("image_id").orderBy("curve_id")) - 1).where(c("n") < most)
    top = 12 + 16 * c("n")
    place = rows.select("image_id", F.struct("r", "g", "b").alias("own"), top.alias("top"), F.explode(F.sequence(F.lit(12), F.lit(40))).alias("x")).withColumn("y", F.explode(F.sequence(c("top"), c("top") + 10)))
    edge = c("x").isin(12, 40) | (c("y") == c("top")) | (c("y") == c("top") + 10)
    dark = color((40, 40, 40)).cast(place.schema["own"].dataType)
    return _layer(place.select("image_id", F.struct("x", "y").alias("p"), F.when(edge, dark).otherwise(c("own")).alias("color")), z)


def labels(items: DataFrame, instances: DataFrame | None = None) -> DataFrame:
    """``(image_id, text, x, y)``: where the names of legend items, and of line curves with their styles, belong."""
    c = F.col
    say = lambda name, style: F.when(style == "unknown", name).otherwise(F.concat_ws(" ", name, style))
    at = lambda up: F.greatest(F.lit(12), F.bround("y_min").cast("int") - up)
    out = items.select("image_id", say(c("item_id"), c("line_style")).alias("text"), F.bround("x_min").cast("int").alias("x"), at(4).alias("y"))
    if instances is not None:
        out = out.unionByName(instances.select("image_id", F.concat_ws(" ", "instance_id", "estimated_line_style").alias("text"), F.bround("x_min").cast("int").alias("x"), at(6).alias("y")))
    return out


def flattened(pixels: DataFrame, *layers: DataFrame) -> DataFrame:
    """``pixels(image_id, x, y, r, g, b)`` with the layers over them; at one place the highest z counts, then the brightest colour."""
    every = pixels.select("image_id", F.col("x").cast("int"), F.col("y").cast("int"), *[F.col(n).cast("int").alias(n) for n in "rgb"], F.lit(0).alias("z"))
    for layer in layers:
        every = every.unionByName(layer.select(*LAYER))
    top = every.groupBy("image_id", "x", "y").agg(F.max(F.struct("z", "r", "g", "b")).alias("p"))
    return top.select("image_id", "x", "y", "p.r", "p.g", "p.b")


def debug_layers(found) -> dict[str, DataFrame]:
    """The layers of an extraction (see ``extraction.extract``): plot and legends, pieces, markers, curves, paths and bound paths."""
    c = F.col
    plot = boxes(found.plots.withColumn("color", color((0, 160, 0))), 2, 2).unionByName(boxes(found.legends.withColumn("color", color((255, 128, 0))), 2))
    own = F.struct("r", "g", "b")
    curves = found.curves.select("image_id", "curve_id", curve_color(own).alias("color"))
    traced = found.points.join(curves, ["image_id", "curve_id"])
    piece_boxes = found.pieces.select("image_id", c("x0").alias("x_min"), c("y0").alias("y_min"), c("x1").alias("x_max"), c("y1").alias("y_max"), class_color(c("class_label")).alias("color"))
    protos = found.prototypes.select("image_id", "prototype_id", curve_color(own).alias("color"))
    return {
        "overview": plot.unionByName(swatches(found.curves)), "pieces": boxes(piece_boxes), "markers": crosses(found.markers), "marker_curves": marker_curves(found.marker_instances),
        "line_curves": line_curves(found.line_instances), "paths": paths(traced, ["image_id", "curve_id"], faint=True), "bound_paths": paths(found.bound_points.join(protos, ["image_id", "prototype_id"]), ["image_id", "prototype_id"]),
    }
