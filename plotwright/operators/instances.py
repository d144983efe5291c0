"""Curves told apart by their markers or pieces of line: grouping, outliers, styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import matching as M

#: How near in x markers and pieces of one column are, and how far pieces may lie from their group's middle.
MARKER_COLUMN, LINE_COLUMN, OUTLIER = 14.0, 70.0, 130.0


def inferred_groups(n: Column) -> Column:
    """The number of curves that ``n`` markers suggest: one for every 18, 2 to 8; one if there are under 16."""
    return F.when(n >= 16, F.least(F.lit(8), F.greatest(F.lit(2), F.bround(n / 18)))).otherwise(1).cast("int")


def marker_scenes(markers: DataFrame, pieces: DataFrame) -> DataFrame:
    """``(image_id, grouped)``: whether an image's markers are to be grouped: it has some, and no more pieces of line than markers."""
    n = pieces.groupBy("image_id").agg(F.count("*").alias("p"))
    rows = markers.groupBy("image_id").agg(F.count("*").alias("m")).join(n, "image_id", "full")
    return rows.select("image_id", ((F.coalesce("m", F.lit(0)) > 0) & (F.coalesce("p", F.lit(0)) <= F.coalesce("m", F.lit(0)))).alias("grouped"))


def line_scenes(pieces: DataFrame, groups: int | None) -> DataFrame:
    """``(image_id, grouped)``: whether there are line-like pieces enough for more than one group."""
    enough = F.lit(False) if groups is None or groups <= 1 else F.count_if(F.col("class_label") == "line_like") >= groups
    return pieces.groupBy("image_id").agg(enough.alias("grouped") if groups and groups > 1 else F.max(F.lit(False)).alias("grouped"))


def drop_borders(pieces: DataFrame, plots: DataFrame, edge: float = 10.0) -> DataFrame:
    """``pieces`` without long flat lines along the top or bottom of ``plots(image_id, x_min, y_min, x_max, y_max)``."""
    c = F.col
    box = plots.select("image_id", F.greatest(F.lit(1.0), c("x_max") - c("x_min")).alias("__w"), c("y_min").alias("__top"), c("y_max").alias("__bottom"))
    flat = (c("class_label") == "line_like") & (c("width") >= 0.2 * c("__w")) & (c("height") <= 8)
    near = (F.abs(c("y0") - c("__top")) <= edge) | (F.abs(c("y1") - c("__bottom")) <= edge)
    return pieces.join(box, "image_id", "left").where(~F.coalesce(flat & near, F.lit(False))).drop("__w", "__top", "__bottom")


def grouped(points: DataFrame, groups: int | str, tolerance: float, prefer_lines: bool = False, names: tuple[str, str, str] = ("x_rank", "trajectory_ransac", "y_kmeans")) -> DataFrame:
    """``(image_id, id, label, method)`` of ``points(image_id, id, x, y, weight)``.

    By rank in their column (or by straight lines, where wanted); images where that places under a third of
    the points (no line) go by k-means of y.
    """
    n = F.count("*").over(Window.partitionBy("image_id"))
    wanted = F.col(groups) if isinstance(groups, str) else F.lit(groups)
    rows = points.withColumn("__n", n).withColumn("__k", F.least(wanted, F.col("__n")).cast("int")).where("__k > 0")
    if prefer_lines:
        first = M.trajectories(rows, "__k").select("image_id", "id", "label", F.lit(names[1]).alias("method"))
    else:
        ranked = M.band_rank(rows, "__k", tolerance).select("image_id", "id", F.col("rank_group").alias("label"))
        counts = rows.groupBy("image_id").agg(F.first("__n").alias("n"))
        placed = ranked.groupBy("image_id").agg(F.count("*").alias("m")).join(counts, "image_id").where(F.col("m") >= F.greatest(F.lit(1), F.floor(F.col("n") / 3)))
        first = ranked.join(placed.select("image_id"), "image_id", "left_semi").withColumn("method", F.lit(names[0]))
    left = rows.join(first.select("image_id").distinct(), "image_id", "left_anti")
    return first.unionByName(M.kmeans_1d(left, "__k").withColumn("method", F.lit(names[2])))


def _numbered(rows: DataFrame, prefix: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("label")) - 1
    return rows.withColumn("instance_id", F.concat(F.lit(prefix), F.lpad(number.cast("string"), 2, "0")))


def _source(ids: Column) -> Column:
    return F.when(F.size(ids) == 1, F.get(ids, F.lit(0))).otherwise("mixed")


def marker_instances(markers: DataFrame, groups: int | str | None = None, tolerance: float = MARKER_COLUMN, prefer_lines: bool = False) -> DataFrame:
    """One row a curve of markers ``(image_id, id, x, y, curve_id)``: its markers in order, extent, method, confidence and warnings. The number of groups (or their column, by image) is inferred where it's missing."""
    given = F.col(groups) if isinstance(groups, str) else F.lit(groups)
    markers = markers.withColumn("__groups", F.coalesce(given.cast("int"), inferred_groups(F.count("*").over(Window.partitionBy("image_id")))))
    of = grouped(markers.withColumn("weight", F.lit(1.0)), "__groups", tolerance, prefer_lines)
    rows = markers.join(of, ["image_id", "id"])
    out = rows.groupBy("image_id", "label").agg(
        F.array_sort(F.collect_list(F.struct("x", "y", "id"))).alias("points"), F.array_sort(F.collect_set("curve_id")).alias("__of"), F.count("*").alias("marker_count"),
        F.avg("y").alias("center_y"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.first("method").alias("grouping_method"),
    )
    source = _source(F.col("__of"))
    out = _numbered(out, "marker_instance_").withColumns({"source_curve_id": source, "confidence": F.least(F.lit(1.0), F.col("marker_count") / 8.0), "warnings": F.array_compact(F.array(F.when(source == "mixed", F.lit("mixed_source_curve_ids"))))})
    return out.drop("label", "__of")


def trimmed(pieces: DataFrame, by: list[str]) -> DataFrame:
    """``pieces(center_y)`` without those far from their group's median, and the number of a group's ``outliers``; groups of under four, or that would lose most, stay whole."""
    w = Window.partitionBy(*by)
    rows = pieces.withColumns({"__n": F.count("*").over(w), "__m": F.median("center_y").over(w)})
    rows = rows.withColumn("__near", F.abs(F.col("center_y") - F.col("__m")) <= OUTLIER).withColumn("__kept", F.count_if("__near").over(w))
    cut = (F.col("__n") >= 4) & (F.col("__kept") >= F.greatest(F.lit(2), F.floor(F.col("__n") / 3)))
    rows = rows.withColumn("outliers", F.when(cut, F.col("__n") - F.col("__kept")).otherwise(0)).where(~cut | F.col("__near"))
    return rows.drop("__n", "__m", "__near", "__kept")


def line_style(n: Column, long_: Column, short: Column) -> Column:
    """The style that ``n`` pieces show, of which some are long and some short."""
    return F.when(n == 0, "unknown").when(long_ >= F.greatest(F.lit(1), F.floor(n / 3)), "solid").when((n >= 8) & (short >= 0.6 * n), "dotted").when(n >= 3, "dashed").otherwise("unknown")


def line_instances(pieces: DataFrame, groups: int | str) -> DataFrame:
    """One row a curve of line-like pieces (see ``components.line_components``, with ``curve_id``): its points in order, extent, style, method, confidence and warnings."""
    c = F.col
    rows = pieces.where("class_label = 'line_like'").withColumns({"center_y": (c("y0") + c("y1")) / 2.0, "x": (c("x0") + c("x1")) / 2.0})
    weight = F.greatest(F.lit(1.0), F.when(c("path_length") > 0, c("path_length")).otherwise(c("area")))
    of = grouped(rows.select("image_id", "id", "x", c("center_y").alias("y"), weight.alias("weight"), *([groups] if isinstance(groups, str) else [])), groups, LINE_COLUMN, names=("component_x_rank", "", "component_y_kmeans"))
    rows = trimmed(rows.join(of, ["image_id", "id"]), ["image_id", "label"])
    flat = F.when(c("x1") - c("x0") <= 1, F.array(F.struct(c("x0").cast("double").alias("x"), c("center_y").alias("y")))).otherwise(F.array(*[F.struct(c(e).cast("double").alias("x"), c("center_y").alias("y")) for e in ("x0", "x1")]))
    rows = rows.withColumn("__p", F.when(F.size("path") > 0, F.array_sort("path")).otherwise(flat))
    out = rows.groupBy("image_id", "label").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("x0", "y0", "id", "__p"))), lambda s: s["__p"])).alias("points"),
        F.array_sort(F.collect_set("curve_id")).alias("__of"), F.count("*").alias("component_count"), F.avg("center_y").alias("center_y"),
        F.min("x0").alias("x_min"), F.max("x1").alias("x_max"), F.min("y0").alias("y_min"), F.max("y1").alias("y_max"), F.first("method").alias("grouping_method"), F.first("outliers").alias("outliers"),
        line_style(F.count("*"), F.count_if((c("max_span") >= 70) | (c("path_length") >= 80)), F.count_if(c("max_span") < 35)).alias("estimated_line_style"),
    )
    source = _source(c("__of"))
    warnings = F.array_compact(F.array(F.when(source == "mixed", F.lit("mixed_source_curve_ids")), F.when(c("outliers") > 0, F.concat(F.lit("line_component_y_outliers_removed="), c("outliers")))))
    out = _numbered(out, "line_style_instance_").withColumns({"source_curve_id": source, "confidence": F.least(F.lit(1.0), c("component_count") / 6.0), "warnings": warnings})
    return out.drop("label", "__of", "outliers")


def instance_summary(instances: DataFrame, count: str) -> DataFrame:
    """Number, members, mean confidence and grouping methods of an image's instances; ``count`` names the members' column."""
    return instances.groupBy("image_id").agg(F.count("*").alias("instances"), F.sum(count).alias("members"), F.avg(count).alias("mean_members"), F.avg("confidence").alias("mean_confidence"), F.array_sort(F.collect_set("grouping_method")).alias("methods"))
