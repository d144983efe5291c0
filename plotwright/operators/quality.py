"""Measures of what was extracted against what is true, and reports of an extraction."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import matching as M

BOX = ("x_min", "y_min", "x_max", "y_max")


def evaluate_axes(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Errors in pixels of ``found`` (see ``axes.detect_axes``) against ``truth(image_id, x_min, y_min, x_max, y_max)``, one row an image of the truth; null without axes."""
    c = F.col
    t = truth.select("image_id", *[c(b).alias(f"t_{b}") for b in BOX])
    rows = t.hint("merge").join(found.select("image_id", "success", "error", "confidence", *BOX), "image_id", "left")
    gap = lambda b: F.abs(c(b) - c(f"t_{b}"))
    away = lambda x, y: F.hypot(c(x) - c(f"t_{x}"), c(y) - c(f"t_{y}"))
    ok = F.coalesce("success", F.lit(False))
    mean = sum((gap(b) for b in BOX), F.lit(0.0)) / len(BOX)
    return rows.select(
        "image_id", ok.alias("axis_success"), F.when(~ok, F.coalesce("error", F.lit("axis detection failed"))).alias("error"), *[gap(b).alias(f"{b}_error") for b in BOX],
        mean.alias("mean_error"), away("x_min", "y_max").alias("origin_error"), away("x_max", "y_max").alias("x_end_error"), away("x_min", "y_min").alias("y_end_error"), "confidence",
    )


def evaluate_paths(points: DataFrame, truth: DataFrame, cell: float = 16.0) -> DataFrame:
    """``matching.path_metrics`` of ``points(image_id, id, x, y, completed)`` with counts, and the mean distance of observed and of completed points; curves without points or truth fail with an error."""
    to_truth = M.nearest(points, truth, cell).join(points.select("image_id", "id", "completed"), ["image_id", "id"])
    split = to_truth.groupBy("image_id").agg(F.avg(F.when(~F.col("completed"), F.col("distance"))).alias("mean_observed_to_truth"), F.avg(F.when(F.col("completed"), F.col("distance"))).alias("mean_completed_to_truth"))
    counts = points.groupBy("image_id").agg(F.count("*").alias("pred_points"), F.count_if("completed").alias("completed_points"))
    true = truth.groupBy("image_id").agg(F.count("*").alias("truth_points"))
    rows = counts.join(true, "image_id", "full").join(M.path_metrics(points, truth, cell), "image_id", "left").join(split, "image_id", "left")
    why = F.when(F.col("pred_points").isNull(), "empty predicted path").when(F.col("truth_points").isNull(), "empty truth curve")
    return rows.withColumns({"path_success": why.isNull(), "error": why}).na.fill(0, ["pred_points", "completed_points", "truth_points"])


def series(points: DataFrame, by: list[str]) -> DataFrame:
    """One row a series of data points ``(*by, x, y, completed)``: counts and extent."""
    return points.groupBy(*by).agg(F.count("*").alias("point_count"), F.count_if("completed").alias("completed_point_count"), *[f(c).alias(f"{c}_{n}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))])


def coverage(points: Column, completed: Column, observed: Column) -> Column:
    """The share of the observed pixels that a path shows, null without any."""
    return S.safe_ratio(F.greatest(F.lit(0), points - F.coalesce(completed, F.lit(0))), observed)


def curve_rows(curves: DataFrame, masks: DataFrame, paths: DataFrame, points: DataFrame, data: DataFrame | None = None) -> DataFrame:
    """One row for each curve ``(image_id, curve_id)``: what its mask, path and series have; zeros and nulls where one is missing."""
    c, key = F.col, ["image_id", "curve_id"]
    faint = points.groupBy(*key).agg(F.count_if(c("confidence") < 0.5).alias("faint"))
    rows = curves.select(*key).join(masks.select(*key, c("pixel_count").alias("mask_pixel_count"), c("warnings").alias("mask_warnings")), key, "left")
    rows = rows.join(paths.select(*key, "points", "completed", "observed", "length", "rebuilt", "confidence", c("warnings").alias("path_warnings")), key, "left").join(faint, key, "left")
    if data is not None:
        rows = rows.join(data.select(*key, c("point_count").alias("data_points"), c("completed_point_count").alias("data_completed")), key, "left")
    else:
        rows = rows.withColumns({"data_points": F.lit(0).cast("long"), "data_completed": F.lit(0).cast("long")})
    zero = lambda n: F.coalesce(n, F.lit(0))
    none = F.array().cast("array<string>")
    return rows.select(
        *key, zero("mask_pixel_count").alias("mask_pixel_count"), zero("points").alias("path_point_count"), F.coalesce("length", F.lit(0.0)).alias("path_length_px"), c("confidence").alias("path_confidence"),
        coverage(c("points"), c("completed"), c("observed")).alias("path_coverage_ratio"), F.coalesce("rebuilt", F.lit(False)).alias("path_rebuilt"), zero("completed").alias("completed_point_count"),
        S.safe_ratio(c("completed"), c("points")).alias("completed_point_ratio"), S.safe_ratio(zero("faint"), c("points")).alias("low_confidence_point_ratio"),
        zero("data_points").alias("data_point_count"), zero("data_completed").alias("data_completed_point_count"), F.concat(F.coalesce("mask_warnings", none), F.coalesce("path_warnings", none)).alias("warnings"),
    )


def report(axes: DataFrame, counted: Mapping[str, DataFrame], curves: DataFrame) -> DataFrame:
    """One row for each image of ``axes``: success and confidence, the number of rows it has in each of the ``counted`` tables, and sums and means over its ``curve_rows``."""
    c = F.col
    rows = axes.select("image_id", c("success").alias("axis_success"), c("confidence").alias("axis_confidence"), c("error").alias("axis_error"))
    for name, table in counted.items():
        rows = rows.join(table.groupBy("image_id").agg(F.count("*").alias(f"{name}_count")), "image_id", "left")
    sums = curves.groupBy("image_id").agg(
        F.count("*").alias("curve_count"), F.sum("path_point_count").alias("total_points"), F.sum("completed_point_count").alias("total_completed"), F.avg("path_confidence").alias("mean_path_confidence"),
        F.avg("path_coverage_ratio").alias("mean_path_coverage_ratio"), F.count_if("path_rebuilt").alias("rebuilt_paths"), F.sum("data_point_count").alias("data_points"), F.sum("data_completed_point_count").alias("data_completed"),
    )
    rows = rows.join(sums, "image_id", "left").na.fill(0, [*[f"{n}_count" for n in counted], "curve_count", "total_points", "total_completed", "rebuilt_paths", "data_points", "data_completed"])
    return rows.withColumns({"completed_point_ratio": S.safe_ratio(c("total_completed"), c("total_points")), "data_completed_ratio": S.safe_ratio(c("data_completed"), c("data_points"))})


# against drawn truth


def truth_line_style(style: Column) -> Column:
    """solid, dashed, dotted or unknown for a drawn line style; dash patterns are told by their numbers."""
    return F.when(style.isin("-", "solid"), "solid").when(style.isin("--", "-.", "dashed") | style.contains("5, 1"), "dashed").when(style.isin(":", "dotted") | style.contains("1, 1"), "dotted").otherwise("unknown")


def is_achromatic_lab(a: Column, b: Column, tolerance: float = 14.0) -> Column:
    return F.coalesce(F.hypot(a - 128.0, b - 128.0) <= tolerance, F.lit(False))


def _distances(truth: DataFrame, prototypes: DataFrame) -> DataFrame:
    t = truth.select("image_id", F.col("curve_id").alias("truth_id"), *[v.alias(f"t{n}") for n, v in zip("rgb", S.hex_channels(F.col("color")))])
    both = t.join(prototypes.select("image_id", "curve_id", "r", "g", "b"), "image_id")
    return both.withColumn("distance", S.rgb_distance([F.col(f"t{n}") for n in "rgb"], [F.col(n) for n in "rgb"]))


def match_prototypes(truth: DataFrame, prototypes: DataFrame) -> DataFrame:
    """``(image_id, truth_id, curve_id, distance)``: each true curve's nearest prototype by colour; two may share one. Ties go to the smaller id."""
    best = _distances(truth, prototypes).groupBy("image_id", "truth_id").agg(F.min(F.struct("distance", "curve_id")).alias("m"))
    return best.select("image_id", "truth_id", "m.curve_id", "m.distance")


def curves_to_truth(truth: DataFrame, prototypes: DataFrame) -> DataFrame:
    """``(image_id, curve_id, truth_id)``: prototypes and true curves paired by rising distance of colour, each once."""
    w = Window.partitionBy("image_id")
    rows = _distances(truth, prototypes).withColumns({"left_id": F.dense_rank().over(w.orderBy("curve_id")).cast("long"), "right_id": F.dense_rank().over(w.orderBy("truth_id")).cast("long"), "score": -F.col("distance")})
    return rows.join(M.greedy_match(rows).select("image_id", "left_id", "right_id"), ["image_id", "left_id", "right_id"], "left_semi").select("image_id", "curve_id", "truth_id")


def lines_to_truth(instances: DataFrame, truth: DataFrame) -> DataFrame:
    """``(image_id, instance_id, truth_id)``: line curves from the lowest up with the true curves in their order ``number``."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("center_y").desc(), "instance_id")) - 1
    return instances.withColumn("number", rank).join(truth.select("image_id", "number", F.col("curve_id").alias("truth_id")), ["image_id", "number"]).select("image_id", "instance_id", "truth_id")


def truth_marker_centers(points: DataFrame, truth: DataFrame, plots: DataFrame) -> DataFrame:
    """``(image_id, curve_id, point_index, x, y, marker)``: where the markers of true curves were drawn.

    ``points(image_id, curve_id, point_index, x, y)`` are true data, ``truth`` has ``marker`` and ``marker_every``,
    ``plots`` the plot box and ``(dx_min, dx_max, dy_min, dy_max)`` of the data. Empty ranges give none.
    """
    c = F.col
    rows = points.join(truth.where("marker is not null and marker_every > 0").select("image_id", "curve_id", "marker", "marker_every"), ["image_id", "curve_id"])
    rows = rows.where(c("point_index") % c("marker_every") == 0).join(plots, "image_id").where("dx_max <> dx_min and dy_max <> dy_min")
    px = c("x_min") + (c("x") - c("dx_min")) / (c("dx_max") - c("dx_min")) * (c("x_max") - c("x_min"))
    py = c("y_max") - (c("y") - c("dy_min")) / (c("dy_max") - c("dy_min")) * (c("y_max") - c("y_min"))
    return rows.select("image_id", "curve_id", "point_index", px.alias("x"), py.alias("y"), "marker")


def _nearest_within(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """``(image_id, id, near)``: for each point of ``a(image_id, id, x, y)`` the nearest id of ``b`` within a distance, found through cells of that width."""
    cell = lambda n, d=0: F.floor(F.col(n) / tolerance) + d
    spots = b.select("image_id", F.col("id").alias("bid"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("gx"), cell("y").alias("gy"))
    asked = a.select("image_id", "id", "x", "y", F.explode(F.array(*[F.struct(cell("x", i).alias("gx"), cell("y", j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("g")).select("image_id", "id", "x", "y", "g.gx", "g.gy")
    far = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
    met = asked.join(spots, ["image_id", "gx", "gy"]).withColumn("far", far).where(F.col("far") <= tolerance)
    return met.groupBy("image_id", "id").agg(F.min_by("bid", F.struct("far", "bid")).alias("near"))


def marker_recall(markers: DataFrame, centers: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Counts of true markers and candidates ``(image_id, id, x, y)`` that match, recall and precision by image; several true markers may match one candidate."""
    met = _nearest_within(centers, markers, tolerance).groupBy("image_id").agg(F.count("*").alias("matched_truth"), F.count_distinct("near").alias("matched_candidates"))
    rows = centers.groupBy("image_id").agg(F.count("*").alias("truth_count")).join(markers.groupBy("image_id").agg(F.count("*").alias("candidate_count")), "image_id", "full").join(met, "image_id", "left").na.fill(0)
    return rows.withColumns({"recall": F.try_divide("matched_truth", "truth_count"), "precision": F.try_divide("matched_candidates", "candidate_count")})


def grouping_purity(labels: DataFrame, markers: DataFrame, centers: DataFrame, tolerance: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """How well groups ``labels(image_id, id, label, method)`` of markers keep to one true curve.

    The first table has each group's centre, size and most frequent true curve (the first by name of equals);
    the second the accuracy by image: markers of their group's curve over markers near a true one.
    """
    near = _nearest_within(markers, centers.select("image_id", "id", "x", "y"), tolerance).join(centers.select("image_id", F.col("id").alias("near"), "curve_id"), ["image_id", "near"])
    rows = labels.join(markers.select("image_id", "id", "y"), ["image_id", "id"])
    sizes = rows.groupBy("image_id", "label").agg(F.avg("y").alias("center_y"), F.count("*").alias("candidate_count"), F.first("method").alias("method"))
    counts = labels.join(near.select("image_id", "id", "curve_id"), ["image_id", "id"]).groupBy("image_id", "label", "curve_id").agg(F.count("*").alias("n"))
    top = counts.groupBy("image_id", "label").agg(F.min(F.struct((-F.col("n")).alias("n"), "curve_id")).alias("m")).select("image_id", "label", F.col("m.curve_id").alias("dominant"), (-F.col("m.n")).alias("correct"))
    groups = sizes.join(top, ["image_id", "label"], "left")
    matched = near.groupBy("image_id").agg(F.count("*").alias("matched"))
    total = groups.groupBy("image_id").agg(F.count("*").alias("groups"), F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"), F.first("method").alias("method")).join(matched, "image_id", "left")
    return groups, total.withColumn("accuracy", F.try_divide("correct", F.coalesce("matched", F.lit(0))))


def markers_to_truth(instances: DataFrame, groups: DataFrame) -> DataFrame:
    """``(image_id, instance_id, truth_id)``: marker curves in their order, each with the group not yet taken whose centre is nearest, and that group's true curve."""
    w = Window.partitionBy("image_id")
    a = instances.select("image_id", "instance_id", F.col("center_y").alias("ay"), (F.row_number().over(w.orderBy("instance_id"))).cast("long").alias("left_id"))
    b = groups.where("dominant is not null").select("image_id", F.col("dominant").alias("truth_id"), F.col("center_y").alias("gy"), F.row_number().over(w.orderBy("center_y", "label")).cast("long").alias("right_id"))
    # instances choose one after the other: an earlier one's distance counts for less than its turn
    pairs = a.join(b, "image_id").withColumn("score", -F.col("left_id").cast("double") * 1e9 - F.abs(F.col("ay") - F.col("gy")))
    kept = M.greedy_match(pairs).select("image_id", "left_id", "right_id")
    return pairs.join(kept, ["image_id", "left_id", "right_id"], "left_semi").select("image_id", "instance_id", "truth_id")


def binding_truth(best: DataFrame, curves: DataFrame, markers: DataFrame, lines: DataFrame, truth: DataFrame, prototypes: DataFrame) -> DataFrame:
    """One row a prototype: the true curve of its best target, the one expected (of the same number), and ``success``."""
    maps = curves.select("image_id", F.lit("curve").alias("target_type"), F.col("curve_id").alias("target_id"), "truth_id")
    for kind, rows in (("marker_instance", markers), ("line_style_instance", lines)):
        maps = maps.unionByName(rows.select("image_id", F.lit(kind).alias("target_type"), F.col("instance_id").alias("target_id"), "truth_id"))
    expected = truth.select("image_id", "number", F.col("curve_id").alias("expected"))
    rows = prototypes.select("image_id", "number", "prototype_id").join(expected, ["image_id", "number"], "left")
    rows = rows.join(best.select("image_id", "prototype_id", "target_type", "target_id", "score"), ["image_id", "prototype_id"], "left").join(maps, ["image_id", "target_type", "target_id"], "left")
    return rows.withColumn("success", F.coalesce(F.col("expected") == F.col("truth_id"), F.lit(False)))


def legend_delta(before: DataFrame, after: DataFrame, keys: list[str], by: str = "case") -> DataFrame:
    """How much each mean falls from one summary to another."""
    b = after.select(by, *[F.col(k).alias(f"after_{k}") for k in keys])
    return before.select(by, *keys).join(b, by).select(by, *[(F.col(k) - F.col(f"after_{k}")).alias(k) for k in keys])


def legend_exclusions(plots: DataFrame, curves: DataFrame) -> DataFrame:
    """The box that a legend in the upper left of a drawn plot takes, by the number of its curves; plots without curves have none."""
    c = F.col
    n = curves.groupBy("image_id").agg(F.count("*").alias("n"))
    rows = plots.join(n, "image_id")
    return rows.select("image_id", (c("x_min") + 8.0).alias("x_min"), (c("y_min") + 8.0).alias("y_min"), F.least("x_max", c("x_min") + 210.0).alias("x_max"), F.least("y_max", c("y_min") + 34.0 + 20.0 * c("n")).alias("y_max"), F.lit(1.0).alias("confidence"), F.lit("synthetic_truth").alias("source"))
