"""The suite of drawn charts: curves traced from true and from found masks, measured against the truth."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binding as B
from . import colors as H
from . import extraction as E
from . import instances as I
from . import legends as L
from . import matching as M
from . import quality as Q
from . import synthetic as Y

#: Curves of charts take less of a plot than those of other images may.
RULE = replace(H.Coloring(), share=(0.0004, 0.90))
MEANS = ("chamfer", "hausdorff", "mean_truth_to_pred", "mean_completed_to_truth", "completed_ratio", "mae", "rmse", "max_error", "r2", "x_coverage", "coverage", "mask_iou", "mask_f1", "mask_tolerant_f1")


def _key() -> F.Column:
    return F.to_json(F.struct("image_id", "curve_id")).alias("key")


def measure(traced: dict[str, DataFrame], truth_points: DataFrame, images: DataFrame, masks: DataFrame | None = None, true_masks: DataFrame | None = None) -> DataFrame:
    """One row for each traced curve ``(image_id, curve_id)``: distances of its path in pixels and errors of its data against the true curve of its id, and how well its mask agrees."""
    c = F.col
    points = E.kept(traced["points"], "measured")
    pred = points.select(_key(), F.monotonically_increasing_id().alias("id"), c("x").cast("double").alias("x"), c("y").cast("double").alias("y"), "completed").withColumnRenamed("key", "image_id")
    pred = E.kept(pred, "pred")
    spots = Y.to_pixels(truth_points, images).select(_key(), F.monotonically_increasing_id().alias("id"), c("px").alias("x"), c("py").alias("y")).withColumnRenamed("key", "image_id")
    spots = E.kept(spots.join(pred.select("image_id").distinct(), "image_id", "left_semi"), "spots")
    out = Q.evaluate_paths(pred, spots).withColumnRenamed("image_id", "key")

    box = images.select("image_id", "x_min", "y_min", "x_max", "y_max", "dx_min", "dx_max", "dy_min", "dy_max")
    u = (c("x") - c("x_min")) / (c("x_max") - c("x_min"))
    v = 1.0 - (c("y") - c("y_min")) / (c("y_max") - c("y_min"))
    data = points.join(box, "image_id").select(_key(), F.monotonically_increasing_id().alias("id"), (c("dx_min") + u * (c("dx_max") - c("dx_min"))).alias("x"), (c("dy_min") + v * (c("dy_max") - c("dy_min"))).alias("y")).withColumnRenamed("key", "curve_id")
    true = truth_points.select(_key(), "x", "y").withColumnRenamed("key", "curve_id")
    found = M.data_metrics(E.kept(data, "data"), true).withColumnRenamed("curve_id", "key")
    out = out.join(found.drop("n"), "key", "left")
    paths = traced["paths"].select(_key(), "image_id", "curve_id", Q.coverage(c("points"), c("completed"), c("observed")).alias("coverage"), "rebuilt")
    out = out.join(paths, "key").withColumn("completed_ratio", c("completed_points") / c("pred_points"))
    for name, tolerance in (("mask", 0), ("mask_tolerant", 2)) if masks is not None else ():
        of = lambda m: m.select(_key(), "x", "y").withColumnRenamed("key", "image_id")
        agree = M.mask_metrics(of(masks), of(true_masks), tolerance).select(c("image_id").alias("key"), c("iou").alias(f"{name}_iou"), c("f1").alias(f"{name}_f1"), c("precision").alias(f"{name}_precision"), c("recall").alias(f"{name}_recall"))
        out = out.join(agree, "key", "left")
    return out


def summarized(rows: DataFrame) -> DataFrame:
    """Means of the curves of each image whose path was found, and the numbers of curves, found ones and rebuilt ones."""
    ok = F.col("path_success")
    means = [F.avg(F.when(ok, F.col(m))).alias(m) for m in MEANS if m in rows.columns]
    return rows.groupBy("image_id").agg(F.count("*").alias("curves"), F.count_if(ok).alias("valid"), F.count_if(ok & F.col("rebuilt")).alias("rebuilt"), *means)


def found_masks(pixels: DataFrame, images: DataFrame, curves: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """Masks of the prototypes nearest in colour to the true curves, under these curves' ids."""
    protos = E.kept(H.prototypes(pixels, images, exclusions, RULE), "prototypes")
    match = Q.match_prototypes(curves, protos)
    named = match.join(protos, ["image_id", "curve_id"]).drop("curve_id").withColumnRenamed("truth_id", "curve_id")
    return E.kept(H.prototype_masks(pixels, images, named, exclusions), "found")


def run(spark: SparkSession, charts: Sequence[Y.Chart] = Y.SUITE) -> dict[str, DataFrame]:
    """Summaries by chart: ``truth`` (traced from drawn masks), ``found`` (from masks by colour), and for charts with a legend inside ``excluded`` (its true box left out) and ``detected`` (the box found in the pixels), with ``deltas`` of what leaving it out gains."""
    images, curves, points = Y.truth(spark, charts)
    points = E.kept(points, "truth")
    pixels = E.kept(Y.image_pixels(points, curves, images), "pixels")
    true_masks = E.kept(Y.lines(points, curves, images, mask=True), "true_masks")
    out = {"truth": summarized(measure(E.trace(true_masks), points, images))}

    def judged(some: DataFrame, exclusions: DataFrame | None) -> DataFrame:
        of = lambda d: d.join(some.select("image_id"), "image_id", "left_semi")
        masks = found_masks(of(pixels), some, of(curves), exclusions)
        return E.kept(summarized(measure(E.trace(masks), of(points), some, masks, of(true_masks))), "summary")

    out["found"] = judged(images, None)
    if any(chart.normalized().legend_inside for chart in charts):
        inside = images.where("legend_inside")
        out["excluded"] = judged(inside, Q.legend_exclusions(inside, curves))
        boxes = E.kept(L.pixel_legends(pixels.join(inside.select("image_id"), "image_id", "left_semi"), inside), "boxes")
        out["detected"] = judged(inside, boxes)
        out["legends"] = boxes
        out["deltas"] = Q.legend_delta(out["found"], out["excluded"], [m for m in MEANS if m in out["found"].columns], "image_id")
    return out


def bindings(spark: SparkSession, charts: Sequence[Y.Chart]) -> dict[str, DataFrame]:
    """How well legends' prototypes are bound to the curves of charts with a legend inside.

    The samples' styles and missing labels are taken from the truth, as only the binding is judged. ``rows``
    has one row a prototype, ``summary`` the accuracy by chart, ``paths`` the measures of bound paths.
    """
    c = F.col
    images, curves, points = Y.truth(spark, charts)
    points = E.kept(points, "truth")
    pixels = E.kept(Y.image_pixels(points, curves, images), "pixels")
    legends = L.merge_legends(L.pixel_legends(pixels, images))
    missing = images.join(legends.select("image_id"), "image_id", "left_anti")
    legends = E.kept(legends.select("image_id", *Q.BOX, "legend_index").unionByName(Q.legend_exclusions(missing, curves).select("image_id", *Q.BOX, F.lit(0).alias("legend_index"))), "legends")
    items = L.legend_items(pixels, legends, images).withColumn("label", F.lit(None).cast("string"))
    protos = L.visual_prototypes(items)
    known = curves.select("image_id", "number", c("label").alias("t_label"), Q.truth_line_style(c("linestyle")).alias("t_line"), F.when(c("marker").isNull(), "unknown").otherwise("repeated_compact").alias("t_mark"))
    protos = protos.join(known, ["image_id", "number"], "left").withColumns({"label": F.coalesce("label", "t_label"), "line_style": F.coalesce("t_line", "line_style"), "marker_style": F.coalesce("t_mark", "marker_style")}).drop("t_label", "t_line", "t_mark")
    protos = E.kept(protos, "protos")
    found = E.kept(H.prototypes(pixels, images, legends, RULE), "curves")
    traced = E.trace(E.kept(H.prototype_masks(pixels, images, found, legends), "masks"))
    pieces = E.kept(I.drop_borders(traced["pieces"], images), "pieces")
    marked, lined = E.group(pieces, traced["markers"], protos)
    scores = E.kept(B.scores(protos, found, pieces, traced["markers"], marked, lined), "scores")
    best = B.best(scores)
    centers = Q.truth_marker_centers(points, curves, images).withColumn("id", F.monotonically_increasing_id())
    centers = E.kept(centers, "centers")
    spots = E.kept(traced["markers"].select("image_id", "curve_id", "x", "y").withColumn("id", F.monotonically_increasing_id()), "spots")
    counts = curves.where("marker is not null").groupBy("image_id").agg(F.count("*").cast("int").alias("groups"))
    labels = E.kept(I.grouped(spots.join(counts, "image_id").withColumn("weight", F.lit(1.0)), "groups", I.MARKER_COLUMN), "labels")
    groups, purity = Q.grouping_purity(labels, spots, centers)
    rows = Q.binding_truth(best, Q.curves_to_truth(curves, found), Q.markers_to_truth(marked, groups), Q.lines_to_truth(lined, curves), curves, protos)
    rows = E.kept(rows, "rows")
    summary = rows.where("expected is not null").groupBy("image_id").agg(F.count("*").alias("prototypes"), F.count_if("success").alias("successes"), F.avg("score").alias("mean_best_score"))
    bound, paths = B.bound_paths(protos, scores, traced["points"], traced["paths"], pieces, marked, lined)
    expected = rows.where("expected is not null").select("image_id", "prototype_id", c("expected").alias("curve_id"))
    bound = bound.join(expected, ["image_id", "prototype_id"])
    shown = bound.groupBy("image_id", "curve_id").agg(F.count("*").alias("points"), F.count_if("completed").alias("completed"))
    judged = measure({"points": bound, "paths": shown.withColumns({"observed": c("points"), "rebuilt": F.lit(False)})}, points, images)
    return {"rows": rows, "summary": summary.withColumn("accuracy", c("successes") / c("prototypes")), "paths": summarized(judged), "purity": purity, "recall": Q.marker_recall(spots, centers)}
