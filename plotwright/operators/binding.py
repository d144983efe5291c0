"""Prototypes of a legend bound to the curves of a plot: scores, the best one-to-one choice, bound paths, summaries.

All of it is joins within an image and expressions; the choice alone takes one image's scores at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import matching as M
from .curves import gap_points

_STRINGS = "array<string>"


def marker_similarity(style: Column, shapes: Column) -> Column:
    """Agreement of a prototype's marker with the ``shapes`` of a curve's markers; null shapes mean no markers."""
    known = F.filter(shapes, lambda s: s != "unknown")
    return (
        F.when(shapes.isNull() | (F.size(shapes) == 0), 0.0)
        .when(style == "unknown", 0.5)
        .when(F.size(known) == 0, 0.35)
        .when(F.exists(known, lambda s: s == style), 1.0)
        .when(style.isin("single_compact", "repeated_compact"), 0.75)
        .otherwise(0.25)
    )


def line_similarity(style: Column, lines: Column, marks: Column, pieces: Column) -> Column:
    """Agreement of a prototype's line with a curve of so many line-like, marker-like and all pieces."""
    return (
        F.when(F.coalesce(pieces, F.lit(0)) == 0, 0.0)
        .when(style == "unknown", F.when(lines > 0, 0.5).otherwise(0.25))
        .when(style == "solid", F.when(lines > 0, 1.0).otherwise(0.25))
        .when(style.isin("dashed", "dotted"), F.when(marks > lines, 0.85).when(pieces > 3, 0.65).otherwise(0.35))
        .otherwise(0.5)
    )


def marker_instance_similarity(style: Column, markers: Column) -> Column:
    base = F.least(F.lit(1.0), markers / 8.0)
    return F.when(markers <= 0, 0.0).when(style == "unknown", 0.8 * base).otherwise(F.least(F.lit(1.0), 0.8 * base + 0.2))


def _warned(*said: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(text)) for test, text in said]))


BINDING = ("image_id", "prototype_id", "legend_item_id", "target_type", "target_id", "score", "color_similarity", "line_similarity", "marker_similarity", "confidence", "warnings")


def scores(prototypes: DataFrame, curves: DataFrame, pieces: DataFrame, markers: DataFrame, marker_instances: DataFrame, line_instances: DataFrame) -> DataFrame:
    """Every prototype of an image against each of its curves, marker curves and line curves: columns BINDING.

    ``prototypes`` as ``legends.visual_prototypes`` gives them, ``curves`` as ``colors.prototypes``, ``pieces``
    and ``markers`` with ``(image_id, curve_id)`` and their class or shape, instances as in ``instances``.
    """
    c = F.col
    count = prototypes.groupBy("image_id").agg(F.count("*").alias("prototypes"))
    protos = prototypes.join(count, "image_id").select("image_id", "number", "prototype_id", "legend_item_id", "prototypes", "line_style", "marker_style", c("confidence").alias("sure"), c("r").alias("pr"), c("g").alias("pg"), c("b").alias("pb"))
    gray = S.is_achromatic([c("pr"), c("pg"), c("pb")])
    covered = curves.groupBy("image_id").agg(F.count("*").alias("curves"))

    kinds = pieces.groupBy("image_id", "curve_id").agg(F.count("*").alias("pieces"), F.count_if(c("class_label") == "line_like").alias("lines"), F.count_if(c("class_label") == "marker_like").alias("marks"))
    shapes = markers.groupBy("image_id", "curve_id").agg(F.collect_set("shape").alias("shapes"))
    near = curves.select("image_id", "curve_id", "r", "g", "b", c("confidence").alias("seen"), c("source").alias("by")).join(kinds, ["image_id", "curve_id"], "left").join(shapes, ["image_id", "curve_id"], "left")
    near = protos.join(near, "image_id")
    near = near.withColumns({
        "color_similarity": S.rgb_similarity([c("pr"), c("pg"), c("pb")], [c("r"), c("g"), c("b")]),
        "line_similarity": line_similarity(c("line_style"), c("lines"), c("marks"), c("pieces")),
        "marker_similarity": marker_similarity(c("marker_style"), c("shapes")),
    })
    no_color = c("color_similarity").isNull()
    # the weights of what is known make up one; lines and markers always are
    base = F.when(no_color, (0.20 * c("line_similarity") + 0.25 * c("marker_similarity")) / 0.45).otherwise(0.55 * c("color_similarity") + 0.20 * c("line_similarity") + 0.25 * c("marker_similarity"))
    styled = gray & (c("line_style") != "unknown") & (c("marker_style") == "unknown")
    weak = c("seen") < 0.8
    spared = weak & (c("by") == "guided_gray") & (c("color_similarity") >= 0.85) & gray
    score = base * F.when(F.coalesce(styled, F.lit(False)), 0.75).otherwise(1.0) * F.when(weak & ~F.coalesce(spared, F.lit(False)), F.greatest(F.lit(0.25), c("seen"))).otherwise(1.0)
    direct = near.withColumns({"score": score, "target_type": F.lit("curve"), "target_id": c("curve_id"), "warnings": _warned(
        (no_color, "missing_color_similarity"), (styled, "achromatic_line_style_prototype_penalizes_direct_curve"),
        (spared, "guided_gray_low_area_confidence_not_penalized"), (weak & ~F.coalesce(spared, F.lit(False)), "low_curve_prototype_confidence"), (c("marker_style") == "unknown", "prototype_marker_unknown"),
    )})

    def ranked(instances: DataFrame) -> DataFrame:
        """Instances numbered from the lowest place in the image up; prototypes come in that order too."""
        w = Window.partitionBy("image_id")
        rank = F.row_number().over(w.orderBy(c("center_y").desc(), "instance_id")) - 1
        return instances.withColumns({"rank": rank, "instances": F.count("*").over(w)})

    ordinal = S.ordinal_similarity(c("number"), c("rank"), c("prototypes"), c("instances"))
    none = F.lit(None).cast("double")
    marked = ranked(marker_instances).select("image_id", "instance_id", "rank", "instances", "marker_count", c("warnings").alias("said"))
    marked = protos.join(marked, "image_id").join(covered, "image_id", "left").withColumn("curves", F.coalesce("curves", F.lit(0)))
    alike = marker_instance_similarity(c("marker_style"), c("marker_count"))
    colored = (c("curves") >= c("prototypes")) & (c("prototypes") > 1)
    mixed = (c("curves") >= c("prototypes")) & F.array_contains("said", "mixed_source_curve_ids")
    score = (0.65 * alike + 0.35 * ordinal) * F.when(colored, 0.88).otherwise(1.0) * F.when(mixed, 0.82).otherwise(1.0)
    marked = marked.withColumns({"score": score, "marker_similarity": alike, "line_similarity": none, "color_similarity": none, "target_type": F.lit("marker_instance"), "target_id": c("instance_id"), "warnings": _warned(
        (c("marker_style") == "unknown", "prototype_marker_unknown"), (colored, "color_covered_scene_penalizes_marker_instance"), (mixed, "mixed_source_marker_instance_penalty"),
    )})

    lined = ranked(line_instances).select("image_id", "instance_id", "rank", "instances", "estimated_line_style", c("confidence").alias("firm"))
    lined = protos.join(lined, "image_id")
    alike = S.style_similarity(c("line_style"), c("estimated_line_style"))
    with_marker, colorful = c("marker_style") != "unknown", c("pr").isNotNull() & ~gray
    score = (0.80 * ordinal + 0.10 * alike + 0.10 * c("firm")) * F.when(with_marker, 0.80).otherwise(1.0) * F.when(F.coalesce(colorful, F.lit(False)), 0.70).otherwise(1.0)
    lined = lined.withColumns({"score": score, "line_similarity": alike, "marker_similarity": none, "color_similarity": none, "target_type": F.lit("line_style_instance"), "target_id": c("instance_id"), "warnings": _warned(
        (c("line_style") == "unknown", "prototype_line_style_unknown"), (c("estimated_line_style") == "unknown", "line_instance_style_unknown"),
        (with_marker, "marker_prototype_penalizes_line_style_instance"), (colorful, "color_prototype_penalizes_line_style_instance"),
    )})
    rows = [r.withColumn("confidence", F.least(F.lit(1.0), c("score") * c("sure"))).select(*BINDING) for r in (direct, marked, lined)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def best(bindings: DataFrame) -> DataFrame:
    """The bindings taken by falling score, each prototype and each target of an image once; ties by the names of prototype, kind and target."""
    target = F.struct("target_type", "target_id")
    w = Window.partitionBy("image_id")
    rows = bindings.withColumns({"left_id": F.dense_rank().over(w.orderBy("prototype_id")).cast("long"), "right_id": F.dense_rank().over(w.orderBy(target)).cast("long")})
    kept = M.greedy_match(rows).select("image_id", "left_id", "right_id")
    return rows.join(kept, ["image_id", "left_id", "right_id"], "left_semi").drop("left_id", "right_id")


def best_of_each(bindings: DataFrame) -> DataFrame:
    """Each prototype's own best binding; targets may repeat."""
    order = Window.partitionBy("image_id", "prototype_id").orderBy(F.col("score").desc(), "target_type", "target_id")
    return bindings.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


PATH_POINT = ("seq", "x", "y", "completed", "confidence")


def _chosen(prototypes: DataFrame, chosen: DataFrame, kind: str) -> DataFrame:
    p = prototypes.select("image_id", "prototype_id", "label", F.col("confidence").alias("proto_confidence"))
    return chosen.where(F.col("target_type") == kind).select("image_id", "prototype_id", "target_id", F.col("confidence").alias("binding_confidence"), F.col("warnings").alias("binding_warnings")).join(p, ["image_id", "prototype_id"])


def _compressed(points: DataFrame) -> DataFrame:
    """One point for each whole x of a path, with the mean y, in order: ``(path_id, seq, x, y)``."""
    rows = points.groupBy("path_id", F.bround("x").alias("x")).agg(F.avg("y").alias("y"))
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("path_id").orderBy("x")) - 1)


def connected(points: DataFrame, confidence: Column | float = 1.0) -> DataFrame:
    """``(path_id, seq, x, y, completed)`` of points in no order: one for each whole x, gaps filled where they may be."""
    filled = gap_points(_compressed(points).withColumnRenamed("path_id", "curve_id"))
    seq = F.row_number().over(Window.partitionBy("curve_id").orderBy("seq", "i")) - 1
    return filled.select(F.col("curve_id").alias("path_id"), seq.alias("seq"), "x", "y", "completed")


def _key() -> Column:
    return F.to_json(F.struct("image_id", "prototype_id")).alias("path_id")


def bound_paths(prototypes: DataFrame, bindings: DataFrame, points: DataFrame, paths: DataFrame, pieces: DataFrame, marker_instances: DataFrame, line_instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The path of each prototype's best target: ``(image_id, prototype_id, seq, x, y, completed, confidence)`` and one row a path.

    A curve gives its own path (``points``, ``paths`` with ``(image_id, curve_id)``), or, where that shows under
    55 % of what was observed and its line-like pieces reach 15 % further, their points connected. A marker
    curve gives the path of the curve its markers came from, if no other marker curve came from it, else its
    markers. A line curve gives its pieces' points connected. Prototypes without a target have none.
    """
    c = F.col
    chosen = best(bindings)
    keys = ["image_id", "prototype_id"]

    # own paths of curves, and what their pieces make of them
    direct = _chosen(prototypes, chosen, "curve").join(paths.select("image_id", c("curve_id").alias("target_id"), "observed", "points", c("confidence").alias("path_confidence"), c("warnings").alias("path_warnings")), ["image_id", "target_id"])
    direct = direct.withColumn("sure", F.least("binding_confidence", "path_confidence", "proto_confidence"))
    own = direct.join(points.select("image_id", c("curve_id").alias("target_id"), *PATH_POINT), ["image_id", "target_id"])
    poor = direct.where(c("points") / F.greatest("observed", "points") < 0.55).select("image_id", "prototype_id", "target_id")
    lines = pieces.where("class_label = 'line_like'").select("image_id", c("curve_id").alias("target_id"), F.explode("path").alias("p"))
    made = connected(poor.join(lines, ["image_id", "target_id"]).select(_key(), "p.x", "p.y"))
    reach = lambda rows, by: rows.groupBy(by).agg((F.max("x") - F.min("x")).alias("span"), F.count("*").alias("n"))
    old = reach(own.select(_key(), "x"), "path_id").select("path_id", c("span").alias("old_span"), c("n").alias("old_n"))
    better = reach(made, "path_id").join(old, "path_id").where((c("span") > c("old_span") * 1.15) & (c("n") > c("old_n"))).select("path_id")
    low = lambda rows: rows.select(*keys, "seq", "x", "y", "completed", F.when(c("completed"), F.least("sure", F.lit(0.35))).otherwise(c("sure")).alias("confidence"))
    named = direct.select(_key(), *keys, "sure")
    rebuilt = low(made.join(better, "path_id", "left_semi").join(named, "path_id"))
    kept = own.withColumn("path_id", _key()).join(better, "path_id", "left_anti").select(*keys, *PATH_POINT)
    direct = direct.withColumn("path_id", _key()).join(better.withColumn("rebuilt", F.lit(True)), "path_id", "left")
    direct = direct.select(*keys, "label", "sure", F.lit("curve").alias("target_type"), "target_id", F.concat("binding_warnings", "path_warnings", _warned((c("rebuilt"), "curve_path_rebuilt_from_line_components"))).alias("warnings"))

    # marker curves
    sole = marker_instances.groupBy("image_id", "source_curve_id").agg(F.count("*").alias("n")).where("n = 1").select("image_id", "source_curve_id", F.lit(True).alias("alone"))
    marked = marker_instances.join(sole, ["image_id", "source_curve_id"], "left").select("image_id", c("instance_id").alias("target_id"), "source_curve_id", "alone", c("points").alias("spots"), c("confidence").alias("firm"), c("warnings").alias("said"))
    marked = _chosen(prototypes, chosen, "marker_instance").join(marked, ["image_id", "target_id"])
    source = paths.select("image_id", c("curve_id").alias("source_curve_id"), c("confidence").alias("path_confidence"), F.lit(True).alias("traced"))
    marked = marked.join(source, ["image_id", "source_curve_id"], "left").withColumn("uses", F.coalesce(c("alone") & c("traced"), F.lit(False)))
    marked = marked.withColumn("sure", F.least("binding_confidence", "firm", "proto_confidence", F.when(c("uses"), c("path_confidence"))))
    through = marked.where("uses").select(*keys, "source_curve_id").join(points.withColumnRenamed("curve_id", "source_curve_id"), ["image_id", "source_curve_id"]).select(*keys, *PATH_POINT)
    spots = marked.where("not uses").select(*keys, "sure", F.posexplode("spots").alias("seq", "p")).select(*keys, "seq", "p.x", "p.y", F.lit(False).alias("completed"), c("sure").alias("confidence"))
    marked = marked.select(*keys, "label", "sure", F.lit("marker_instance").alias("target_type"), "target_id", F.concat("binding_warnings", "said", _warned((c("uses"), "marker_path_uses_source_curve_path"))).alias("warnings"))

    # line curves
    lined = line_instances.select("image_id", c("instance_id").alias("target_id"), c("points").alias("spots"), c("confidence").alias("firm"), c("warnings").alias("said"))
    lined = _chosen(prototypes, chosen, "line_style_instance").join(lined, ["image_id", "target_id"]).withColumn("sure", F.least("binding_confidence", "firm", "proto_confidence"))
    strung = connected(lined.select(_key(), F.explode("spots").alias("p")).select("path_id", "p.x", "p.y"))
    strung = low(strung.join(lined.select(_key(), *keys, "sure"), "path_id"))
    lined = lined.select(*keys, "label", "sure", F.lit("line_style_instance").alias("target_type"), "target_id", F.concat("binding_warnings", "said").alias("warnings"))

    every = [r.select(*keys, *[c(n).cast("double" if n in ("x", "y", "confidence") else "boolean" if n == "completed" else "long").alias(n) for n in PATH_POINT]) for r in (kept, rebuilt, through, spots, strung)]
    all_points = every[0]
    for r in every[1:]:
        all_points = all_points.unionByName(r)
    return all_points, direct.unionByName(marked).unionByName(lined).withColumnRenamed("sure", "confidence")


def binding_summary(bindings: DataFrame) -> DataFrame:
    """Number of an image's bindings, of its best ones, their mean score, and these in the order of their prototypes."""
    chosen = best(bindings).groupBy("image_id").agg(F.count("*").alias("prototypes"), F.avg("score").alias("mean_best_score"), F.array_sort(F.collect_list(F.struct("prototype_id", "target_type", "target_id", "score"))).alias("best"))
    return bindings.groupBy("image_id").agg(F.count("*").alias("bindings")).join(chosen, "image_id", "left")


def path_summary(points: DataFrame, paths: DataFrame) -> DataFrame:
    """Number of an image's bound paths, their points and completed points, the share of these, and means by path."""
    n = points.groupBy("image_id", "prototype_id").agg(F.count("*").alias("n"), F.count_if("completed").alias("done"))
    rows = paths.join(n, ["image_id", "prototype_id"], "left").groupBy("image_id").agg(F.count("*").alias("paths"), F.coalesce(F.sum("n"), F.lit(0)).alias("points"), F.coalesce(F.sum("done"), F.lit(0)).alias("completed"), F.avg(F.coalesce("n", F.lit(0))).alias("mean_points"), F.avg("confidence").alias("mean_confidence"))
    return rows.withColumn("completed_ratio", S.safe_ratio(F.col("completed"), F.col("points")))
