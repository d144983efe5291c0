"""From a drawn chart with a legend to its curves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwright.operators import binding as B
from plotwright.operators import extraction as E
from plotwright.operators import quality as Q

RGB = "image_id long, x long, y long, r int, g int, b int"
CURVES = [((200, 30, 30), 130, 25), ((30, 60, 200), 220, 18)]


def chart():
    rgb = np.full((320, 460, 3), 255)
    for colour, y, amp in CURVES:
        for x in range(45, 430):
            rgb[round(y + amp * math.sin(x / 30)) + np.arange(-1, 2), x] = colour
    rgb[20:281, 40] = rgb[280, 40:441] = 0
    # a framed legend in the corner, with samples and words
    rgb[21:67, 318] = rgb[21:67, 439] = 0
    rgb[21, 318:440] = rgb[66, 318:440] = 0
    for k, (colour, _, _) in enumerate(CURVES):
        rgb[33 + 20 * k : 36 + 20 * k, 326:356] = colour
        word = np.random.default_rng(k).random((8, 50)) < 0.5
        rgb[30 + 20 * k : 38 + 20 * k, 370:420][word] = 20
    return rgb


@pytest.fixture(scope="module")
def found(spark):
    rgb = chart()
    ys, xs = np.nonzero((rgb != 255).any(axis=2))
    rows = [(0, int(x), int(y), *(int(v) for v in rgb[y, x])) for x, y in zip(xs, ys)]
    images = spark.createDataFrame([(0, 460, 320), (1, 100, 100)], "image_id long, width int, height int")
    pixels = spark.createDataFrame(rows, RGB).cache()
    texts = spark.createDataFrame([(0, k, f"Curve {k}", 370.0, 29.0 + 20 * k, 420.0, 39.0 + 20 * k, 395.0, 34.0 + 20 * k) for k in range(2)], "image_id long, id long, text string, x_min double, y_min double, x_max double, y_max double, cx double, cy double")
    return E.extract(images, pixels, texts, (0.0, 10.0), (0.0, 100.0))


def test_axes_legend_and_curves(found):
    axes = {x.image_id: x for x in found.axes.collect()}
    assert (axes[0].x_min, axes[0].y_min, axes[0].x_max, axes[0].y_max) == (40, 20, 440, 280) and not axes[1].success
    items = found.items.orderBy("row").collect()
    assert [x.label for x in items] == ["Curve 0", "Curve 1"] and [(x.r, x.g, x.b) for x in items] == [c for c, _, _ in CURVES]
    curves = found.curves.collect()
    # the legend's words are dark pieces as well: excluded boxes start no coloured region, but don't hide dark ones
    dark = [x for x in curves if max(x.r, x.g, x.b) < 60]
    assert len(curves) == 3 and len(dark) == 1 and all(x.confidence == 1.0 for x in curves if x not in dark)
    assert found.masks.where(F.col("curve_id") == dark[0].curve_id).first().pixel_count == 0
    with pytest.raises(AttributeError):
        found.nothing


def test_paths_follow_the_curves(found):
    red = found.curves.where("r > 150").first().curve_id
    for curve, (_, y, amp) in ((red, CURVES[0]), (found.curves.where("b > 150").first().curve_id, CURVES[1])):
        points = found.points.where(F.col("curve_id") == curve).collect()
        assert len({p.x for p in points}) >= 370
        assert max(abs(p.y - (y + amp * math.sin(p.x / 30))) for p in points) <= 2.0
    data = found.data.where(F.col("curve_id") == red).collect()
    assert all(p.x == pytest.approx((p.pixel_x - 40) / 40) and p.y == pytest.approx(100 * (1 - (p.pixel_y - 20) / 260)) for p in data)


def test_prototypes_are_bound_to_their_curves(found):
    curves = {x.curve_id: (x.r > 150) for x in found.curves.collect()}
    best = {x.prototype_id: x for x in B.best(found.bindings).collect()}
    assert [curves[best[f"legend_proto_0{k}"].target_id] for k in range(2)] == [True, False]
    assert {x.target_type for x in best.values()} == {"curve"}
    bound = found.bound_paths.orderBy("prototype_id").collect()
    assert [x.label for x in bound] == ["Curve 0", "Curve 1"]
    n = {x.prototype_id: x["count"] for x in found.bound_points.groupBy("prototype_id").count().collect()}
    assert min(n.values()) >= 370
    summary = B.binding_summary(found.bindings).first()
    assert summary.prototypes == 2 and [x.prototype_id for x in summary.best] == ["legend_proto_00", "legend_proto_01"]
    assert B.path_summary(found.bound_points, found.bound_paths).first().paths == 2


def test_the_report(found):
    rows = {x.image_id: x for x in found.report.collect()}
    assert rows[0].axis_success and (rows[0].curve_count, rows[0].paths_count, rows[0].legends_count, rows[0].prototypes_count) == (3, 2, 1, 2) and rows[0].mean_path_coverage_ratio > 0.9
    assert not rows[1].axis_success and rows[1].curve_count == 0 and rows[1].mean_path_confidence is None


def test_axes_against_truth(spark, found):
    truth = spark.createDataFrame([(0, 41.0, 20.0, 440.0, 284.0), (1, 0.0, 0.0, 1.0, 1.0)], "image_id long, x_min double, y_min double, x_max double, y_max double")
    rows = {x.image_id: x for x in Q.evaluate_axes(found.axes, truth).collect()}
    assert (rows[0].x_min_error, rows[0].y_max_error, rows[0].mean_error, rows[0].origin_error, rows[0].y_end_error) == (1.0, 4.0, 1.25, math.hypot(1, 4), 1.0)
    assert not rows[1].axis_success and rows[1].error


def test_curves_and_markers_against_truth(spark):
    truth = spark.createDataFrame([(0, 0, "t0", "#ff0000"), (0, 1, "t1", "#0000ff"), (0, 2, "t2", "#0000f0")], "image_id long, number int, curve_id string, color string")
    protos = spark.createDataFrame([(0, "c0", 0, 0, 250), (0, "c1", 250, 5, 5)], "image_id long, curve_id string, r int, g int, b int")
    assert {(x.truth_id, x.curve_id) for x in Q.match_prototypes(truth, protos).collect()} == {("t0", "c1"), ("t1", "c0"), ("t2", "c0")}
    assert {(x.truth_id, x.curve_id) for x in Q.curves_to_truth(truth, protos).collect()} == {("t0", "c1"), ("t1", "c0")}
    styles = spark.createDataFrame([("-",), ("--",), (":",), ("(0, (5, 1))",), ("(0, (1, 1))",), ("None",), ("-.",)], "s string").select(Q.truth_line_style(F.col("s")).alias("k")).collect()
    assert [x.k for x in styles] == ["solid", "dashed", "dotted", "dashed", "dotted", "unknown", "dashed"]
    spots = "image_id long, id long, x double, y double"
    centers = spark.createDataFrame([(0, 0, 10.0, 10.0, "a"), (0, 1, 13.0, 10.0, "a"), (0, 2, 50.0, 80.0, "b"), (0, 3, 300.0, 10.0, "b")], f"{spots}, curve_id string")
    marks = spark.createDataFrame([(0, 0, 12.0, 10.0), (0, 1, 55.0, 84.0), (0, 2, 200.0, 200.0)], spots)
    row = Q.marker_recall(marks, centers).first()
    assert (row.matched_truth, row.matched_candidates, row.recall, row.precision) == (3, 2, 0.75, pytest.approx(2 / 3))
    labels = spark.createDataFrame([(0, 0, 0, "x_rank"), (0, 1, 1, "x_rank"), (0, 2, 1, "x_rank")], "image_id long, id long, label int, method string")
    groups, total = Q.grouping_purity(labels, marks, centers)
    assert total.first().accuracy == 1.0 and {(x.label, x.dominant) for x in groups.collect()} == {(0, "a"), (1, "b")}
    instances = spark.createDataFrame([(0, "m0", 11.0), (0, "m1", 12.0)], "image_id long, instance_id string, center_y double")
    assert {(x.instance_id, x.truth_id) for x in Q.markers_to_truth(instances, groups).collect()} == {("m0", "a"), ("m1", "b")}
    assert {(x.instance_id, x.truth_id) for x in Q.lines_to_truth(instances, truth).collect()} == {("m1", "t0"), ("m0", "t1")}
