"""Drawn charts and the suite's gates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwright.functions import families
from plotwright.operators import suite as U
from plotwright.operators import synthetic as Y


def test_families(spark):
    x = np.linspace(0, 180, 400)
    rows = spark.createDataFrame([(float(v), i) for v in x for i in range(4)], "x double, i int").select("x", "i", families.rising_frequencies(F.col("x")).alias("a"), families.beating_waves(F.col("x"), F.col("i")).alias("b"), families.shifted_line(F.col("x"), F.col("i"), "damped").alias("c"))
    for r in rows.collect():
        turns = r.x / 60 if r.x <= 60 else 1 + 2 * (r.x - 60) / 60 if r.x <= 120 else 5 + 4 * (r.x - 120) / 60
        assert r.a == pytest.approx(50 + 30 * np.sin(2 * np.pi * turns), abs=1e-9)
        assert r.b == pytest.approx((30 + 10 * r.i) * np.sin((0.1 + 0.03 * r.i) * r.x + r.i * np.pi / 2) * np.cos(0.015 * r.x) + 20 * np.sin(0.2 * r.x), abs=1e-9)
        assert r.c == pytest.approx((0.8 + 0.4 * np.sin(r.i)) * np.cos(r.x + 0.8 * r.i) * np.exp(-(r.x + 0.8 * r.i) / 10), abs=1e-9)


def test_charts_and_their_options():
    assert Y.Chart().plot == pytest.approx((144.0, 90.0, 936.0, 645.0))
    dense = Y.Chart(dense_legend=True).normalized()
    assert (dense.curves, dense.legend_inside, dense.font_size) == (10, True, 7) and dense.style(1)[2:] == ("s", 70)
    assert Y.Chart(markers_only=True).style(2) == ("#2ca02c", "None", "^", 35)
    assert Y.Chart(gray_markers=True).normalized().style(1) == ("#5a5a5a", "-", "s", 45)
    assert Y.Chart(gray_lines=True).style(4)[1] == "(0, (5, 1))" and Y.Chart(occlusion=True).title == "Local Occlusion Curves"


def test_truth_and_drawing(spark):
    chart = Y.Chart("c", curves=2, points=200, width=400, height=250, occlusion=True)
    images, curves, points = Y.truth(spark, [chart])
    assert points.count() == 400 and [x.color for x in curves.orderBy("number").collect()] == ["#1f77b4", "#ff7f0e"]
    bends = [x.bend for x in Y.truth(spark, [Y.Chart()])[1].orderBy("number").collect()]
    assert bends[0] == pytest.approx(18.121886831901772) and bends[5] == pytest.approx(17.479128197255072)
    pixels = Y.image_pixels(points, curves, images).collect()
    assert len({(p.x, p.y) for p in pixels}) == len(pixels) and {(p.r, p.g, p.b) for p in pixels} == {(0, 0, 0), (31, 119, 180), (255, 127, 14)}
    mask = Y.lines(points, curves, images, mask=True).where("curve_id = 'curve_00'").collect()
    # hidden around x = 10 of 30, over 0.55
    x = 48 + 10 / 30 * 264
    assert not [p for p in mask if abs(p.x - x) < 0.2] and len({p.x for p in mask}) > 240


def test_the_gates_of_the_suite(spark):
    out = {k: {x.image_id: x for x in v.collect()} for k, v in U.run(spark, [Y.Chart(), Y.Chart("legend_inside_curves", legend_inside=True)]).items() if k != "legends"}
    basic = out["found"]["basic_curves"]
    assert basic.curves == basic.valid == 6
    print({m: round(basic[m], 4) for m in U.MEANS if basic[m] is not None})
    assert basic.chamfer < 1.25 and basic.hausdorff < 8 and basic.mask_tolerant_f1 > 0.85 and basic.rmse < 0.03 and basic.r2 > 0.99 and basic.x_coverage > 0.95
    polluted, clean, seen = (out[k]["legend_inside_curves"] for k in ("found", "excluded", "detected"))
    print([round(p.hausdorff, 2) for p in (polluted, clean, seen)], [round(p.rmse, 4) for p in (polluted, clean, seen)])
    assert polluted.hausdorff > 100 and polluted.rmse > 0.1
    for row in (clean, seen):
        assert row.chamfer < 1.25 and row.hausdorff < 8 and row.rmse < 0.03
    assert out["deltas"]["legend_inside_curves"].hausdorff > 100


def test_prototypes_of_line_and_marker_curves_are_bound(spark):
    out = U.bindings(spark, [Y.Chart("line_markers", seed=25, curves=4, line_markers=True, legend_inside=True)])  # limits are in pixels, so the size is the usual one
    summary, paths = out["summary"].first(), out["paths"].first()
    assert summary.prototypes == 4 and summary.accuracy == 1.0
    assert paths.valid == 4 and paths.rmse < 0.08 and paths.x_coverage > 0.9
    assert out["recall"].first().recall > 0.9 and out["purity"].first().accuracy == 1.0
