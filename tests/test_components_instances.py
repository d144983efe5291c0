"""Pieces, markers and curves told apart by them, on drawn masks and against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwright.operators import components as P
from plotwright.operators import instances as I

XY = "image_id long, x long, y long"


def pixels(image, mask):
    ys, xs = np.nonzero(mask)
    return [(image, int(x), int(y)) for x, y in zip(xs, ys)]


def disc(mask, cx, cy, r):
    y, x = np.ogrid[: mask.shape[0], : mask.shape[1]]
    mask |= (x - cx) ** 2 + (y - cy) ** 2 <= r * r


def test_pieces_are_lines_markers_or_noise(spark):
    line = [(0, x, 40) for x in range(5, 75)]
    plus = [(0, 100 + d, 40) for d in range(-5, 6)] + [(0, 100, 40 + d) for d in range(-5, 6) if d]
    rows = P.line_components(spark.createDataFrame(line + plus + [(0, 120, 10)], XY)).orderBy("x0").collect()
    assert [x.class_label for x in rows] == ["line_like", "marker_like", "noise"]
    assert [len(x.path) for x in rows] == [70, 0, 0] and (rows[0].path_length, rows[0].endpoints) == (69.0, 2)
    assert (rows[0].x0, rows[0].x1, rows[2].confidence, rows[0].confidence) == (5, 75, 0.70, 1.0)
    described = P.described(spark.createDataFrame([(0, 0, 70, 70, 1), (0, 1, 21, 11, 11), (1, 0, 9, 5, 5)], "image_id long, component long, area long, width long, height long"))
    kept = {(x.image_id, x.component): x.skipped for x in P.drop_marker_like(described).collect()}
    assert kept == {(0, 0): 1, (1, 0): 0}


def test_outlines_of_known_shapes():
    square = np.ones((10, 10), bool)
    assert len(P.outline(square)) == 36 and P.circularity(square) == pytest.approx(4 * math.pi * 81 / 36**2)
    one = np.zeros((3, 3), bool)
    one[1, 1] = True
    assert P.outline(one).tolist() == [[1, 1]] and P.circularity(one) == 0.0 and P.circularity(~one & False) == 0.0
    bar = np.zeros((3, 9), bool)
    bar[1, 1:8] = True
    assert P.circularity(bar) == 0.0 and {tuple(p) for p in P.outline(bar)} == {(x, 1) for x in range(1, 8)}
    both = np.zeros((12, 30), bool)
    both[2:5, 2:5] = True
    both[1:11, 10:20] = True
    assert P.circularity(both) == pytest.approx(4 * math.pi * 81 / 36**2)


@pytest.mark.parametrize("seed", [1, 2])
def test_outlines_hold_every_outer_border_pixel(seed):
    r = np.random.default_rng(seed)
    mask = np.zeros((24, 24), bool)
    mask[2:22, 2:22] = r.random((20, 20)) < 0.7
    framed = np.pad(mask, 1)
    outside, todo = np.zeros_like(framed), [(0, 0)]
    while todo:  # the background that reaches the frame, by edges
        y, x = todo.pop()
        if 0 <= y < 26 and 0 <= x < 26 and not framed[y, x] and not outside[y, x]:
            outside[y, x] = True
            todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    ys, xs = np.nonzero(mask)
    piece, todo = set(), [(int(xs[0]), int(ys[0]))]
    while todo:
        x, y = todo.pop()
        if 0 <= x < 24 and 0 <= y < 24 and mask[y, x] and (x, y) not in piece:
            piece.add((x, y))
            todo += [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    border = {(x, y) for x, y in piece if any(outside[y + 1 + j, x + 1 + i] for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
    assert {tuple(p) for p in P.outline(mask)} == border


def test_depth_of_a_block():
    mask = np.zeros((15, 15), bool)
    mask[2:13, 2:13] = True
    deep = P.depth(mask)
    assert deep[7, 7] == 6.0 and deep[2, 7] == 1.0 and deep[1, 1] == 0.0 and deep[2, 2] == 1.0
    mask[:] = True
    assert not np.isfinite(P.depth(mask)).any()


def test_marker_shapes(spark):
    mask = np.zeros((90, 220), bool)
    disc(mask, 30, 40, 8)
    mask[32:49, 80:97] = True
    for d in range(-8, 9):
        mask[40 + d, 150 : 152] = True
        mask[40:42, 150 + d] = True
    found = P.marker_candidates(spark.createDataFrame(pixels(0, mask), XY), 220, 90).orderBy("x").collect()
    assert [x["shape"] for x in found] == ["circle_like", "square_like", "cross_like"]
    assert (found[1].x, found[1].y, found[1].pixel_count, found[1].fill_ratio) == (88.5, 40.5, 289, 1.0)
    assert all(not x.core and x.warnings == [] for x in found)


def test_markers_on_a_line_are_found_by_their_depth(spark):
    mask = np.zeros((80, 200), bool)
    mask[39:41, 5:195] = True
    for x in (50, 100, 150):
        disc(mask, x, 40, 6)
    frame = spark.createDataFrame(pixels(0, mask), XY)
    found = P.marker_candidates(frame, 200, 80).orderBy("x").collect()
    assert [round(x.x) for x in found] == [50, 100, 150] and all(x.core and "distance_transform_candidate" in x.warnings for x in found)
    asked = spark.createDataFrame([(0, 0, 52.0, 41.0), (0, 1, 75.0, 40.0), (1, 2, 50.0, 40.0)], "image_id long, id long, x double, y double")
    assert [x.id for x in P.near_marker(asked, spark.createDataFrame(found)).collect()] == [0]
    assert P.marker_candidates(frame.limit(0), 200, 80).count() == 0


MARK = "image_id long, id long, x double, y double, curve_id string"


def test_markers_by_rank_in_their_columns(spark):
    rows = [(0, c * 3 + k, 40.0 + 50 * c + k, 30.0 + 40 * k + 2 * c, "a") for c in range(4) for k in range(3)]
    found = I.marker_instances(spark.createDataFrame(rows, MARK), 3).orderBy("instance_id").collect()
    assert [(x.instance_id, x.marker_count, x.grouping_method, x.source_curve_id) for x in found] == [(f"marker_instance_0{k}", 4, "x_rank", "a") for k in range(3)]
    assert [x.center_y for x in found] == [33.0, 73.0, 113.0] and found[0].confidence == 0.5 and [p.x for p in found[0].points] == [40.0, 90.0, 140.0, 190.0]
    lonely = [(1, i, 100.0 * i, 50.0 * (i % 2), "ab"[i % 2]) for i in range(16)]
    found = I.marker_instances(spark.createDataFrame(lonely, MARK)).collect()
    assert [x.grouping_method for x in found] == ["y_kmeans"] * 2 and sum(x.marker_count for x in found) == 16
    crossing = [(2, i, 20.0 * i, 10.0 * i if i % 2 else 300 - 10.0 * i, "a") for i in range(40)]
    found = I.marker_instances(spark.createDataFrame(crossing, MARK), 2, prefer_lines=True).collect()
    assert {x.grouping_method for x in found} == {"trajectory_ransac"} and sorted(x.marker_count for x in found) in ([20, 20], [19, 21])  # one lies on both


def test_scenes_and_inferred_groups(spark):
    n = spark.createDataFrame([(0,), (15,), (16,), (45,), (90,), (500,)], "n int").select(I.inferred_groups(F.col("n")).alias("k")).collect()
    assert [x.k for x in n] == [1, 1, 2, 2, 5, 8]
    markers = spark.createDataFrame([(0,), (0,), (1,)], "image_id long")
    pieces = spark.createDataFrame([(0, "line_like"), (1, "line_like"), (1, "noise"), (2, "line_like")], "image_id long, class_label string")
    assert {x.image_id: x.grouped for x in I.marker_scenes(markers, pieces).collect()} == {0: True, 1: False, 2: False}
    assert {x.image_id: x.grouped for x in I.line_scenes(pieces, 2).collect()} == {0: False, 1: False, 2: False}


PIECE = "image_id long, id long, curve_id string, class_label string, x0 long, y0 long, x1 long, y1 long, width long, height long, area long, max_span long, path_length double, path array<struct<x: double, y: double>>, confidence double"


def piece(i, x0, y0, w, h=2, label="line_like", image=0, path=None):
    return (image, i, "c", label, x0, y0, x0 + w, y0 + h, w, h, w, max(w, h), float(w - 1), path or [], 1.0)


def test_pieces_by_rank_and_their_styles(spark):
    rows = [piece(10 * k + i, 60 * i, 40 + 60 * k, (80, 20, 10)[k]) for k in range(3) for i in range(9)] + [piece(99, 0, 0, 5, label="noise")]
    found = I.line_instances(spark.createDataFrame(rows, PIECE), 3).orderBy("instance_id").collect()
    assert [x.component_count for x in found] == [9, 9, 9] and [x.grouping_method for x in found] == ["component_x_rank"] * 3
    assert [x.estimated_line_style for x in found] == ["solid", "dotted", "dotted"] and len(found[0].points) == 18
    border = spark.createDataFrame([piece(0, 0, 0, 400), piece(1, 0, 200, 400), piece(2, 10, 5, 30)], PIECE)
    plots = spark.createDataFrame([(0, 0.0, 0.0, 500.0, 400.0)], "image_id long, x_min double, y_min double, x_max double, y_max double")
    assert sorted(x.id for x in I.drop_borders(border, plots).collect()) == [1, 2]


@pytest.mark.parametrize("seed", [5, 6])
def test_outliers_equal_plain_loops(spark, seed):
    r = random.Random(seed)
    rows = [(g, i, r.choice([r.uniform(0, 60), r.uniform(0, 900)])) for g in range(6) for i in range(r.randrange(1, 12))]
    got = {(x.image_id, x.id) for x in I.trimmed(spark.createDataFrame(rows, "image_id long, id long, center_y double"), ["image_id"]).collect()}
    want = set()
    for g in range(6):
        mine = [(i, y) for h, i, y in rows if h == g]
        mid = float(np.median([y for _, y in mine]))
        near = [(g, i) for i, y in mine if abs(y - mid) <= 130]
        want |= set(near) if len(mine) >= 4 and len(near) >= max(2, len(mine) // 3) else {(g, i) for i, _ in mine}
    assert got == want
