"""Ends, short lines, axes by lines, texts and their boxes against plain loops and known cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwright.operators import axes as A
from plotwright.operators import completion as C
from plotwright.operators import readers as R


@pytest.mark.parametrize("n", [1, 2, 5, 7])
def test_assignments_equal_all_permutations(n):
    rng = np.random.default_rng(n)
    for _ in range(15):
        cost = rng.choice([rng.random((n, n)) * 100, rng.integers(0, 4, (n, n)).astype(float)])
        got = C.assignment(cost)
        assert sorted(got) == list(range(n))
        assert cost[np.arange(n), got].sum() == pytest.approx(min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_ends_in_line_are_connected(spark):
    ends = [(0, 0, 0, 0.0, 10.0), (0, 1, 0, 40.0, 10.0), (0, 2, 1, 50.0, 11.0), (0, 3, 1, 90.0, 11.0), (0, 4, 2, 97.0, 10.0), (0, 5, 2, 140.0, 10.0), (0, 6, 3, 400.0, 10.0), (0, 7, 3, 500.0, 10.0), (1, 0, 0, 1.0, 1.0)]
    got = C.connect_ends(spark.createDataFrame(ends, "image_id long, id long, piece long, x double, y double")).collect()
    assert {(x.image_id, x.a, x.b) for x in got} == {(0, 1, 2), (0, 3, 4)} and got[0].distance <= 50


def test_short_lines_become_long_ones_and_axes(spark):
    lines = [(0, i, 40.0 + 60 * i, 300.0, 90.0 + 60 * i, 300.0) for i in range(7)] + [(0, 10 + i, 40.0, 20.0 + 70 * i, 40.0, 80.0 + 70 * i) for i in range(4)]
    lines += [(0, 20, 100.0, 120.0, 110.0, 120.0), (0, 21, 100.0, 100.0, 150.0, 150.0), (1, 0, 0.0, 0.0, 10.0, 0.0)]
    joined = C.connect_lines(spark.createDataFrame(lines, "image_id long, id long, x0 double, y0 double, x1 double, y1 double"))
    got = {(x.way, x.x0, x.y0, x.x1, x.y1, x.lines) for x in joined.collect()}
    assert got == {("h", 40.0, 300.0, 450.0, 300.0, 7), ("v", 40.0, 20.0, 40.0, 290.0, 4)}
    images = spark.createDataFrame([(0, 500, 320), (1, 500, 320)], "image_id long, width int, height int")
    row = C.axis_pairs(joined, images).collect()
    assert len(row) == 1 and (row[0].x, row[0].y, row[0].valid) == (40.0, 300.0, True)
    far = C.axis_pairs(joined.withColumns({"y0": F.when(F.col("way") == "h", 20.0).otherwise(F.col("y0")), "y1": F.when(F.col("way") == "h", 20.0).otherwise(F.col("y1"))}), images).first()
    assert not far.valid


def test_regions_around_a_plot(spark):
    plots = spark.createDataFrame([(0, 500, 300, 50.0, 20.0, 450.0, 250.0)], "image_id long, width int, height int, x_min double, y_min double, x_max double, y_max double")
    found = {x.region: x for x in C.region_bounds(C.regions(plots)).collect()}
    assert (found[0].x0, found[0].y0, found[0].x1, found[0].y1) == (50, 20, 451, 251)
    assert (found[1].x0, found[1].x1) == (0, 51) and (found[2].y0, found[2].y1) == (250, 300) and found[3].x0 == 450 and found[4].y1 == 21
    texts = spark.createDataFrame([(0, 10.0, 10.0), (0, 100.0, 100.0), (0, 470.0, 270.0)], "image_id long, cx double, cy double")
    assert sorted(x.region for x in R.regions_of(texts, plots).collect()) == [0, 4, 8]


def test_segments_of_a_skeleton(spark):
    rows = [(0, x, 0) for x in range(6)] + [(0, x, 9) for x in range(3)]
    assert C.segments(spark.createDataFrame(rows, "image_id long, x long, y long")).count() == 6


def tilted(degrees):
    slope = math.tan(math.radians(degrees))
    rows = {(x, round(250 + slope * (x - 40))) for x in range(40, 440)} | {(round(40 - slope * (y - 250)), y) for y in range(20, 251)}
    return [(0, x, y, 0, 0, 0) for x, y in rows if 0 <= x < 480 and 0 <= y < 300]


def test_tilted_axes_are_found_where_asked_for(spark):
    images = spark.createDataFrame([(0, 480, 300)], "image_id long, width int, height int")
    pixels = spark.createDataFrame(tilted(3), "image_id long, x long, y long, r int, g int, b int")
    assert not A.detect_axes(images, pixels).first().success
    found = A.detect_axes(images, pixels, tilt=4).first()
    assert found.success and abs(found.x_max - 439) <= 3 and abs(found.x_min - 46) <= 12 and abs(found.y_max - 260) <= 12


def test_levels_and_closing(spark):
    r = random.Random(2)
    counts = [(0, g, r.randrange(1, 50)) for g in range(20, 60)] + [(0, g, r.randrange(1, 50)) for g in range(150, 250)]
    got = A.otsu(spark.createDataFrame(counts, "image_id long, gray int, n long")).first().threshold
    total = sum(n for _, _, n in counts)

    def between(t):
        low = [(g, n) for _, g, n in counts if g <= t]
        high = [(g, n) for _, g, n in counts if g > t]
        a, b = sum(n for _, n in low), sum(n for _, n in high)
        return a * b * (sum(g * n for g, n in low) / a - sum(g * n for g, n in high) / b) ** 2 / total**2 if a and b else 0.0

    assert got == max(range(20, 250), key=lambda t: (round(between(t), 6), -t))
    images = spark.createDataFrame([(0, 480, 300)], "image_id long, width int, height int")
    pale = spark.createDataFrame([(0, x, 250, 140, 140, 200) for x in range(40, 440) if x % 9] + [(0, 40, y, 140, 140, 200) for y in range(20, 251)], "image_id long, x long, y long, r int, g int, b int")
    assert not A.detect_axes(images, pale).first().success
    found = A.detect_axes(images, pale, by_channel=True, close=True).first()
    assert found.success and (found.x_min, found.y_max, found.x_max) == (40, 250, 439)


TEXT = "image_id long, id long, text string, confidence double, polygon array<array<double>>"


def polygon(x, y, w, h):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


def test_boxes_numbers_and_filters(spark):
    rows = [(0, 0, " 1.0 2.0 -3 ", 0.9, polygon(10.0, 5.0, 90.0, 10.0)), (0, 1, "a b", 0.9, polygon(0.0, 0.0, 5.0, 5.0)), (0, 2, "--", 0.9, polygon(0.0, 0.0, 10.0, 9.0)), (0, 3, "up", 0.9, [[0.0, 50.0], [0.0, 0.0], [10.0, 0.0], [10.0, 50.0]])]
    texts = R.boxed(spark.createDataFrame(rows, TEXT))
    cut = R.split_numbers(texts).where("id = 0").orderBy("part").collect()
    assert [(x.text, x.x_min, x.x_max, x.cx, x.cy) for x in cut] == [("1.0", 10.0, 40.0, 25.0, 10.0), ("2.0", 40.0, 70.0, 55.0, 10.0), ("-3", 70.0, 100.0, 85.0, 10.0)]
    assert R.split_numbers(texts).where("id = 1").first().text == "a b"
    assert sorted(x.id for x in R.filter_texts(texts).collect()) == [0, 1]
    assert texts.where("id = 3").first().angle == -90.0


def test_texts_by_a_given_recognizer(spark):
    image = np.full((20, 30, 3), 255, np.uint8)
    image[5:10, 8:20] = (10, 20, 200)
    assert R.prepared(image).shape == (200, 220, 3) and R.prepared(image)[100, 100].tolist() == R.prepared(image, 0)[20, 20].tolist()

    def recognize(img):
        ys, xs = np.nonzero(img[..., 0] < 128)
        box = [[xs.min(), ys.min()], [xs.max() + 1, ys.min()], [xs.max() + 1, ys.max() + 1], [xs.min(), ys.max() + 1]]
        return [(box, "bar", 0.9), (box, "faint", 0.1), ([[-100, -100], [0, 0], [0, 0], [0, 0]], "out", 0.9)]

    images = spark.createDataFrame([("a", 30, 20, 3, bytearray(image.tobytes())), ("b", 0, 0, 0, None)], "image_id string, width int, height int, channels int, data binary")
    found = R.read_texts(images, recognize).collect()
    assert [(x.image_id, x.text) for x in found] == [("a", "bar")]
    assert (found[0].x_min, found[0].y_min, found[0].x_max, found[0].y_max) == pytest.approx((8.0, 5.0, 20.0, 10.0), abs=0.6)
