"""File sources and sinks, and mask operators against plain versions on small fixtures."""

import json
import random
import struct
import zlib

import pytest

from plotwright.operators import axes as A
from plotwright.operators import masks as K
from plotwright.sources import files


def places(df):
    return sorted((r.x, r.y) for r in df.collect())


def mask(spark, points, image="m"):
    return spark.createDataFrame([(image, x, y) for x, y in points], "image_id string, x int, y int")


def test_points_keep_rows_in_step(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿0.5, 1e1,more\n\nx,y\n1,oops\nnan,2\n 2 ,-.5\n\"3\",4.\n1_0,3\n".encode())
    rows = files.read_points(spark, str(tmp_path / "a.csv")).orderBy("seq").collect()
    assert [(r.seq, r.x, r.y) for r in rows] == [(0, 0.5, 10.0), (1, 2.0, -0.5), (2, 3.0, 4.0)]


def test_points_of_an_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert files.read_points(spark, str(tmp_path / "a.csv")).count() == 0


def test_truth(spark, tmp_path):
    (tmp_path / "t.csv").write_text("curve_id,x,y,color,linestyle,marker,marker_every,label\nc1,0,1.5,#ff0000,-,,,A\nc2,1,2,#00ff00,--,o,35,B\n")
    row = files.read_truth(spark, str(tmp_path / "t.csv")).where("curve_id = 'c2'").first()
    assert (row.x, row.y, row.marker, row.marker_every) == (1.0, 2.0, "o", 35)


def test_paths_and_their_points(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"curve_id": "c", "pixel_points_ordered": [{"x": 1, "y": 2}, {"x": 3, "y": 4}, {"x": 5, "y": 6}], "completed_ranges": [[1, 1]], "confidence_per_point": [0.5]}, indent=1))
    paths = files.read_paths(spark, str(tmp_path / "p.json"))
    row = paths.first()
    assert (row.component_count, row.confidence, row.warnings, row.label) == (0, 0.0, [], None)
    got = [tuple(r)[2:] for r in files.path_points(paths).orderBy("seq").collect()]
    assert got == [(0, 1.0, 2.0, 0.5, False), (1, 3.0, 4.0, 1.0, True), (2, 5.0, 6.0, 1.0, False)]


def test_series_format(spark, tmp_path):
    rows = [("c", None, 1, 1e-7, 123456789.123456, 2.0, 3.25, 0.35, True), ("c", "A b", 0, 0.5, 1 / 3, 1.0005, 2.0, 1.0, False)]
    df = spark.createDataFrame(rows, "curve_id string, label string, seq int, x double, y double, pixel_x double, pixel_y double, confidence double, completed boolean")
    files.write_series(df.coalesce(1), str(tmp_path / "out"))
    lines = [x for f in (tmp_path / "out").glob("*.csv") for x in f.read_text().splitlines()]
    assert lines[0].split(",") == files.SERIES
    assert lines[1].startswith("c,A b,0,0.5,0.333333333333,1.00") and lines[2] == "c,,1,1e-07,123456789.123,2.000,3.250,0.35,1"


def test_json_keeps_nulls(spark, tmp_path):
    files.write_json(spark.createDataFrame([(1, None)], "a int, b string").coalesce(1), str(tmp_path / "j"))
    assert [json.loads(f.read_text()) for f in (tmp_path / "j").glob("*.json") if f.stat().st_size] == [{"a": 1, "b": None}]


def png(width, height, rgb):
    raw = b"".join(b"\0" + bytes(v for x in range(width) for v in rgb(x, y)) for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_and_pixels(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(3, 2, lambda x, y: (x * 10, y * 100, 200 + x)))
    (tmp_path / "bad.png").write_bytes(b"no image")
    images = files.read_images(spark, str(tmp_path))
    assert {r.image_id.rsplit("/", 1)[1]: r.error for r in images.collect()} == {"a.png": None, "bad.png": "undecodable"}
    got = {(r.x, r.y): (r.r, r.g, r.b) for r in files.pixels(images).collect()}
    assert got == {(x, y): (x * 10, y * 100, 200 + x) for x in range(3) for y in range(2)}


def test_lab_of_known_colours(spark):
    rows = K.with_lab(spark.createDataFrame([(255, 255, 255), (0, 0, 0), (255, 0, 0), (128, 128, 128)], "r int, g int, b int")).collect()
    got = [tuple(round(v) for v in (r.l, r.a, r.b2)) for r in rows]
    assert got == [(255, 128, 128), (0, 128, 128), (136, 208, 195), (137, 128, 128)]


def plain_components(points):
    left, out = set(points), []
    while left:
        stack, found = [left.pop()], set()
        while stack:
            x, y = stack.pop()
            found.add((x, y))
            near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            stack += near
        out.append(sorted(found))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_flooding(spark, seed):
    r = random.Random(seed)
    points = [(r.randrange(-5, 25), r.randrange(30)) for _ in range(330)]
    df = mask(spark, points).unionByName(spark.createDataFrame([("m", None, 1)], "image_id string, x int, y int"))
    got = {}
    for row in K.label_components(df).collect():
        got.setdefault(row.component, []).append((row.x, row.y))
    assert [sorted(got[i]) for i in range(len(got))] == plain_components(points)


def test_no_pixels(spark):
    empty = mask(spark, [(1, 1)]).where("false")
    assert K.label_components(empty).count() == K.skeleton(empty).count() == K.filter_mask(empty, 9, 9).count() == 0


def test_filter_drops_ticks_and_frames_but_keeps_inner_segments(spark):
    tick = [(x, 50) for x in range(3)] + [(80, y) for y in range(97, 100)]
    frame = [(x, 0) for x in range(150)]
    grid = [(x, 70) for x in range(20, 90)]
    inner = [(x, y) for x in range(40, 60) for y in range(30, 33)]
    small = [(100, 20), (101, 20)]
    got = places(K.filter_mask(mask(spark, tick + frame + grid + inner + small), 160, 100))
    assert got == sorted(inner)


def test_dark_neighbours_and_exclusions(spark):
    shades = spark.createDataFrame([("m", x, 0, 10.0 if x == 2 else 200.0) for x in range(8)], "image_id string, x int, y int, l double")
    left = K.suppress_dark(shades.where("l > 100"), shades)
    assert places(left) == [(x, 0) for x in (0, 4, 5, 6, 7)]
    assert places(K.exclude(left, [(4.9, 0, 6, 1)])) == [(0, 0), (6, 0), (7, 0)]


def test_skeleton_is_thin_and_in_one_piece(spark):
    bar = [(x, y) for x in range(30) for y in range(5)] + [(x, y) for x in range(13, 18) for y in range(5, 25)]
    thin = places(K.skeleton(mask(spark, bar)))
    assert set(thin) <= set(bar) and len(plain_components(thin)) == 1 and len(thin) < 60
    assert not any({(x + 1, y), (x, y + 1), (x + 1, y + 1)} <= set(thin) for x, y in thin)
    kinds = {r.kind for r in K.skeleton_nodes(mask(spark, thin)).collect()}
    assert {"endpoint", "path", "junction"} <= kinds


def test_single_pixels_stay(spark):
    assert places(K.skeleton(mask(spark, [(3, 4), (9, 9)]))) == [(3, 4), (9, 9)]
    assert {r.kind for r in K.skeleton_nodes(mask(spark, [(3, 4), (9, 9)])).collect()} == {"alone"}


def test_axes_and_their_absence(spark):
    images = spark.createDataFrame([("a", 100, 80), ("none", 100, 80), ("flat", 100, 80)], "image_id string, width int, height int")
    points = [("a", x, 70) for x in range(10, 91) if x != 40] + [("a", x, 69) for x in range(10, 60)] + [("a", 10, y) for y in range(5, 71)] + [("a", x, 75) for x in range(30)]
    points += [("flat", x, 40) for x in range(90)] + [("none", 3, 3)]
    pixels = spark.createDataFrame([(*p, 0, 0, 0) for p in points] + [("none", x, 9, 250, 250, 250) for x in range(99)] + [("none", x, 12, None, 0, 0) for x in range(99)], "image_id string, x int, y int, r int, g int, b int")
    got = {r.image_id: r for r in A.detect_axes(images, pixels).collect()}
    a = got["a"]
    assert a.success and (a.x_min, a.y_min, a.x_max, a.y_max) == (10, 5, 90, 70) and a.error is None
    assert abs(a.confidence - (0.75 * (80 / 100 + 65 / 80) / 2 + 0.25 * 80 * 65 / 8000)) < 1e-9
    assert not got["none"].success and not got["flat"].success and got["flat"].x_max is None and got["flat"].h_score > 0


def test_spurs_go_and_crossings_stay(spark):
    line = [(x, 10) for x in range(11)]
    assert places(K.prune_spurs(mask(spark, line + [(5, 7), (5, 8), (5, 9)]))) == sorted(line)
    cross = line + [(5, y) for y in range(5, 16) if y != 10]
    assert places(K.prune_spurs(mask(spark, cross))) == sorted(cross)
    assert places(K.prune_spurs(mask(spark, line + [(5, 7), (5, 8), (5, 9)]), longest=2)) == sorted(line + [(5, 7), (5, 8), (5, 9)])


def test_paths_in_order(spark):
    bend = [(x, 0) for x in range(6)] + [(5 + i, i) for i in range(1, 5)]
    ring = [(20, 0), (21, 0), (22, 0), (22, 1), (22, 2), (21, 2), (20, 2), (20, 1)]
    rows = K.trace_paths(mask(spark, bend[::-1] + bend + ring + [(40, 40)])).orderBy("component", "seq").collect()
    got = {c: [(r.x, r.y) for r in rows if r.component == c] for c in (0, 1, 2)}
    assert got[0] == bend and got[2] == [(40, 40)]
    assert got[1][0] == (20, 0) and got[1][-1] == (22, 2) and len(got[1]) == 5
    assert K.trace_paths(mask(spark, bend).where("false")).count() == 0
