"""Command lines end to end, and layers drawn over images."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwright import cli
from plotwright.operators import overlays as O
from plotwright.sources import files


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("cli")
    cli.main(["chart", str(out), "--name", "small", "--curves", "2", "--points", "300", "--width", "400", "--height", "250"])
    return out


def test_a_chart_is_written_with_its_truth(spark, folder):
    truth = json.loads((folder / "small/truth_axes.json").read_text())
    assert truth["plot_area"]["x_min"] == 48.0 and len(json.loads((folder / "small/truth_curves.json").read_text())["curves"]) == 2
    assert files.read_truth(spark, str(folder / "small/truth_data")).count() == 600
    image = files.read_images(spark, str(folder / "small/image.png")).first()
    assert (image.width, image.height, image.error) == (400, 250, None)
    assert sorted(p.name for p in (folder / "small/masks").glob("*.png")) == ["curve_00.png", "curve_01.png"]


def test_masks_are_traced_and_axes_found(spark, folder):
    cli.main(["trace", str(folder / "small/masks/curve_00.png"), str(folder / "paths"), "--curve", "curve_00"])
    row = spark.read.json(str(folder / "paths")).first()
    assert row.curve_id == "curve_00" and len(row.points) > 230 and row.confidence > 0.9
    cli.main(["axes", str(folder / "small/image.png"), str(folder / "axes")])
    found = spark.read.json(str(folder / "axes")).first()
    assert found.success and abs(found.x_min - 48) <= 1 and abs(found.y_max - 215) <= 1


def test_paths_and_points_become_data(spark, folder):
    (folder / "path.json").write_text(json.dumps({"curve_id": "c", "pixel_points_ordered": [{"x": 10, "y": 220}, {"x": 110, "y": 20}], "completed_ranges": [[1, 1]]}))
    cli.main(["map", str(folder / "path.json"), "--plot", "10", "20", "110", "220", "--x_min", "0", "--x_max", "10", "--y_min", "-1", "--y_max", "1", "--csv", str(folder / "series")])
    rows = spark.read.option("header", True).csv(str(folder / "series")).orderBy("point_index").collect()
    assert [(r.x, r.y, r.completed) for r in rows] == [("0", "-1", "0"), ("10", "1", "1")]
    (folder / "points.csv").write_text("x,y\n" + "\n".join(f"{i},{i * i}" for i in range(20)))
    cli.main(["correct", str(folder / "points.csv"), str(folder / "corrected"), "--x_min", "0", "--x_max", "1", "--y_min", "0", "--y_max", "1", "--clean", "none"])
    assert spark.read.option("header", True).csv(str(folder / "corrected")).count() == 500


def test_layers(spark):
    box = spark.createDataFrame([(0, 2.0, 3.0, 6.0, 5.0)], "image_id long, x_min double, y_min double, x_max double, y_max double").withColumn("color", O.color((1, 2, 3)))
    got = {(p.x, p.y) for p in O.boxes(box).collect()}
    assert got == {(x, y) for x in range(2, 7) for y in range(3, 6) if x in (2, 6) or y in (3, 5)}
    points = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0), (0, 1, 3.0, 0.0, 1.0), (0, 2, 6.0, 0.0, 0.3), (0, 3, 60.0, 0.0, 1.0)], "image_id long, seq long, x double, y double, confidence double").withColumn("color", O.color((9, 9, 9)))
    drawn = {p.x: p.r for p in O.paths(points, ["image_id"], faint=True).orderBy(F.col("r")).collect()}
    assert set(drawn) == set(range(7)) and drawn[1] == 9 and drawn[5] == 255
    assert O.crosses(spark.createDataFrame([(0, 10.0, 10.0)], "image_id long, x double, y double")).count() == 17
    swatch = O.swatches(spark.createDataFrame([(0, "c", 200, 0, 0)], "image_id long, curve_id string, r int, g int, b int"))
    assert swatch.count() == 29 * 11 and swatch.where("r = 200").count() == 27 * 9
    pixels = spark.createDataFrame([(0, 2, 3, 7, 7, 7), (0, 0, 0, 5, 5, 5)], "image_id long, x int, y int, r int, g int, b int")
    flat = {(p.x, p.y): p.r for p in O.flattened(pixels, O.boxes(box)).collect()}
    assert flat[2, 3] == 1 and flat[0, 0] == 5
    kinds = spark.createDataFrame([("line_like",), ("marker_like",), ("noise",)], "k string").select(O.class_color(F.col("k")).alias("c")).collect()
    assert [tuple(x.c) for x in kinds] == [(0, 180, 0), (0, 128, 255), (255, 0, 0)]
    assert tuple(spark.range(1).select(O.instance_color(F.lit(9)).alias("c")).first().c) == (0, 180, 0)


def test_pictures_go_there_and_back(spark, tmp_path):
    rgb = np.random.default_rng(1).integers(0, 256, (7, 11, 3))
    (tmp_path / "a.png").write_bytes(files.png(rgb))
    back = files.pixels(files.read_images(spark, str(tmp_path / "a.png"))).collect()
    assert all((p.r, p.g, p.b) == tuple(rgb[p.y, p.x]) for p in back) and len(back) == 77
    images = spark.createDataFrame([("x/y", 5, 4), ("blank", 2, 2)], "image_id string, width int, height int")
    pixels = spark.createDataFrame([("x/y", 1, 2, 10, 20, 30), ("x/y", 9, 9, 1, 1, 1)], "image_id string, x int, y int, r int, g int, b int")
    files.write_pictures(files.pictures(pixels, images), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("*.png")) == ["blank.png", "x_y.png"]
    assert files.pixels(files.read_images(spark, str(tmp_path / "out/x_y.png"))).where("r = 10 and g = 20 and b = 30 and x = 1 and y = 2").count() == 1
