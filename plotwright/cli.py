"""Command lines: ``python -m plotwright.cli COMMAND --help``.

Each runs over all files that its input pattern matches, in one Spark session (``spark-submit``'s, or a local one).
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import axes as A
from .operators import colors as H
from .operators import curves as C
from .operators import extraction as E
from .operators import overlays as O
from .operators import quality as Q
from .operators import suite as U
from .operators import synthetic as Y
from .sources import files


def _session() -> SparkSession:
    return SparkSession.builder.appName("plotwright").getOrCreate()


def _range(parser: argparse.ArgumentParser, required: bool) -> None:
    for name in ("x_min", "x_max", "y_min", "y_max"):
        parser.add_argument(f"--{name}", type=float, required=required)
    for name in ("x_scale", "y_scale"):
        parser.add_argument(f"--{name}", choices=S.SCALES, default="linear")


def _decoded(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    images = files.read_images(spark, pattern)
    return images.where("error is null").select("image_id", "width", "height"), files.pixels(images)


def map_paths(spark: SparkSession, args: argparse.Namespace) -> None:
    """Path documents to series in data coordinates."""
    points = files.path_points(files.read_paths(spark, args.paths))
    x, y = S.pixel_to_data(F.col("x"), F.col("y"), tuple(args.plot), (args.x_min, args.x_max, args.y_min, args.y_max), args.x_scale, args.y_scale)
    rows = points.select("curve_id", "label", "seq", x.alias("x"), y.alias("y"), F.col("x").alias("pixel_x"), F.col("y").alias("pixel_y"), "confidence", "completed")
    if args.csv:
        files.write_series(rows, args.csv)
    if args.json:
        files.write_json(rows, args.json)
    if not args.csv and not args.json:
        rows.orderBy("curve_id", "seq").show(args.rows, truncate=False)


def correct(spark: SparkSession, args: argparse.Namespace) -> None:
    """CSV points through the correction chain."""
    out = C.correct(files.read_points(spark, args.points), (args.x_min, args.x_max), (args.y_min, args.y_max), args.x_scale, args.y_scale, args.dirty, args.clean, args.threshold, args.fit)
    out.write.option("header", True).csv(args.out)


def mask(spark: SparkSession, args: argparse.Namespace) -> None:
    """Masks of one colour in all images, as pictures and one JSON row each."""
    images, pixels = _decoded(spark, args.images)
    proto = json.loads(args.prototype)
    lab = proto["lab"]
    protos = images.select("image_id", F.lit(proto.get("curve_id", "curve")).alias("curve_id"), *[F.lit(float(v)).alias(n) for n, v in zip(("l", "a", "b2"), lab)], F.lit(proto.get("source", "direct")).alias("source"), F.lit(int(proto.get("area", 0))).alias("area"))
    plots = images.select("*", *[F.lit(None).cast("double").alias(n) for n in Q.BOX])
    found = E.kept(H.prototype_masks(pixels, plots, protos), "masks")
    white = found.select("image_id", "x", "y", *[F.lit(255).alias(n) for n in "rgb"])
    files.write_pictures(files.pictures(white, images, 0), args.out)
    files.write_json(H.mask_rows(found, protos), f"{args.out}/rows")


def trace(spark: SparkSession, args: argparse.Namespace) -> None:
    """Paths through white masks, as JSON rows."""
    _, pixels = _decoded(spark, args.masks)
    gray = F.bround(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))
    white = pixels.where(gray > args.threshold).select("image_id", F.lit(args.curve).alias("curve_id"), "x", "y")
    found = E.trace(white, args.drop_marker_like)
    points = found["points"].groupBy("image_id", "curve_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "completed", "confidence"))).alias("points"))
    files.write_json(found["paths"].drop("points").join(points, ["image_id", "curve_id"]), args.out)


def axes(spark: SparkSession, args: argparse.Namespace) -> None:
    """Axes of all images, as JSON rows."""
    images, pixels = _decoded(spark, args.images)
    files.write_json(A.detect_axes(images, pixels, by_channel=args.by_channel, close=args.close, tilt=args.tilt), args.out)


def extract(spark: SparkSession, args: argparse.Namespace) -> None:
    """Everything of all images: a report, series where data ranges are given, and layers drawn over them on demand."""
    images, pixels = _decoded(spark, args.images)
    pixels = E.kept(pixels, "pixels")
    ranged = None not in (args.x_min, args.x_max, args.y_min, args.y_max)
    texts = spark.read.parquet(args.texts) if args.texts else None
    found = E.extract(images, pixels, texts, (args.x_min, args.x_max) if ranged else None, (args.y_min, args.y_max) if ranged else None, (args.x_scale, args.y_scale), drop_marker_like=args.drop_marker_like)
    files.write_json(found.report, f"{args.out}/report")
    for name in ("legends", "items", "curves", "paths", "pieces", "markers", "bindings", "bound_paths", "curve_rows"):
        files.write_json(found.tables[name], f"{args.out}/{name}")
    if ranged:
        label = F.lit(None).cast("string").alias("label")
        series = lambda rows, key: rows.select(F.concat_ws("/", "image_id", key).alias("curve_id"), label, "seq", "x", "y", "pixel_x", "pixel_y", "confidence", "completed")
        files.write_series(series(found.data, "curve_id"), f"{args.out}/data")
        files.write_series(series(found.bound_data, "prototype_id"), f"{args.out}/bound_data")
    if args.debug:
        for name, layer in O.debug_layers(found).items():
            files.write_pictures(files.pictures(O.flattened(pixels, layer), images), f"{args.out}/debug/{name}")


def chart(spark: SparkSession, args: argparse.Namespace) -> None:
    """Draws a chart with its truth: picture, masks, points, curves and axes."""
    given = {f.name: getattr(args, f.name) for f in fields(Y.Chart) if getattr(args, f.name, None) is not None}
    write_chart(spark, Y.Chart(**given), args.out)


def write_chart(spark: SparkSession, chart: Y.Chart, folder: str) -> None:
    """Writes a chart's picture, masks and truth into a folder of its name."""
    folder = f"{folder.rstrip('/')}/{chart.name}"
    images, curves, points = Y.truth(spark, [chart])
    points = E.kept(points, "truth")
    files.write_pictures(files.pictures(Y.image_pixels(points, curves, images), images).withColumn("image_id", F.lit("image")), folder)
    white = Y.lines(points, curves, images, mask=True).select(F.col("curve_id").alias("image_id"), "x", "y", *[F.lit(255).alias(n) for n in "rgb"])
    sized = curves.select("image_id", "curve_id").join(images.select("image_id", "width", "height"), "image_id").select(F.col("curve_id").alias("image_id"), "width", "height")
    files.write_pictures(files.pictures(white, sized, 0), f"{folder}/masks")
    truth = points.join(curves.select("curve_id", "color", "linestyle", "marker", "marker_every", "label"), "curve_id")
    numbers = [files.general(F.col(n), 10).alias(n) for n in "xy"]
    rows = truth.repartitionByRange("curve_id").sortWithinPartitions("curve_id", "point_index")
    rows.select("curve_id", *numbers, "color", "linestyle", F.coalesce("marker", F.lit("")).alias("marker"), "marker_every", "label").write.option("header", True).option("emptyValue", "").csv(f"{folder}/truth_data")
    x0, y0, x1, y1 = chart.normalized().plot
    point = lambda x, y: {"x": x, "y": y}
    shape = {
        "image_size": {"width": chart.width, "height": chart.height}, "plot_area": {"x_min": x0, "y_min": y0, "x_max": x1, "y_max": y1}, "origin": point(x0, y1),
        "x_axis": {"start": point(x0, y1), "end": point(x1, y1)}, "y_axis": {"start": point(x0, y1), "end": point(x0, y0)},
        "data_range": {"x_min": chart.x_range[0], "x_max": chart.x_range[1], "y_min": chart.y_range[0], "y_max": chart.y_range[1], "x_scale": "linear", "y_scale": "linear"},
    }
    files.write_text(spark, json.dumps(shape, indent=2), f"{folder}/truth_axes.json")
    listed = [r.asDict() | {"mask_path": f"masks/{r.curve_id}.png"} for r in curves.orderBy("number").select("curve_id", "color", "linestyle", "marker", "marker_every", "marker_size", "label").collect()]
    files.write_text(spark, json.dumps({"curves": listed}, indent=2), f"{folder}/truth_curves.json")
    files.write_text(spark, json.dumps({"name": chart.name, "title": chart.title, "curve_count": len(listed), "image_size": [chart.width, chart.height]}, indent=2), f"{folder}/manifest.json")


def suite(spark: SparkSession, args: argparse.Namespace) -> None:
    """The suite's summaries as JSON rows, one table a kind."""
    for name, table in U.run(spark).items():
        files.write_json(table, f"{args.out}/{name}")
    if args.bindings:
        charts = [Y.Chart("line_marker_curves", seed=25, curves=4, line_markers=True, legend_inside=True)]
        for name, table in U.bindings(spark, charts).items():
            files.write_json(table, f"{args.out}/bindings/{name}")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="plotwright", description="Curves from charts")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, run, *inputs: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=run.__doc__)
        p.set_defaults(run=run)
        for i in inputs:
            p.add_argument(i)
        return p

    p = command("map", map_paths, "paths")
    p.add_argument("--plot", type=float, nargs=4, required=True, metavar=("X_MIN", "Y_MIN", "X_MAX", "Y_MAX"))
    _range(p, True)
    p.add_argument("--csv")
    p.add_argument("--json")
    p.add_argument("--rows", type=int, default=20)
    p = command("correct", correct, "points", "out")
    _range(p, True)
    p.add_argument("--dirty", choices=("renorm", "clip", "extrapolate"), default="renorm")
    p.add_argument("--clean", choices=("none", "mad", "savgol"), default="mad")
    p.add_argument("--threshold", type=float, default=3.0)
    p.add_argument("--fit", choices=("none", "interp", "pchip", "bspline", "gpr"), default="interp")
    p = command("mask", mask, "images", "out")
    p.add_argument("--prototype", required=True, help='such as {"curve_id": "c", "lab": [110, 190, 170], "area": 900}')
    p = command("trace", trace, "masks", "out")
    p.add_argument("--curve", default="curve")
    p.add_argument("--threshold", type=int, default=127)
    p.add_argument("--drop-marker-like", action="store_true")
    p = command("axes", axes, "images", "out")
    p.add_argument("--by-channel", action="store_true")
    p.add_argument("--close", action="store_true")
    p.add_argument("--tilt", type=int, default=0)
    p = command("extract", extract, "images", "out")
    _range(p, False)
    p.add_argument("--texts")
    p.add_argument("--drop-marker-like", action="store_true")
    p.add_argument("--debug", action="store_true")
    p = command("chart", chart, "out")
    for name, kind in (("name", str), ("seed", int), ("curves", int), ("points", int), ("width", int), ("height", int), ("palette", str)):
        p.add_argument(f"--{name}", type=kind)
    for name in ("legend_inside", "occlusion", "crossing", "markers_only", "line_markers", "one_color", "gray_markers", "gray_lines", "dense_legend"):
        p.add_argument(f"--{name.replace('_', '-')}", action="store_true")
    p = command("suite", suite, "out")
    p.add_argument("--bindings", action="store_true")
    return out


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(_session(), args)


if __name__ == "__main__":
    main()
