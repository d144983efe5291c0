"""Files of curves, paths and images as tables, and tables as such files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns of an exported series and of a truth table.
SERIES = ["curve_id", "label", "point_index", "x", "y", "pixel_x", "pixel_y", "confidence", "completed"]
TRUTH = "curve_id string, x double, y double, color string, linestyle string, marker string, marker_every int, label string"
_POINT = "struct<x: double, y: double>"
PATH = (
    f"curve_id string, label string, pixel_points_ordered array<{_POINT}>, completed_ranges array<array<int>>, "
    f"confidence_per_point array<double>, endpoints array<{_POINT}>, junctions array<{_POINT}>, component_count int, "
    "observed_pixel_count int, completed_pixel_count int, path_length_px double, confidence double, warnings array<string>"
)
_NUMBER = r"^[ \t]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*$"


def number(text: Column) -> Column:
    """A finite decimal number, null for any other text (``1.0d``, ``nan`` and ``1_000`` included)."""
    value = F.when(text.rlike(_NUMBER), F.trim(F.translate(text, "\t", " "))).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """``(curve_id, seq, x, y)`` of CSV files without a fixed header; curve_id is the file, seq the place among its kept rows.

    The first two fields count. A row where either isn't a number goes as a whole, headers too, so x and y stay
    in step. A byte order mark is ignored.
    """
    rows = spark.read.schema("a string, b string").csv(path)
    rows = rows.select(
        F.col("_metadata.file_path").alias("curve_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        number(F.regexp_replace("a", "^\ufeff", "")).alias("x"),
        number(F.col("b")).alias("y"),
    ).where("x is not null and y is not null")
    seq = F.row_number().over(Window.partitionBy("curve_id").orderBy("block", "at")) - 1
    return rows.select("curve_id", seq.alias("seq"), "x", "y")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth tables with their header; filter on ``curve_id`` for one curve."""
    return spark.read.schema(TRUTH).option("header", True).csv(path)


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """Traced paths, one JSON document a file; missing lists are empty and missing numbers 0."""
    rows = spark.read.schema(PATH).option("multiLine", True).json(path)
    defaults = {"array": F.array(), "int": F.lit(0), "double": F.lit(0.0)}
    fill = {c: next((d for k, d in defaults.items() if t.startswith(k)), None) for c, t in rows.dtypes}
    return rows.select(*(F.coalesce(c, d.cast(t)).alias(c) if (d := fill[c]) is not None else F.col(c) for c, t in rows.dtypes))


def path_points(paths: DataFrame) -> DataFrame:
    """``(curve_id, label, seq, x, y, confidence, completed)``: confidence is 1 where a path gives none, completed where seq lies in a range, ends included."""
    rows = paths.select("curve_id", "label", "completed_ranges", "confidence_per_point", F.posexplode("pixel_points_ordered").alias("seq", "p"))
    inside = F.exists("completed_ranges", lambda r: F.col("seq").between(F.get(r, 0), F.get(r, 1)))
    confidence = F.coalesce(F.get("confidence_per_point", F.col("seq")), F.lit(1.0))
    return rows.select("curve_id", "label", "seq", "p.x", "p.y", confidence.alias("confidence"), F.coalesce(inside, F.lit(False)).alias("completed"))


def general(value: Column, digits: int) -> Column:
    """Text of a number in C's %g, which Java's formatter doesn't give; null for null."""

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else f"{v:.{digits}g}")

    return text(value)


def write_series(points: DataFrame, path: str) -> None:
    """Writes ``points(curve_id, label, seq, x, y, pixel_x, pixel_y, confidence, completed)`` as CSV with header: one file a task, rows of a curve together in order; a null label is empty."""
    rows = points.repartitionByRange("curve_id").sortWithinPartitions("curve_id", "seq").select(
        "curve_id",
        F.coalesce("label", F.lit("")).alias("label"),
        F.col("seq").alias("point_index"),
        general(F.col("x"), 12).alias("x"),
        general(F.col("y"), 12).alias("y"),
        F.format_string("%.3f", F.col("pixel_x").cast("double")).alias("pixel_x"),
        F.format_string("%.3f", F.col("pixel_y").cast("double")).alias("pixel_y"),
        general(F.col("confidence"), 6).alias("confidence"),
        F.col("completed").cast("int").alias("completed"),
    )
    rows.select(*SERIES).write.option("header", True).option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Writes one JSON document a row, nulls included."""
    rows.write.option("ignoreNullFields", False).json(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``(image_id, width, height, channels, data, error)``: BGR bytes row by row; undecodable files stay, with ``error`` set and null data."""
    rows = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    bad = F.col("height") <= 0
    return rows.select(F.col("origin").alias("image_id"), "width", "height", F.col("nChannels").alias("channels"), F.when(~bad, F.col("data")).alias("data"), F.when(bad, F.lit("undecodable")).alias("error"))


def pixels(images: DataFrame) -> DataFrame:
    """``(image_id, x, y, r, g, b)`` of decoded images; a gray image has equal channels, and alpha is ignored. An image expands in its own task, a row of pixels at a time."""
    rows = images.where("data is not null").select("image_id", "width", "channels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    line = F.substring("data", F.col("y") * F.col("width") * F.col("channels") + 1, F.col("width") * F.col("channels"))
    rows = rows.select("image_id", "channels", "y", F.hex(line).alias("line"), F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))

    def channel(i: int) -> Column:
        at = F.col("x") * F.col("channels") + F.least(F.lit(i), F.when(F.col("channels") < 3, 0).otherwise(i))
        return F.conv(F.substring("line", at * 2 + 1, F.lit(2)), 16, 10).cast("int")

    return rows.select("image_id", "x", "y", channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"))


def png(rgb: np.ndarray) -> bytes:
    """An image ``(height, width, 3)`` of 8-bit colours as the bytes of a PNG file."""
    h, w, _ = rgb.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, w * 3)], axis=1)
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def pictures(pixels: DataFrame, images: DataFrame, background: int = 255) -> DataFrame:
    """``(image_id, png binary)`` of ``images(image_id, width, height)`` from ``pixels(image_id, x, y, r, g, b)``; places without a pixel have the background, pixels outside are left out, and an image without any is blank."""
    kind = images.schema["image_id"].dataType.simpleString()
    rows = images.select("image_id", "width", "height").join(pixels.select("image_id", "x", "y", "r", "g", "b"), "image_id", "left")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        w, h = int(group["width"].iloc[0]), int(group["height"].iloc[0])
        out = np.full((h, w, 3), background, np.uint8)
        given = group.dropna()
        given = given[(given["x"] >= 0) & (given["y"] >= 0) & (given["x"] < w) & (given["y"] < h)]
        out[given["y"].astype(int), given["x"].astype(int)] = given[["r", "g", "b"]].to_numpy().astype(np.uint8)
        return pd.DataFrame({"image_id": [group["image_id"].iloc[0]], "png": [png(out)]})

    return rows.groupBy("image_id").applyInPandas(run, f"image_id {kind}, png binary")


def write_pictures(pictures: DataFrame, folder: str) -> None:
    """Writes each picture as ``<image_id>.png`` into a folder that all tasks reach, through Hadoop's file system where it isn't a local path.

    Names are made safe: what isn't a letter, digit, dot, dash or underscore becomes an underscore.
    """
    spark = pictures.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    # a picture at a time: the driver never holds more than one task's
    for row in pictures.toLocalIterator():
        name = "".join(ch if ch.isalnum() or ch in ".-_" else "_" for ch in str(row.image_id))
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.png")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(row.png))
        out.close()


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """Writes one small text file, such as a report."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()
