"""Points that keep arriving as CSV files: read, mapped to data and summed up as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.files import number


def read_points(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    """``(curve_id, x, y, at)`` of the CSV files that come into a folder: the file is the curve, its time of change the time.

    As for whole files, a row counts if its first two fields are numbers. Rows of a stream have no place in their file.
    """
    rows = spark.readStream.schema("a string, b string").option("maxFilesPerTrigger", files_a_trigger).csv(folder)
    rows = rows.select(F.col("_metadata.file_path").alias("curve_id"), number(F.regexp_replace("a", "^\ufeff", "")).alias("x"), number(F.col("b")).alias("y"), F.col("_metadata.file_modification_time").alias("at"))
    return rows.where("x is not null and y is not null")


def to_data(points: DataFrame, box: tuple, rng: tuple, x_scale: str = "linear", y_scale: str = "linear") -> DataFrame:
    """Pixels to data coordinates, row by row (see ``scalar.pixel_to_data``); pixels outside the box are marked."""
    x, y = S.pixel_to_data(F.col("x"), F.col("y"), box, rng, x_scale, y_scale)
    outside = ~S.contains(tuple(map(F.lit, box)), F.col("x"), F.col("y"))
    return points.withColumns({"pixel_x": F.col("x"), "pixel_y": F.col("y"), "x": x, "y": y, "outside": outside})


def summaries(points: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Points, extent and mean of each curve by windows of time. State is dropped once a window is older than ``late``; points that come later than that don't count."""
    rows = points.withWatermark("at", late).groupBy(F.window("at", window), "curve_id")
    return rows.agg(F.count("*").alias("points"), *[f(c).alias(f"{c}_{n}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))]).select("window.start", "window.end", "*").drop("window")
