"""Texts in images: what a recognizer is given, and what becomes of the boxes that it finds.

No recognizer is part of the library; ``read_texts`` takes one as a function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAD, SCALE, LEAST = 40, 2.0, 0.5
TEXT = "text string, confidence double, polygon array<array<double>>"


def _cubic(t: np.ndarray) -> np.ndarray:
    """Weights of four neighbours at a place between the middle two, for the cubic kernel with slope -0.75."""
    a, d = -0.75, np.stack([t + 1, t, 1 - t, 2 - t], axis=-1)
    near = (a + 2) * d**3 - (a + 3) * d**2 + 1
    far = a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a
    return np.where(d <= 1, near, far)


def _stretched(image: np.ndarray, size: int) -> np.ndarray:
    """The first axis resampled to ``size`` by cubics; places beyond the ends take the ends' values."""
    place = (np.arange(size) + 0.5) * len(image) / size - 0.5
    first = np.floor(place).astype(int)
    at = np.clip(first[:, None] + np.arange(-1, 3), 0, len(image) - 1)
    return np.einsum("ik,ik...->i...", _cubic(place - first), image[at])


def prepared(image: np.ndarray, pad: int = PAD, scale: float = SCALE) -> np.ndarray:
    """An image with a white margin, enlarged: small texts at its edges are read better so."""
    framed = np.pad(image.astype(float), ((pad, pad), (pad, pad), (0, 0)), constant_values=255)
    h, w = framed.shape[:2]
    out = _stretched(_stretched(framed, int(h * scale)).swapaxes(0, 1), int(w * scale)).swapaxes(0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def restored(polygon: Column, pad: int = PAD, scale: float = SCALE) -> Column:
    """A polygon (points as arrays) found in a prepared image, in the image's own pixels."""
    return F.transform(polygon, lambda p: F.transform(p, lambda v: v / scale - pad))


def read_texts(images: DataFrame, recognize: Callable[[np.ndarray], Iterable[tuple[list, str, float]]], least: float = LEAST) -> DataFrame:
    """Texts of ``images(image_id, width, height, channels, data)`` (see ``files.read_images``) by ``recognize``.

    The function takes a prepared image (blue, green, red) and gives polygons, texts and confidences; it's sent to
    the tasks. Texts under the confidence, or that begin far outside the image, go. Columns as ``boxed`` gives.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                image = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
                found = list(recognize(prepared(np.repeat(image, 3, axis=2) if row.channels == 1 else image[..., :3])))
                yield pd.DataFrame({"image_id": [row.image_id] * len(found), "id": range(len(found)), "text": [str(t) for _, t, _ in found], "confidence": [float(c) for _, _, c in found], "polygon": [np.asarray(p, float).tolist() for p, _, _ in found]})

    kind = images.schema["image_id"].dataType.simpleString()
    rows = images.where("data is not null").select("image_id", "width", "height", "channels", "data").mapInPandas(run, f"image_id {kind}, id long, {TEXT}")
    rows = boxed(rows.where(F.col("confidence") >= least).withColumn("polygon", restored(F.col("polygon"))))
    return rows.where("least(x_min, y_min) >= -20")


def boxed(texts: DataFrame) -> DataFrame:
    """``texts(polygon)`` with its box, its centre (the mean of its points) and the angle of its first side in degrees."""
    part = lambda i: F.transform("polygon", lambda p: F.get(p, F.lit(i)))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    first, second = F.get("polygon", F.lit(0)), F.get("polygon", F.lit(1))
    angle = F.degrees(F.atan2(F.get(second, F.lit(1)) - F.get(first, F.lit(1)), F.get(second, F.lit(0)) - F.get(first, F.lit(0))))
    return texts.withColumns({"x_min": F.array_min(part(0)), "y_min": F.array_min(part(1)), "x_max": F.array_max(part(0)), "y_max": F.array_max(part(1)), "cx": mean(part(0)), "cy": mean(part(1)), "angle": angle})


def split_numbers(texts: DataFrame) -> DataFrame:
    """``boxed`` texts in which numbers run together cut into one row a number, each with an equal part of the box; ``part`` counts them."""
    c = F.col
    said = F.trim(c("text"))
    merged = said.contains(" ") & said.rlike(r"^[\d.\-]+\s+[\d.\-]+")
    parts = F.when(merged, F.split(said, r"\s+")).otherwise(F.array(c("text")))
    names = [n for n in texts.columns if n not in ("text", "x_min", "x_max", "cx", "cy")]
    rows = texts.select(*names, "x_min", "x_max", "cx", "cy", F.size(parts).alias("__n"), F.posexplode(parts).alias("part", "text"))
    step = (c("x_max") - c("x_min")) / c("__n")
    cut = c("__n") > 1
    new = {"x_min": F.when(cut, c("x_min") + c("part") * step).otherwise(c("x_min")), "x_max": F.when(cut, c("x_min") + (c("part") + 1) * step).otherwise(c("x_max")), "cx": F.when(cut, c("x_min") + (c("part") + 0.5) * step).otherwise(c("cx")), "cy": F.when(cut, (c("y_min") + c("y_max")) / 2).otherwise(c("cy"))}
    return rows.withColumns(new).drop("__n")


def filter_texts(texts: DataFrame, most_angle: float = 45.0) -> DataFrame:
    """``boxed`` texts without steep ones and without dashes as high as wide, which are samples of a legend."""
    shape = (F.col("y_max") - F.col("y_min")) / (F.col("x_max") - F.col("x_min") + 1e-6)
    dash = F.trim("text").isin("-", "—", "--", "_") & (shape > 0.6)
    return texts.where((F.abs("angle") <= most_angle) & ~dash)


def regions_of(texts: DataFrame, plots: DataFrame) -> DataFrame:
    """``texts(cx, cy)`` with ``region``: which of the nine fields around the plot of their image holds their centre, counted by rows from the upper left."""
    c = F.col
    third = lambda v, a, b: F.when(v < a, 0).when(v <= b, 1).otherwise(2)
    box = plots.select("image_id", *[c(n).alias(f"__{n}") for n in ("x_min", "y_min", "x_max", "y_max")])
    rows = texts.join(box, "image_id").withColumn("region", third(c("cx"), c("__x_min"), c("__x_max")) + 3 * third(c("cy"), c("__y_min"), c("__y_max")))
    return rows.drop("__x_min", "__y_min", "__x_max", "__y_max")
