"""From images to curves in data coordinates: axes, legends, colours, masks, paths, bindings, series and a report.

Each step is a table of all images at once. Tables that several steps read are written to the shared folder,
where one is set, and read again, so that no step computes another's work twice and lost executors cost
little; without one they are cached.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import axes as A
from . import binding as B
from . import colors as H
from . import components as P
from . import instances as I
from . import legends as L
from . import masks as K
from . import quality as Q
from . import segments as G


@dataclass
class Extraction:
    """The tables of an extraction, by their names."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to ``spark.checkpoint.dir`` and read back, or cached where that isn't set."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        return df.persist()
    path = f"{base.rstrip('/')}/plotwright/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _mask_key() -> F.Column:
    return F.to_json(F.struct(F.col("image_id"), F.col("curve_id")))


def trace(masks: DataFrame, drop_marker_like: bool = False) -> dict[str, DataFrame]:
    """Pieces, markers, path points and paths of masks ``(image_id, curve_id, x, y)``, each with these keys."""
    named = masks.select("image_id", "curve_id", _mask_key().alias("mask")).distinct()
    by_mask = masks.select(_mask_key().alias("image_id"), "x", "y")
    thin = kept(K.prune_spurs(K.skeleton(by_mask)), "skeletons")

    def back(rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("image_id", "mask").join(named, "mask").drop("mask")

    pieces = P.line_components(thin)
    traced, skeleton = K.trace_paths(thin), thin
    if drop_marker_like:
        labelled = K.label_components(thin)
        stay = P.drop_marker_like(P.described(K.component_stats(labelled))).select("image_id", "component")
        traced = traced.join(stay, ["image_id", "component"], "left_semi")
        skeleton = labelled.join(stay, ["image_id", "component"], "left_semi").select("image_id", "x", "y")
    points, paths = G.curve_paths(kept(traced, "traced"), skeleton)
    return {"pieces": kept(back(pieces), "pieces"), "markers": kept(back(P.marker_candidates(by_mask)), "markers"), "points": kept(back(points), "points"), "paths": kept(back(paths), "paths")}


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``id``, their number in the image."""
    return rows.withColumn("id", F.row_number().over(Window.partitionBy("image_id").orderBy(*order)).cast("long"))


def group(pieces: DataFrame, markers: DataFrame, prototypes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marker curves and line curves of each image.

    Markers are grouped where they aren't outnumbered by pieces of line: into as many curves as the legend has
    prototypes, by straight lines where the line-like pieces are more than those, which speaks of crossings.
    Other images' pieces are grouped if there are more than one prototype and enough pieces.
    """
    protos = prototypes.groupBy("image_id").agg(F.count("*").cast("int").alias("groups"))
    many = pieces.groupBy("image_id").agg(F.count_if(F.col("class_label") == "line_like").alias("lines"))
    scenes = I.marker_scenes(markers, pieces).where("grouped").select("image_id")
    spots = markers.join(scenes, "image_id", "left_semi").select("image_id", "curve_id", F.col("id").alias("own_id"), "x", "y").join(protos, "image_id", "left").join(many, "image_id", "left")
    spots = _numbered(spots, "curve_id", "own_id").withColumn("crossing", (F.col("groups") > 1) & (F.col("lines") > F.col("groups"))).na.fill(False, ["crossing"])
    spots = kept(spots, "spots")
    marked = kept(I.marker_instances(spots.where("not crossing"), "groups").unionByName(I.marker_instances(spots.where("crossing"), "groups", prefer_lines=True)), "marked")
    rest = pieces.join(marked.select("image_id").distinct(), "image_id", "left_anti").join(protos.where("groups > 1"), "image_id").join(many.select("image_id", "lines"), "image_id").where("lines >= groups")
    return marked, kept(I.line_instances(kept(_numbered(rest, "curve_id", "component"), "rest"), "groups"), "lined")


def to_data(points: DataFrame, plots: DataFrame, x_range: tuple[float, float], y_range: tuple[float, float], x_scale: str = "linear", y_scale: str = "linear") -> DataFrame:
    """``points`` with ``pixel_x``, ``pixel_y`` and their data coordinates ``x``, ``y``; images whose plot is empty have none."""
    c = F.col
    box = plots.where("x_max > x_min and y_max > y_min").select("image_id", *[c(b).alias(f"__{b}") for b in Q.BOX])
    rows = points.join(box, "image_id")
    u = (c("x") - c("__x_min")) / (c("__x_max") - c("__x_min"))
    v = 1.0 - (c("y") - c("__y_min")) / (c("__y_max") - c("__y_min"))
    if x_range[0] == x_range[1] or y_range[0] == y_range[1]:
        raise ValueError("data range must not be empty")
    new = {"pixel_x": c("x").cast("double"), "pixel_y": c("y").cast("double"), "x": S.map_coords(u, *x_range, x_scale), "y": S.map_coords(v, *y_range, y_scale)}
    return rows.withColumns(new).drop(*[f"__{b}" for b in Q.BOX])


def extract(images: DataFrame, pixels: DataFrame, texts: DataFrame | None = None, x_range: tuple[float, float] | None = None, y_range: tuple[float, float] | None = None, scales: tuple[str, str] = ("linear", "linear"), coloring: H.Coloring = H.Coloring(), drop_marker_like: bool = False) -> Extraction:
    """All tables of ``images(image_id, width, height)`` with their ``pixels(image_id, x, y, r, g, b)``; white pixels may be left out.

    ``texts`` are what a reader found (see ``legends.assign_labels``). Without data ranges there are no series.
    Images without axes have a row in ``axes`` and ``report`` and nothing else.
    """
    out = Extraction()
    t = out.tables
    t["axes"] = kept(A.detect_axes(images, pixels), "axes")
    plots = t["axes"].where("success").select("image_id", *Q.BOX).join(images.select("image_id", "width", "height"), "image_id")
    t["plots"] = plots
    found = L.pixel_legends(pixels, plots).select("image_id", *Q.BOX, "confidence", "source")
    if texts is not None:
        found = found.unionByName(L.text_legends(texts, plots).select("image_id", *Q.BOX, "confidence", "source"))
    t["legends"] = kept(L.merge_legends(found), "legends")
    items = L.legend_items(pixels, t["legends"], images)
    t["items"] = kept(L.assign_labels(items, texts) if texts is not None else items.withColumn("label", F.lit(None).cast("string")), "items")
    t["prototypes"] = kept(L.visual_prototypes(t["items"]), "prototypes")
    t["curves"] = kept(H.prototypes(pixels, plots, t["legends"], coloring), "curves")
    masks = kept(H.prototype_masks(pixels, plots, t["curves"], t["legends"]), "masks")
    t["masks"], t["mask_pixels"] = kept(H.mask_rows(masks, t["curves"]), "mask_rows"), masks
    t |= trace(masks, drop_marker_like)
    t["pieces"] = kept(I.drop_borders(t["pieces"], plots), "inner")
    t["marker_instances"], t["line_instances"] = group(t["pieces"], t["markers"], t["prototypes"])
    t["bindings"] = kept(B.scores(t["prototypes"], t["curves"], t["pieces"], t["markers"], t["marker_instances"], t["line_instances"]), "bindings")
    bound = B.bound_paths(t["prototypes"], t["bindings"], t["points"], t["paths"], t["pieces"], t["marker_instances"], t["line_instances"])
    t["bound_points"], t["bound_paths"] = (kept(d, n) for d, n in zip(bound, ("bound_points", "bound_paths")))
    series = None
    if x_range is not None and y_range is not None:
        t["data"] = to_data(t["points"], plots, x_range, y_range, *scales)
        t["bound_data"] = to_data(t["bound_points"], plots, x_range, y_range, *scales)
        series = t["series"] = Q.series(t["data"], ["image_id", "curve_id"])
        t["bound_series"] = Q.series(t["bound_data"], ["image_id", "prototype_id"])
    t["curve_rows"] = kept(Q.curve_rows(t["curves"], t["masks"], t["paths"], t["points"], series), "curve_rows")
    counted = {n: t[n] for n in ("legends", "items", "prototypes", "masks", "paths", "pieces", "markers", "marker_instances", "line_instances", "bindings", "bound_paths")}
    t["report"] = Q.report(t["axes"], counted, t["curve_rows"])
    return out
