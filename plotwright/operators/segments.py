"""Paths of several pieces: their order from left to right, the gaps between them, and their rebuilding.

Pieces are rows ``(image_id, component, seq, x, y)`` as ``masks.trace_paths`` gives them. All steps are
expressions over windows of one piece or image, but for the greedy order of the pieces, which takes one row
for each piece of an image.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import angle_between


@dataclass(frozen=True)
class Linking:
    """Fixed values of the tracing: limits of gaps, and weights of a connection's cost."""

    max_gap: float = 45.0
    max_angle: float = 60.0
    max_turn: float = 55.0
    hermite: bool = False
    backward: float = 2.0
    end_weight: float = 0.18
    start_weight: float = 0.12
    bend_weight: float = 0.03
    overlap_penalty: float = 20.0
    overlap_weight: float = 0.0
    long_gap_weight: float = 0.0
    short_length: int = 4
    short_penalty: float = 0.0
    completed_confidence: float = 0.35
    rebuild_pixels: int = 80
    rebuild_coverage: float = 0.55
    rebuild_gain: float = 1.15
    rebuild_radius: int = 7


class _Columns:
    """The few functions that a cost needs, for columns."""

    hypot, acos, degrees, lit = staticmethod(F.hypot), staticmethod(F.acos), staticmethod(F.degrees), staticmethod(F.lit)

    @staticmethod
    def clamp(value, low, high):
        return F.greatest(F.lit(low), F.least(F.lit(high), value))

    @staticmethod
    def where(test, a, b):
        return F.when(test, a).otherwise(b)


class _Arrays:
    """The same for arrays."""

    hypot, acos, degrees, lit, where = np.hypot, np.arccos, np.degrees, float, np.where

    @staticmethod
    def clamp(value, low, high):
        return np.clip(value, low, high)


def connection_cost(f, end, end_tangent, max_x, start, start_tangent, min_x, length, linking: Linking):
    """How dear it is to go on from a piece's end to another's start; pieces too far back cost infinity."""
    dx, dy = start[0] - end[0], start[1] - end[1]
    far = f.hypot(dx, dy)

    def angle(a, b):
        n = f.hypot(a[0], a[1]) * f.hypot(b[0], b[1])
        cos = (a[0] * b[0] + a[1] * b[1]) / f.where(n == 0, f.lit(1.0), n)
        return f.where(n == 0, f.lit(0.0), f.degrees(f.acos(f.clamp(cos, -1.0, 1.0))))

    gap, inf = (dx, dy), float("inf")
    overlap = f.clamp(max_x - min_x, 0.0, inf)
    cost = far + linking.end_weight * angle(end_tangent, gap) + linking.start_weight * angle(gap, start_tangent) + linking.bend_weight * angle(end_tangent, start_tangent)
    cost = cost + linking.overlap_weight * overlap + linking.long_gap_weight * f.clamp(far - linking.max_gap, 0.0, inf) + linking.short_penalty * f.clamp(linking.short_length - length, 0, inf)
    cost = cost + f.where(overlap > 0, f.lit(linking.overlap_penalty), f.lit(0.0))
    return f.where(dx < -linking.backward, f.lit(inf), cost)


def oriented(paths: DataFrame) -> DataFrame:
    """Each piece's points numbered from its left end: ``(image_id, component, i, n, x, y)``."""
    w = Window.partitionBy("image_id", "component")
    first, last = F.min_by("x", "seq").over(w), F.max_by("x", "seq").over(w)
    rows = paths.withColumns({"__n": F.count("*").over(w), "__k": F.row_number().over(w.orderBy("seq")) - 1, "__turn": first > last})
    return rows.select("image_id", "component", F.when(F.col("__turn"), F.col("__n") - 1 - F.col("__k")).otherwise(F.col("__k")).alias("i"), F.col("__n").alias("n"), "x", "y")


def segments(paths: DataFrame, reach: int = 5) -> DataFrame:
    """One row a piece: length, extent in x, centre, both ends and the directions over ``reach`` points there; a single point points right."""
    rows = oriented(paths)
    at = lambda place: F.max(F.when(F.col("i") == place, F.struct("x", "y")))
    n = F.col("n")
    out = rows.groupBy("image_id", "component", "n").agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.avg("x").alias("center_x"), F.avg("y").alias("center_y"),
        at(F.lit(0)).alias("p"), at(F.least(F.lit(reach), n - 1)).alias("pt"), at(F.greatest(F.lit(0), n - 1 - reach)).alias("qt"), at(n - 1).alias("q"),
    )
    lone = n < 2
    way = lambda a, b, c: F.when(lone, 1.0 if c == "x" else 0.0).otherwise((F.col(f"{b}.{c}") - F.col(f"{a}.{c}")).cast("double"))
    ends = [F.col(f"{p}.{c}").cast("double").alias(f"{name}_{c}") for name, p in (("start", "p"), ("end", "q")) for c in "xy"]
    return out.select("image_id", "component", n.alias("length"), "min_x", "max_x", "center_x", "center_y", *ends, way("p", "pt", "x").alias("start_dx"), way("p", "pt", "y").alias("start_dy"), way("qt", "q", "x").alias("end_dx"), way("qt", "q", "y").alias("end_dy"))


def costs(segments: DataFrame, pairs: DataFrame, linking: Linking = Linking()) -> DataFrame:
    """``pairs(image_id, a, b)`` of pieces with the ``cost`` of going on from a to b, null where b lies too far back."""
    left = segments.select("image_id", F.col("component").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("end_x", "end_y", "end_dx", "end_dy", "max_x")])
    right = segments.select("image_id", F.col("component").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("start_x", "start_y", "start_dx", "start_dy", "min_x", "length")])
    both = pairs.join(left, ["image_id", "a"]).join(right, ["image_id", "b"])
    c = F.col
    cost = connection_cost(_Columns, (c("a_end_x"), c("a_end_y")), (c("a_end_dx"), c("a_end_dy")), c("a_max_x"), (c("b_start_x"), c("b_start_y")), (c("b_start_dx"), c("b_start_dy")), c("b_min_x"), c("b_length"), linking)
    return both.select("image_id", "a", "b", F.when(cost < float("inf"), cost).alias("cost"))


def order(segments: DataFrame, linking: Linking = Linking()) -> DataFrame:
    """``(image_id, component, place)``: from the leftmost piece on always the cheapest one left; where all lie too far back, the leftmost. Ties go to the piece further left, then further up."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        s = frame.sort_values(["min_x", "center_y", "max_x", "component"], kind="stable").reset_index(drop=True)
        v = {c: s[c].to_numpy(float) for c in s.columns if c not in ("image_id", "component")}
        left, taken = np.arange(1, len(s)), [0]
        while len(left):
            at = taken[-1]
            cost = connection_cost(_Arrays, (v["end_x"][at], v["end_y"][at]), (v["end_dx"][at], v["end_dy"][at]), v["max_x"][at], (v["start_x"][left], v["start_y"][left]), (v["start_dx"][left], v["start_dy"][left]), v["min_x"][left], v["length"][left], linking)
            # pieces are sorted, so without a finite cost the first one left is the leftmost
            best = int(cost.argmin()) if np.isfinite(cost).any() else 0
            taken.append(left[best])
            left = np.delete(left, best)
        return pd.DataFrame({"image_id": s["image_id"], "component": s["component"].iloc[taken].to_numpy(), "place": range(len(s))})

    kind = segments.schema["image_id"].dataType.simpleString()
    return segments.groupBy("image_id").applyInPandas(run, f"image_id {kind}, component long, place int")


def gap_accepted(dx: Column, dy: Column, before: tuple[Column, Column] | None, after: tuple[Column, Column] | None, linking: Linking = Linking()) -> Column:
    """Whether points fill a gap: longer than a step, not too long, steep or backward, and in line with the directions before and after (null ones don't count)."""
    far = F.hypot(dx, dy)
    angle = F.abs(F.degrees(F.atan2(dy, F.when(dx == 0, 1e-9).otherwise(dx))))
    ok = (far > 1.5) & (far <= linking.max_gap) & (dx >= -1) & (angle <= linking.max_angle)
    for way, turn in ((before, lambda: angle_between(*before, dx, dy)), (after, lambda: angle_between(dx, dy, *after))):
        if way is not None:
            ok = ok & F.coalesce(turn() <= linking.max_turn, F.lit(True))
    return F.coalesce(ok, F.lit(False))


def gap_pixels(a: tuple[Column, Column], b: tuple[Column, Column], steps: Column, before: tuple[Column, Column] | None = None, after: tuple[Column, Column] | None = None) -> Column:
    """Array of whole points (x, y) between two, at ``steps`` equal parts by a straight line, or, with both directions, by Hermite's cubic; repeated points and the ends are left out."""
    far = F.hypot(b[0] - a[0], b[1] - a[1])

    def scaled(way: tuple[Column, Column]) -> list[Column]:
        n = F.hypot(*way)
        return [F.when(n == 0, 0.0).otherwise(w * far / n) for w in way]

    m0, m1 = (scaled(w) if w is not None else None for w in (before, after))

    def at(i: Column) -> Column:
        t = i / steps
        if m0 is None or m1 is None:
            place = [p + (q - p) * t for p, q in zip(a, b)]
        else:
            t2, t3 = t * t, t * t * t
            place = [(2 * t3 - 3 * t2 + 1) * a[k] + (t3 - 2 * t2 + t) * m0[k] + (3 * t2 - 2 * t3) * b[k] + (t3 - t2) * m1[k] for k in range(2)]
        return F.struct(F.bround(place[0]).cast("long").alias("x"), F.bround(place[1]).cast("long").alias("y"))

    every = F.when(steps > 1, F.transform(F.sequence(F.lit(1), F.greatest(steps - 1, F.lit(1))), at)).otherwise(F.array().cast("array<struct<x: bigint, y: bigint>>"))
    ends = [F.struct(F.bround(p[0]).cast("long").alias("x"), F.bround(p[1]).cast("long").alias("y")) for p in (a, b)]
    inner = F.filter(every, lambda p: (p != ends[0]) & (p != ends[1]))
    return F.filter(inner, lambda p, i: (i == 0) | (p != F.get(inner, i - 1)))


def _filled(rows: DataFrame, by: list[str], linking: Linking) -> DataFrame:
    """``rows(*by, at, x, y, before_dx, before_dy, after_dx, after_dy, open)`` in order, with the points of accepted gaps before each open row: ``(*by, seq, x, y, completed)``."""
    w = Window.partitionBy(*by).orderBy("at")
    c = F.col
    rows = rows.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)})
    dx, dy = c("x") - c("px"), c("y") - c("py")
    before, after = (c("before_dx"), c("before_dy")), (c("after_dx"), c("after_dy"))
    steps = F.bround(F.hypot(dx, dy)).cast("int")
    line = gap_pixels((c("px"), c("py")), (c("x"), c("y")), steps)
    if linking.hermite:
        both = c("before_dx").isNotNull() & c("after_dx").isNotNull()
        line = F.when(both, gap_pixels((c("px"), c("py")), (c("x"), c("y")), steps, before, after)).otherwise(line)
    gap = F.when(c("open") & gap_accepted(dx, dy, before, after, linking), line).otherwise(F.array().cast("array<struct<x: bigint, y: bigint>>"))
    own = F.array(F.struct(c("x").cast("long").alias("x"), c("y").cast("long").alias("y"), F.lit(False).alias("completed")))
    done = F.transform(gap, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(True).alias("completed")))
    repeated = c("open") & (c("x") == c("px")) & (c("y") == c("py"))
    rows = rows.where(~F.coalesce(repeated, F.lit(False))).select(*by, "at", F.posexplode(F.concat(done, own)).alias("i", "p"))
    seq = F.row_number().over(Window.partitionBy(*by).orderBy("at", "i")) - 1
    return rows.select(*by, seq.alias("seq"), "p.x", "p.y", "p.completed")


def join_pieces(paths: DataFrame, linking: Linking = Linking()) -> DataFrame:
    """``(image_id, seq, x, y, completed)``: all pieces of an image in order as one path, with points over accepted gaps."""
    parts = segments(paths)
    placed = order(parts, linking).join(parts.select("image_id", "component", "start_dx", "start_dy", "end_dx", "end_dy"), ["image_id", "component"])
    last = Window.partitionBy("image_id").orderBy("place")
    placed = placed.withColumns({"before_dx": F.lag("end_dx").over(last), "before_dy": F.lag("end_dy").over(last)})
    rows = oriented(paths).join(placed, ["image_id", "component"])
    rows = rows.select("image_id", F.struct("place", "i").alias("at"), "x", "y", "before_dx", "before_dy", F.col("start_dx").alias("after_dx"), F.col("start_dy").alias("after_dy"), ((F.col("i") == 0) & (F.col("place") > 0)).alias("open"))
    return _filled(rows, ["image_id"], linking)


def rebuilt(pixels: DataFrame, linking: Linking = Linking()) -> DataFrame:
    """``(image_id, seq, x, y, completed)``: the mean row of each column of the pixels, smoothed, with points over accepted gaps."""
    by_x = pixels.groupBy("image_id", "x").agg(F.bround(F.avg("y")).alias("y"))
    near = Window.partitionBy("image_id").orderBy("x").rowsBetween(-linking.rebuild_radius, linking.rebuild_radius)
    few = F.count("*").over(Window.partitionBy("image_id")) < 3
    smooth = by_x.select("image_id", "x", F.when(few, F.col("y")).otherwise(F.bround(F.avg("y").over(near))).alias("y"))
    w, c = Window.partitionBy("image_id").orderBy("x"), F.col
    ways = {"before_dx": F.lag("x").over(w) - F.lag("x", 2).over(w), "before_dy": F.lag("y").over(w) - F.lag("y", 2).over(w), "after_dx": F.lead("x").over(w) - c("x"), "after_dy": F.lead("y").over(w) - c("y")}
    rows = smooth.withColumns(ways).withColumn("open", F.lag("x").over(w).isNotNull())
    return _filled(rows.withColumn("at", c("x")), ["image_id"], linking)


def confidences(points: DataFrame, observed: Column | float = 1.0, completed: float = Linking.completed_confidence) -> DataFrame:
    """``points`` with ``confidence``: that of observed points, and for completed ones at most ``completed``."""
    seen = observed if isinstance(observed, Column) else F.lit(float(observed))
    return points.withColumn("confidence", F.when(F.col("completed"), F.least(seen, F.lit(completed))).otherwise(seen))


def curve_paths(traced: DataFrame, skeleton: DataFrame, linking: Linking = Linking()) -> tuple[DataFrame, DataFrame]:
    """``(points, paths)`` of each image from its traced pieces and the skeleton pixels they came from.

    A path that covers too little of its skeleton is rebuilt from the columns, if that makes it longer in x.
    ``points`` has ``(image_id, seq, x, y, completed, confidence)``; ``paths`` one row an image with the
    counts, the length, the confidence (the share of the skeleton that the path shows) and the warnings.
    """
    joined, made = join_pieces(traced, linking), rebuilt(skeleton, linking)
    total = skeleton.groupBy("image_id").agg(F.count("*").alias("observed"))
    span = lambda p, n: p.groupBy("image_id").agg((F.max("x") - F.min("x")).alias(f"{n}_span"), F.count_if(~F.col("completed")).alias(f"{n}_seen"))
    # what a path shows is judged before anything is rebuilt; rebuilt points' span is that of the columns
    judged = total.join(span(joined, "old"), "image_id").join(span(made, "new"), "image_id")
    low = (F.col("observed") >= linking.rebuild_pixels) & (F.col("old_seen") / F.col("observed") <= linking.rebuild_coverage) & (F.col("new_span") > F.col("old_span") * linking.rebuild_gain)
    judged = judged.select("image_id", "observed", low.alias("rebuilt"))
    chosen = joined.join(judged.where("not rebuilt").select("image_id"), "image_id", "left_semi").unionByName(made.join(judged.where("rebuilt").select("image_id"), "image_id", "left_semi"))
    points = confidences(chosen)
    w = Window.partitionBy("image_id").orderBy("seq")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    found = points.withColumn("step", step).groupBy("image_id").agg(F.count("*").alias("points"), F.count_if("completed").alias("completed"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))
    pieces = traced.groupBy("image_id").agg(F.count_distinct("component").alias("components"))
    from .masks import skeleton_nodes

    nodes = skeleton_nodes(skeleton).groupBy("image_id").agg(F.count_if(F.col("degree") == 1).alias("endpoints"), F.count_if(F.col("degree") >= 3).alias("junctions"))
    out = judged.join(found, "image_id").join(pieces, "image_id").join(nodes, "image_id")
    c = F.col
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c("points") - c("completed")) / F.greatest(c("observed"), F.lit(1))))
    say = lambda test, text: F.when(test, text)
    warnings = F.array_compact(F.array(
        say(c("rebuilt"), F.lit("path_rebuilt_from_skeleton_x_projection")),
        say(c("components") > 1, F.concat(F.lit("multiple_components="), c("components"))),
        say(c("components") > 1, F.lit("components_ordered_by_x")),
        say(c("junctions") > 0, F.concat(F.lit("junctions="), c("junctions"))),
        say(c("points") < c("observed"), F.lit("ordered path does not cover all skeleton pixels")),
        say(c("completed") > 0, F.concat(F.lit("gap_linked_points="), c("completed"))),
    ))
    return points, out.select("image_id", "components", "observed", "completed", "points", "length", "endpoints", "junctions", "rebuilt", confidence.alias("confidence"), warnings.alias("warnings"))
