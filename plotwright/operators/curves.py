"""Curves as long tables ``(curve_id, seq, x, y)``: correction, cleaning, resampling, paths.

One curve is the unit of parallelism; every window is partitioned by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import angle_degrees, angle_difference, map_coords

#: Guard of a renormalised range, as the correction chain defines it.
EPSILON = 1e-10
#: Consistency factor of the median absolute deviation.
MAD_FACTOR = 0.6745


def _all(by: str = "curve_id"):
    return Window.partitionBy(by)


def renormalize(curves: DataFrame, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Each column of a curve stretched to 0..1."""
    w = _all()
    span = {c: (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + EPSILON) for c in columns}
    return curves.withColumns(span)


def clip(curves: DataFrame, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    return curves.withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) for c in columns})


def clean_mad(curves: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Rows within ``threshold`` scaled median absolute deviations of the curve's median; all rows where the deviation is zero."""
    w = _all()
    near = curves.withColumn("__m", F.median("y").over(w)).withColumn("__d", F.median(F.abs(F.col("y") - F.col("__m"))).over(w))
    return near.where((F.col("__d") == 0) | (F.abs(MAD_FACTOR * (F.col("y") - F.col("__m")) / F.col("__d")) <= threshold)).drop("__m", "__d")


def _hat(window: int) -> np.ndarray:
    """Rows of the quadratic least-squares smoother over ``window`` equally spaced places."""
    a = np.vander(np.arange(window, dtype=float) - window // 2, 3)
    return a @ np.linalg.pinv(a)


def smooth_savgol(curves: DataFrame, window: int = 11) -> DataFrame:
    """``curves`` with ``smooth``: the quadratic Savitzky-Golay filter by position; both ends use their window's own parabola.

    A curve of fewer rows takes the largest odd window that it fills; under 5 rows it stays as it is.
    """
    w, n = Window.partitionBy("curve_id").orderBy("seq"), F.count("*").over(_all())
    reach = range(1 - window, window)
    near = {f"__y{k}": F.lag("y", -k).over(w) if k < 0 else F.lead("y", k).over(w) for k in reach if k}
    rows = curves.withColumns({"__i": F.row_number().over(w) - 1, "__n": n, **near})
    out = F.col("y")
    for size in range(5, window + 1, 2):
        hat, half = _hat(size), size // 2
        fits = (F.col("__n") >= size) if size == window else F.col("__n").isin(size, size + 1)
        # the window's first row lies at most `size` - 1 rows before and after
        place = F.least(F.greatest(F.col("__i") - half, F.lit(0)), F.col("__n") - size)
        value = F.lit(None).cast("double")
        for at in range(size):  # at: this row's place in its window
            terms = [F.col(f"__y{k - at}") if k != at else F.col("y") for k in range(size)]
            value = F.when(F.col("__i") - place == at, sum((F.lit(float(h)) * t for h, t in zip(hat[at], terms)), F.lit(0.0))).otherwise(value)
        out = F.when(fits, value).otherwise(out)
    return rows.withColumn("smooth", out).drop("__i", "__n", *near)


def flag_savgol(curves: DataFrame, sigma: float = 3.0) -> DataFrame:
    """``curves`` with ``smooth`` and ``kept``: whether the distance from the smoothed curve is at most ``sigma`` population deviations of these distances."""
    rows = smooth_savgol(curves).withColumn("__r", F.abs(F.col("y") - F.col("smooth")))
    rows = rows.withColumns({"__s": F.stddev_pop("__r").over(_all()), "__n": F.count("*").over(_all())})
    return rows.withColumn("kept", (F.col("__n") < 5) | (F.col("__s") == 0) | (F.col("__r") <= sigma * F.col("__s"))).drop("__r", "__s", "__n")


def clean_savgol(curves: DataFrame, sigma: float = 3.0) -> DataFrame:
    """The rows that ``flag_savgol`` keeps."""
    return flag_savgol(curves, sigma).where("kept").drop("smooth", "kept")


def _segments(curves: DataFrame, least: int = 500) -> DataFrame:
    """Each point with its successor, the grid's start and step, and the numbers of grid points up to the successor."""
    w, every = Window.partitionBy("curve_id").orderBy("x", "seq"), _all()
    rows = curves.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w), "lo": F.min("x").over(every), "hi": F.max("x").over(every), "size": F.greatest(F.lit(least), 2 * F.count("*").over(every))})
    rows = rows.withColumn("step", (F.col("hi") - F.col("lo")) / (F.col("size") - 1))
    first = F.ceil((F.col("x") - F.col("lo")) / F.col("step"))
    last = F.least(F.ceil((F.col("x1") - F.col("lo")) / F.col("step")) - 1, F.col("size") - 2)
    last_row = F.col("x1").isNull()
    return rows.withColumns({"k0": F.when(last_row, F.col("size") - 1).otherwise(first).cast("long"), "k1": F.when(last_row, F.col("size") - 1).otherwise(last).cast("long")})


def _on_grid(rows: DataFrame) -> DataFrame:
    """A row for each grid point of a segment; no join: the points are counted from the segment's ends."""
    rows = rows.where("step > 0 and k1 >= k0").withColumn("k", F.explode(F.sequence("k0", "k1")))
    return rows.withColumn("gx", F.when(F.col("k") == F.col("size") - 1, F.col("hi")).otherwise(F.col("lo") + F.col("k") * F.col("step")))


def resample_linear(curves: DataFrame, least: int = 500) -> DataFrame:
    """``(curve_id, k, x, y)`` on max(least, 2 n) equally spaced places, by straight lines. Each x of a curve must be unique; see ``average_by_x``."""
    rows = _on_grid(_segments(curves, least))
    y = F.when(F.col("x1").isNull(), F.col("y")).otherwise(F.col("y") + (F.col("y1") - F.col("y")) * (F.col("gx") - F.col("x")) / (F.col("x1") - F.col("x")))
    return rows.select("curve_id", "k", F.col("gx").alias("x"), y.alias("y"))


def resample_pchip(curves: DataFrame, least: int = 500) -> DataFrame:
    """The same by monotone cubics: inner slopes are weighted harmonic means of the neighbouring secants, the ends' are one-sided."""
    w = Window.partitionBy("curve_id").orderBy("x", "seq")
    rows = _segments(curves, least).withColumns({"h": F.col("x1") - F.col("x"), "d": (F.col("y1") - F.col("y")) / (F.col("x1") - F.col("x"))})
    rows = rows.withColumns({"hp": F.lag("h").over(w), "dp": F.lag("d").over(w), "hpp": F.lag("h", 2).over(w), "dpp": F.lag("d", 2).over(w), "hn": F.lead("h").over(w), "dn": F.lead("d").over(w)})

    def end(h0: str, h1: str, d0: str, d1: str) -> Column:
        a, b, s, t = (F.col(c) for c in (h0, h1, d0, d1))
        e = ((2 * a + b) * s - a * t) / (a + b)
        return F.when(t.isNull(), s).when(F.signum(e) != F.signum(s), 0.0).when((F.signum(s) != F.signum(t)) & (F.abs(e) > 3 * F.abs(s)), 3 * s).otherwise(e)

    w1, w2 = 2 * F.col("h") + F.col("hp"), F.col("h") + 2 * F.col("hp")
    inner = F.when(F.col("dp") * F.col("d") <= 0, 0.0).otherwise((w1 + w2) / (w1 / F.col("dp") + w2 / F.col("d")))
    slope = F.when(F.col("dp").isNull(), end("h", "hn", "d", "dn")).when(F.col("d").isNull(), end("hp", "hpp", "dp", "dpp")).otherwise(inner)
    rows = rows.withColumn("m", slope).withColumn("m1", F.lead("m").over(w))
    rows = _on_grid(rows)
    t = (F.col("gx") - F.col("x")) / F.col("h")
    y = (2 * t * t * t - 3 * t * t + 1) * F.col("y") + (t * t * t - 2 * t * t + t) * F.col("h") * F.col("m") + (3 * t * t - 2 * t * t * t) * F.col("y1") + (t * t * t - t * t) * F.col("h") * F.col("m1")
    return rows.select("curve_id", "k", F.col("gx").alias("x"), F.when(F.col("x1").isNull(), F.col("y")).otherwise(y).alias("y"))


def resample_gpr(curves: DataFrame, least: int = 500) -> DataFrame:
    """``(curve_id, k, x, y, y_std)`` by Gaussian process regression (RBF and white noise; the length scale with the best likelihood of a fixed grid).

    All points count. The regression is exact, so its time is cubic and its memory quadratic in a curve's points.
    """

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["x", "seq"])
        x, y = frame["x"].to_numpy(float), frame["y"].to_numpy(float)
        size, lo, hi = max(least, 2 * len(x)), x.min(), x.max()
        grid, mean, sd = np.linspace(lo, hi, size), y.mean(), y.std() or 1.0
        z, gap, best = (y - mean) / sd, np.subtract.outer(x, x) ** 2, None
        for length in (hi - lo or 1.0) * 2.0 ** -np.arange(1, 9):
            for noise in (0.01, 0.1, 0.5, 1.0):
                low = np.linalg.cholesky(np.exp(-gap / (2 * length * length)) + (noise + 1e-9) * np.eye(len(x)))
                a = np.linalg.solve(low.T, np.linalg.solve(low, z))
                score = -0.5 * z @ a - np.log(np.diag(low)).sum()
                if best is None or score > best[0]:
                    best = (score, length, noise, low, a)
        _, length, noise, low, a = best
        cross = np.exp(-(np.subtract.outer(grid, x) ** 2) / (2 * length * length))
        spread = 1.0 + noise - (np.linalg.solve(low, cross.T) ** 2).sum(axis=0)
        return pd.DataFrame({"curve_id": frame["curve_id"].iloc[0], "k": np.arange(size), "x": grid, "y": cross @ a * sd + mean, "y_std": np.sqrt(np.maximum(spread, 0)) * sd})

    return curves.select("curve_id", "seq", "x", "y").groupBy("curve_id").applyInPandas(fit, "curve_id string, k long, x double, y double, y_std double")


def _basis(x: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the first of the four cubic B-splines over the knots ``t`` that aren't zero at each x, and their values."""
    at = np.clip(np.searchsorted(t, x, "right") - 1, 3, len(t) - 5)
    b = np.ones((len(x), 1))
    for p in range(1, 4):
        new = np.zeros((len(x), p + 1))
        for r in range(p):
            right, left = t[at + r + 1], t[at + r + 1 - p]
            w = b[:, r] / (right - left)
            new[:, r] += w * (right - x)
            new[:, r + 1] += w * (x - left)
        b = new
    return at - 3, b


def _jumps(t: np.ndarray) -> np.ndarray:
    """Jumps of the third derivative at the inner knots: a row of five coefficients for each, in the unit of the mean distance of knots."""
    inner, step = len(t) - 8, (t[-1] - t[0]) / (len(t) - 7)
    out = np.zeros((inner, 5))
    for l in range(inner):
        k = l + 4  # this knot meets the splines l to l + 4
        for j in range(5):
            gaps = [t[k] - t[i] for i in range(l + j, l + j + 5) if i != k]
            out[l, j] = (t[l + j + 4] - t[l + j]) / np.prod([g / step for g in gaps])
    return out


def _banded(starts: np.ndarray, rows: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bands ``(n, width)`` of the normal equations of ``rows`` (values from column ``starts`` on), and their right side."""
    width = rows.shape[1]
    band, right = np.zeros((n, 5)), np.zeros(n)
    for i in range(width):
        np.add.at(right, starts + i, rows[:, i] * y)
        for j in range(i + 1):
            np.add.at(band, (starts + i, i - j), rows[:, i] * rows[:, j])
    return band, right


def _solve(band: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution by a banded Cholesky decomposition; ``band[i, d]`` is the matrix at ``(i, i - d)``."""
    n, low = len(band), band.tolist()
    for i in range(n):
        for d in range(min(4, i), -1, -1):
            j = i - d
            v = low[i][d] - sum(low[i][d + e] * low[j][e] for e in range(1, min(4 - d, j) + 1))
            low[i][d] = v / low[j][0] if d else max(v, 1e-14 * band[i, 0]) ** 0.5
    c = right.tolist()
    for i in range(n):
        c[i] = (c[i] - sum(low[i][d] * c[i - d] for d in range(1, min(4, i) + 1))) / low[i][0]
    for i in range(n - 1, -1, -1):
        c[i] = (c[i] - sum(low[i + d][d] * c[i + d] for d in range(1, min(4, n - 1 - i) + 1))) / low[i][0]
    return np.array(c)


def smoothing_spline(x: np.ndarray, y: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots and coefficients of the cubic spline whose squared residuals are at most ``bound``, after Dierckx.

    Knots are added where the residuals are largest, at points of the curve, until least squares fulfil the
    bound or the spline interpolates. Then the jumps of the third derivative are made as small as the bound
    lets them be. x rises strictly; there are four points at least.
    """
    m, inner, added, before = len(x), [], 0, 0.0
    while True:
        t = np.concatenate([[x[0]] * 4, x[sorted(inner)], [x[-1]] * 4])
        n = len(t) - 4
        starts, rows = _basis(x, t)
        band, right = _banded(starts, rows, y, n)
        c = _solve(band, right)
        left = y - (rows * c[starts[:, None] + np.arange(4)]).sum(axis=1)
        total = float(left @ left)
        if total <= bound or n == m:
            break
        fall = before - total
        if not inner:
            added = 1
        else:
            want = int(added * (total - bound) / fall) if fall > 0.001 * bound else 2 * added
            added = min(2 * added, max(want, added // 2, 1))
        before = total
        # squared residuals inside of the pieces between knots; a knot's own count half to both sides
        knots = [0, *sorted(inner), m - 1]
        squares, ends = left * left, np.array(knots)
        sums = np.concatenate([[0.0], np.cumsum(squares)])
        weight = (sums[ends[1:]] - sums[ends[:-1] + 1] + np.where(ends[:-1] > 0, 0.5, 1.0) * squares[ends[:-1]] + np.where(ends[1:] < m - 1, 0.5, 1.0) * squares[ends[1:]]).tolist()
        for _ in range(added):
            pieces = [b - a - 1 for a, b in zip(knots, knots[1:])]
            open_ = [k for k, p in enumerate(pieces) if p > 0]
            if not open_ or len(knots) + 2 >= m:
                break
            k = max(open_, key=lambda i: weight[i])
            half, whole = pieces[k] // 2 + 1, weight[k]
            weight[k : k + 1] = [whole * (half - 1) / pieces[k], whole * (pieces[k] - half) / pieces[k]]
            knots.insert(k + 1, knots[k] + half)
        inner = knots[1:-1]
        if len(inner) + 4 >= m:  # as many coefficients as points: interpolation, knots at all points but two from each end
            inner = list(range(2, m - 2))
    if not inner or total >= bound:
        return t, c
    jumps = _jumps(t)
    jump_band, _ = _banded(np.arange(len(inner)), jumps, np.zeros(len(inner)), n)
    strong, weak, best = 12.0, -24.0, c  # powers of ten of the penalty: too strong, not too strong
    for _ in range(50):
        power = (strong + weak) / 2
        c = _solve(band + 10.0**power * jump_band, right)
        left = y - (rows * c[starts[:, None] + np.arange(4)]).sum(axis=1)
        total = float(left @ left)
        if total <= bound:
            weak, best = power, c
            if total >= 0.9999 * bound:
                break
        else:
            strong = power
    return t, best


def resample_bspline(curves: DataFrame, least: int = 500, smoothing: float = 0.1) -> DataFrame:
    """``(curve_id, k, x, y)`` by a cubic smoothing B-spline whose squared residuals are at most smoothing * n * variance (see ``smoothing_spline``).

    Points of one x count as their mean. A curve of fewer than four of them is taken as the polynomial through them.
    """

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["x", "seq"])
        x, y = frame["x"].to_numpy(float), frame["y"].to_numpy(float)
        size, bound = max(least, 2 * len(x)), smoothing * len(x) * y.var()
        x, at = np.unique(x, return_inverse=True)
        y = np.bincount(at, y) / np.bincount(at)
        grid = np.linspace(x[0], x[-1], size)
        if len(x) < 4:
            mid = x.mean()
            values = np.polyval(np.polyfit(x - mid, y, len(x) - 1), grid - mid)
        else:
            scale = x[-1] - x[0]
            t, c = smoothing_spline((x - x[0]) / scale, y, bound)
            starts, rows = _basis((grid - x[0]) / scale, t)
            values = (rows * c[starts[:, None] + np.arange(4)]).sum(axis=1)
        return pd.DataFrame({"curve_id": frame["curve_id"].iloc[0], "k": np.arange(size), "x": grid, "y": values})

    return curves.select("curve_id", "seq", "x", "y").groupBy("curve_id").applyInPandas(fit, "curve_id string, k long, x double, y double")


def average_by_x(curves: DataFrame, rounded: bool = False) -> DataFrame:
    """One point for each x of a curve, with the mean y; ``rounded`` takes whole x and y (half to even), as for pixels."""
    x = F.bround("x") if rounded else F.col("x")
    y = F.bround(F.avg("y")) if rounded else F.avg("y")
    return curves.groupBy("curve_id", x.alias("x")).agg(y.alias("y"), F.count("*").alias("n"))


def moving_average(points: DataFrame, radius: int = 7) -> DataFrame:
    """``points(curve_id, x, y)`` with y averaged over ``radius`` rows to both sides, rounded half to even."""
    w = Window.partitionBy("curve_id").orderBy("x").rowsBetween(-radius, radius)
    return points.withColumn("y", F.bround(F.avg("y").over(w)))


def correct(curves: DataFrame, x_range: tuple = (0.0, 100.0), y_range: tuple = (0.0, 100.0), x_scale: str = "linear", y_scale: str = "linear", dirty: str = "renorm", cleaning: str = "mad", threshold: float = 3.0, fit: str = "interp") -> DataFrame:
    """The correction chain: bring to 0..1, map to the axes, clean, resample."""
    rows = {"renorm": renormalize, "clip": clip, "extrapolate": lambda c: c}[dirty](curves)
    rows = rows.withColumns({"x": map_coords(F.col("x"), *x_range, x_scale), "y": map_coords(F.col("y"), *y_range, y_scale)})
    rows = {"mad": clean_mad, "savgol": clean_savgol, "none": lambda c, _: c}[cleaning](rows, threshold)
    return {"interp": resample_linear, "pchip": resample_pchip, "bspline": resample_bspline, "gpr": resample_gpr, "none": lambda c: c}[fit](rows)


def corners(points: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """``(curve_id, corner, seq, x, y, distance, ok)``: the point nearest to each corner of a curve's bounding box, the first of equals."""
    box = points.groupBy("curve_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    spots = F.array(*[F.struct(F.lit(i).alias("corner"), F.col(a).alias("cx"), F.col(b).alias("cy")) for i, (a, b) in enumerate((("x0", "y0"), ("x1", "y0"), ("x0", "y1"), ("x1", "y1")))])
    limit = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * tolerance
    spots = box.select("curve_id", limit.alias("limit"), F.inline(spots))
    d = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
    # a partial minimum for each corner, so no window holds a curve once for each of them
    near = points.join(spots, "curve_id").groupBy("curve_id", "corner").agg(F.min(F.struct(d.alias("distance"), "seq", "x", "y", "limit")).alias("p"))
    return near.select("curve_id", "corner", "p.seq", "p.x", "p.y", "p.distance", (F.col("p.distance") <= F.col("p.limit")).alias("ok"))


def corner_affine(points: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """``points`` without the four corner points, mapped by the least-squares affine map that takes these to the unit square.

    Curves without four distinct corner points inside the tolerance stay as they are. The normal equations of
    four points are solved in closed form.
    """
    found = corners(points, tolerance).withColumns({"u": (F.col("corner") % 2).cast("double"), "v": F.floor(F.col("corner") / 2).cast("double")})
    s = lambda e: F.sum(e)
    x, y, u, v = (F.col(c) for c in "xyuv")
    sums = found.groupBy("curve_id").agg(F.min("ok").alias("ok"), F.count_distinct("seq").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(u).alias("mu"), F.avg(v).alias("mv"), s(x * x).alias("xx"), s(x * y).alias("xy"), s(y * y).alias("yy"), s(x * u).alias("xu"), s(y * u).alias("yu"), s(x * v).alias("xv"), s(y * v).alias("yv"), F.collect_set("seq").alias("gone"))
    c = F.col
    sxx, sxy, syy = c("xx") - 4 * c("mx") * c("mx"), c("xy") - 4 * c("mx") * c("my"), c("yy") - 4 * c("my") * c("my")
    det = sxx * syy - sxy * sxy
    out = {}
    for t in "uv":
        sx, sy = c(f"x{t}") - 4 * c("mx") * c(f"m{t}"), c(f"y{t}") - 4 * c("my") * c(f"m{t}")
        out |= {f"{t}x": F.try_divide(sx * syy - sy * sxy, det), f"{t}y": F.try_divide(sy * sxx - sx * sxy, det)}
    sums = sums.withColumns(out).withColumn("applied", c("ok") & (c("n") == 4)).select("curve_id", "applied", "gone", "mx", "my", "mu", "mv", *out)
    rows = points.join(sums, "curve_id").where(~(c("applied") & F.array_contains("gone", c("seq"))))
    new = {n: F.when(c("applied"), c(f"m{t}") + c(f"{t}x") * (c("x") - c("mx")) + c(f"{t}y") * (c("y") - c("my"))).otherwise(c(n)) for n, t in (("x", "u"), ("y", "v"))}
    return rows.select("curve_id", "seq", new["x"].alias("x"), new["y"].alias("y"), "applied")


# paths


def path_lengths(points: DataFrame) -> DataFrame:
    """``(curve_id, length, x_span, n)`` of ``points(curve_id, seq, x, y)``."""
    w = Window.partitionBy("curve_id").orderBy("seq")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return points.withColumn("__d", step).groupBy("curve_id").agg(F.coalesce(F.sum("__d"), F.lit(0.0)).alias("length"), (F.max("x") - F.min("x")).alias("x_span"), F.count("*").alias("n"))


def gap_points(points: DataFrame, max_gap: float = 95.0, step: float = 4.0, max_turn: float = 70.0) -> DataFrame:
    """``(curve_id, seq, i, x, y, completed)``: the points and, over each accepted gap, points every ``step``.

    A gap is over 1 and at most ``max_gap`` long, goes right, doesn't rise too steeply and turns at most
    ``max_turn`` degrees from the steps before and after it.
    """
    w = Window.partitionBy("curve_id").orderBy("seq")
    c = F.col
    rows = points.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w), "xp": F.lag("x").over(w), "yp": F.lag("y").over(w), "x2": F.lead("x", 2).over(w), "y2": F.lead("y", 2).over(w)})
    dx, dy = c("x1") - c("x"), c("y1") - c("y")
    d = F.sqrt(dx * dx + dy * dy)
    turns = []
    for ax, ay in ((c("x") - c("xp"), c("y") - c("yp")), (c("x2") - c("x1"), c("y2") - c("y1"))):
        turns.append(F.when(ax > 0, angle_difference(angle_degrees(dx, dy), angle_degrees(ax, ay))).otherwise(0.0))
    ok = (d > 1) & (d <= max_gap) & (dx > 0) & (F.abs(dy) <= F.greatest(F.lit(32.0), F.abs(dx) * 0.85)) & (F.greatest(*turns) <= max_turn)
    steps = F.when(F.coalesce(ok, F.lit(False)), F.greatest(F.lit(1), F.floor(d / step).cast("int"))).otherwise(1)
    rows = rows.withColumn("steps", steps).withColumn("i", F.explode(F.sequence(F.lit(0), c("steps") - 1)))
    t = c("i") / c("steps")
    at = lambda a, b: F.when(c("i") == 0, c(a)).otherwise(c(a) + (c(b) - c(a)) * t)
    return rows.select("curve_id", "seq", "i", at("x", "x1").alias("x"), at("y", "y1").alias("y"), (c("i") > 0).alias("completed"))


def islands(rows: DataFrame, by: str, order: str, max_gap: float) -> DataFrame:
    """``rows`` with ``island``: runs of a key in which neighbours are at most ``max_gap`` apart."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w) > max_gap).cast("int"), F.lit(0))
    return rows.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
