"""Resampling and trajectories against their definitions."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plotwright.operators import curves as C
from plotwright.plans import queries as Q


def brute_trajectories(rows, groups=3, min_inliers=6, residual=10.0, assign=22.0):
    """``{id: label}`` of one image's ``(id, x, y)`` in plain loops: lines ranked once by all their inliers, points to the nearest of the fitted lines."""
    rows = sorted(rows)
    span = max(x for _, x, _ in rows) - min(x for _, x, _ in rows)
    dist = lambda line, p: abs(line[0] * p[1] + line[1] - p[2]) / (line[0] ** 2 + 1) ** 0.5
    ranked = []
    for i, p in enumerate(rows):
        for q in rows[i + 1 :]:
            if span > 1 and abs(q[1] - p[1]) >= max(80.0, 0.3 * span):
                s = (q[2] - p[2]) / (q[1] - p[1])
                line = (s, p[2] - s * p[1])
                ranked.append((-sum(dist(line, r) <= residual for r in rows), len(ranked), line))
    lines, covered = [], set()
    for n, _, line in sorted(ranked):
        own = {r[0] for r in rows if dist(line, r) <= residual} - covered
        if -n >= min_inliers and len(own) >= min_inliers and len(lines) < groups:
            lines.append(line)
            covered |= own
    if len(lines) < groups:
        return {}
    nearest = lambda r: min(range(groups), key=lambda g: dist(lines[g], r))
    for _ in range(2):
        of = [[r for r in rows if nearest(r) == g and dist(lines[g], r) <= assign] for g in range(groups)]
        lines = [tuple(np.polyfit([r[1] for r in m], [r[2] for r in m], 1)) if len(m) > 1 else lines[g] for g, m in enumerate(of)]
    found = {r[0]: nearest(r) for r in rows}
    return found if len(set(found.values())) == groups else {}


def test_trajectories_of_every_image_equal_brute_force(spark, tmp_path):
    rng, n = np.random.default_rng(3), 720
    x = np.tile(np.linspace(-1, 1, 10), n // 10)
    y = np.repeat(np.tile([-0.8, 0.0, 0.8], n // 30), 10) + 0.1 * x + rng.normal(0, 0.02, n)
    y[rng.random(n) < 0.05] += 0.3
    frame = pd.DataFrame({"vec_id": np.arange(n), "embedding": [[float(a), float(b)] for a, b in zip(x, y)], "label": 0})
    spark.createDataFrame(frame, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.image_id, r.id): r.label for r in Q.QUERIES["trajectory"](spark, str(tmp_path)).collect()}
    points = [(r.id, r.x, r.y) for r in Q.points(spark, str(tmp_path)).orderBy("id").collect()]
    want = {(at // 30, k): v for at in range(0, n, 30) for k, v in brute_trajectories(points[at : at + 30]).items()}
    assert got == want
    assert {i for i, _ in want} == set(range(n // 30))


def noisy(seed, n):
    rng = np.random.default_rng(seed)
    return np.sin(np.linspace(0, 9, n)) + rng.normal(0, 1, n)


def test_bspline_keeps_its_residual_bound(spark):
    rows = [(str(n), i, float(i), float(y)) for n in (4, 30, 31, 700) for i, y in enumerate(noisy(n, n))]
    curves = spark.createDataFrame(rows, "curve_id string, seq long, x double, y double")
    for n in (4, 30, 31, 700):
        # every tenth place of the grid is a point of the curve
        got = C.resample_bspline(curves.where(F.col("curve_id") == str(n)), least=10 * (n - 1) + 1).orderBy("k").toPandas()
        y = noisy(n, n)
        total, bound = ((y - got.y.to_numpy()[::10]) ** 2).sum(), 0.1 * n * y.var()
        assert len(got) == 10 * (n - 1) + 1 and total <= bound * 1.0001
        assert n == 4 or total >= 0.99 * bound  # as smooth as the bound lets it be


def test_a_strong_penalty_gives_the_cubic():
    x = np.linspace(0, 1, 40)
    y = noisy(5, 40)
    cubic = np.polyval(np.polyfit(x, y, 3), x)
    t, c = C.smoothing_spline(x, y, 0.999 * ((y - cubic) ** 2).sum())
    starts, rows = C._basis(x, t)
    assert np.abs((rows * c[starts[:, None] + np.arange(4)]).sum(axis=1) - cubic).max() < 0.15


def test_gpr_takes_every_point(spark):
    n = 450
    x, y = np.arange(n) ** 1.2, np.repeat(noisy(7, n // 2), 2)
    curves = spark.createDataFrame([("c", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "curve_id string, seq long, x double, y double")
    got = C.resample_gpr(curves).orderBy("k").toPandas()
    z, gap = (y - y.mean()) / y.std(), (x[:, None] - x[None, :]) ** 2
    best = []
    for length in (x[-1] - x[0]) * 2.0 ** -np.arange(1, 9):
        for noise in (0.01, 0.1, 0.5, 1.0):
            values, vectors = np.linalg.eigh(np.exp(-gap / (2 * length**2)) + (noise + 1e-9) * np.eye(n))
            w = vectors.T @ z
            best.append((-0.5 * (w * w / values).sum() - 0.5 * np.log(values).sum(), length, noise, vectors, values))
    _, length, noise, vectors, values = max(best, key=lambda b: b[0])
    grid = np.linspace(x[0], x[-1], 2 * n)
    cross = np.exp(-((grid[:, None] - x[None, :]) ** 2) / (2 * length**2)) @ vectors
    assert np.allclose(got.y, cross @ (vectors.T @ z / values) * y.std() + y.mean(), atol=1e-6)
    assert np.allclose(got.y_std, np.sqrt(1 + noise - (cross**2 / values).sum(axis=1)) * y.std(), atol=1e-6)
