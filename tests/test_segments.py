"""Order, cost and gaps of pieces against plain loops and the known cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plotwright.operators import segments as G

PATH = "image_id long, component long, seq long, x long, y long"


def line(image, component, x0, x1, y, slope=0.0, seq=range):
    step = 1 if x1 >= x0 else -1
    return [(image, component, i, x, round(y + slope * (x - x0))) for i, x in enumerate(range(x0, x1 + step, step))]


def turn(a, b):
    n = math.hypot(*a) * math.hypot(*b)
    return 0.0 if n == 0 else math.degrees(math.acos(max(-1.0, min(1.0, (a[0] * b[0] + a[1] * b[1]) / n))))


def plain(points):
    """A piece from its points in order."""
    if points[0][0] > points[-1][0]:
        points = points[::-1]
    n = len(points)
    sub = lambda p, q: (q[0] - p[0], q[1] - p[1])
    return {
        "start": points[0], "end": points[-1], "lo": min(x for x, _ in points), "hi": max(x for x, _ in points), "n": n, "mid": sum(y for _, y in points) / n,
        "first": sub(points[0], points[min(5, n - 1)]) if n > 1 else (1.0, 0.0), "last": sub(points[max(0, n - 6)], points[-1]) if n > 1 else (1.0, 0.0),
    }


def price(a, b):
    gap = (b["start"][0] - a["end"][0], b["start"][1] - a["end"][1])
    if gap[0] < -2:
        return None
    out = math.hypot(*gap) + 0.18 * turn(a["last"], gap) + 0.12 * turn(gap, b["first"]) + 0.03 * turn(a["last"], b["first"])
    return out + (20.0 if a["hi"] > b["lo"] else 0.0)


def pieces(seed):
    r = random.Random(seed)
    rows = []
    for image in range(3):
        for c in range(12):
            x = r.randrange(0, 300)
            rows += line(image, c, x, x + r.choice([-1, 1]) * r.randrange(0, 30), r.randrange(0, 100), r.uniform(-1, 1))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_costs_and_order_equal_plain_loops(spark, seed):
    rows = pieces(seed)
    by = {}
    for m, c, _, x, y in rows:
        by.setdefault((m, c), []).append((x, y))
    every = {k: plain(v) for k, v in by.items()}
    parts = G.segments(spark.createDataFrame(rows, PATH)).cache()
    pairs = spark.createDataFrame([(m, a, b) for m, a in every for n, b in every if m == n and a != b], "image_id long, a long, b long")
    for x in G.costs(parts, pairs).collect():
        want = price(every[x.image_id, x.a], every[x.image_id, x.b])
        assert x.cost == (None if want is None else pytest.approx(want))
    got = {(x.image_id, x.place): x.component for x in G.order(parts).collect()}
    for image in range(3):
        left = sorted((p["lo"], p["mid"], p["hi"], c) for (m, c), p in every.items() if m == image)
        at = left.pop(0)
        for place in range(12):
            assert got[image, place] == at[3]
            if left:
                fit = [(price(every[image, at[3]], every[image, p[3]]), i) for i, p in enumerate(left)]
                fit = [f for f in fit if f[0] is not None]
                at = left.pop(min(fit)[1] if fit else 0)


def test_a_continuation_goes_before_a_nearer_turn(spark):
    rows = line(0, 0, 0, 20, 50) + line(0, 1, 30, 45, 50) + line(0, 2, 24, 26, 62, 4.0)
    found = {x.component: x.place for x in G.order(G.segments(spark.createDataFrame(rows, PATH))).collect()}
    assert found[0] == 0 and found[1] == 1


def test_gaps_in_line_are_filled_and_others_not(spark):
    straight = line(0, 0, 0, 10, 5) + line(0, 1, 20, 30, 5)
    steep = line(1, 0, 0, 10, 5) + line(1, 1, 20, 30, 60)
    long_ = line(2, 0, 0, 10, 5) + line(2, 1, 70, 80, 5)
    found = G.join_pieces(spark.createDataFrame(straight + steep + long_, PATH)).collect()
    done = {m: sorted((x.x, x.y) for x in found if x.image_id == m and x.completed) for m in range(3)}
    assert done == {0: [(x, 5) for x in range(11, 20)], 1: [], 2: []}
    assert [x.x for x in sorted((x for x in found if x.image_id == 0), key=lambda x: x.seq)] == list(range(31))


def test_hermite_gaps_bend_with_their_ends(spark):
    a, b = (F.lit(0.0), F.lit(0.0)), (F.lit(10.0), F.lit(0.0))
    frame = spark.range(1)
    straight = frame.select(G.gap_pixels(a, b, F.lit(10)).alias("p")).first().p
    assert [tuple(p) for p in straight] == [(x, 0) for x in range(1, 10)]
    bent = frame.select(G.gap_pixels(a, b, F.lit(10), (F.lit(5.0), F.lit(5.0)), (F.lit(5.0), F.lit(-5.0))).alias("p")).first().p
    assert max(p.y for p in bent) > 0
    assert frame.select(G.gap_pixels(a, b, F.lit(1)).alias("p")).first().p == []


def test_low_coverage_is_rebuilt_from_columns(spark):
    skeleton = [(0, x, 60) for x in range(12, 229)] + [(0, x, y) for x in range(20, 221, 25) for y in range(20, 100)]
    traced = [(0, 0, i, x, 60) for i, x in enumerate(range(12, 60))]
    points, paths = G.curve_paths(spark.createDataFrame(traced, PATH), spark.createDataFrame(skeleton, "image_id long, x long, y long").distinct())
    row = paths.first()
    assert row.rebuilt and "path_rebuilt_from_skeleton_x_projection" in row.warnings
    xs = [p.x for p in points.orderBy("seq").collect()]
    assert xs == list(range(12, 229))
    whole = [(0, 0, i, x, 60) for i, x in enumerate(range(12, 229))]
    flat = [(0, x, 60) for x in range(12, 229)]
    _, paths = G.curve_paths(spark.createDataFrame(whole, PATH), spark.createDataFrame(flat, "image_id long, x long, y long"))
    row = paths.first()
    assert not row.rebuilt and row.warnings == [] and row.confidence == 1.0 and (row.endpoints, row.junctions) == (2, 0)
