"""Axes by plain loops, and plans that send no pixels to the driver."""

import random

import pytest

import __spark_entry__ as entry
from plotwright.operators import axes as A

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["detect_axes", "axis_errors"])
def test_no_drawn_table_is_broadcast(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def plain(spots, side, last):
    lines = {}
    for along, across in sorted(spots):
        parts = lines.setdefault(across, [])
        if parts and along - parts[-1][1] <= 2:
            parts[-1][1] = along
        else:
            parts.append([along, along])
    rows = [(p, lo, hi) for p, parts in lines.items() for lo, hi in parts if hi > lo and hi - lo >= A.LEAST * side]
    rows = [r for r in rows if r[2] - r[1] >= A.LONG * max(hi - lo for _, lo, hi in rows)]
    if not rows:
        return None
    pos, lo, hi = min(rows, key=lambda r: (-r[0] if last else r[0], r[1] - r[2], r[1]))
    n = {p: sum(v == p and lo <= t < hi for t, v in spots) for p in range(pos - A.REACH, pos + A.REACH + 1)}
    return pos, lo, hi, min(n, key=lambda p: (-n[p], p))


def test_axes_by_plain_loops(spark):
    r, images, pixels = random.Random(5), [], []
    for i in range(30):
        images.append((i, 60, 40))
        share = r.choice([0.0, 0.3, 0.6, 0.8])
        for _ in range(r.randrange(5)):
            at, lo = r.randrange(40), r.randrange(30)
            pixels += [(i, x, at) for x in range(lo, r.randrange(lo, 60)) if r.random() > 0.1]
            pixels += [(i, at, y) for y in range(lo // 2, r.randrange(lo // 2, 40)) if r.random() > 0.1]
        pixels += [(i, x, y) for x in range(60) for y in range(40) if r.random() < share / 4]
    pixels += pixels[::7]  # repeated ones count once
    rows = spark.createDataFrame(images, "image_id long, width int, height int"), spark.createDataFrame(pixels, "image_id long, x int, y int")
    for along, across, side, last in (("x", "y", "width", True), ("y", "x", "height", False)):
        got = {x.image_id: (x.pos, x.lo, x.hi, x.final) for x in A.main_axis(*rows, along, across, side, last).collect()}
        spots = {i: {(x, y) if along == "x" else (y, x) for k, x, y in pixels if k == i} for i, *_ in images}
        want = {i: plain(s, 60 if along == "x" else 40, last) for i, s in spots.items()}
        assert got == {i: v for i, v in want.items() if v} and 5 < len(got)
