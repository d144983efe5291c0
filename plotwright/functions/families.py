"""Families of known curves: expressions of x (and the curve's number) for drawn test data."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rising_frequencies(x: Column) -> Column:
    """One wave around 50 whose frequency doubles at x = 60 and again at 120."""
    wave = lambda turns, at, freq: 50 + 30 * F.sin(2 * math.pi * turns + 2 * math.pi * freq * (x - at) / 60)
    return F.when(x <= 60, wave(0, 0, 1)).when(x <= 120, wave(1, 60, 2)).otherwise(wave(5, 120, 4))


def slow_waves(x: Column, i: Column) -> Column:
    """Four waves of small frequencies over a slow one."""
    return (20 + 5 * i) * F.sin((0.02 + 0.005 * i) * x + i * (math.pi / 2)) + 20 * F.cos(0.01 * x)


def beating_waves(x: Column, i: Column) -> Column:
    """Four waves that swell and fade, over a common one."""
    return (30 + 10 * i) * F.sin((0.1 + 0.03 * i) * x + i * (math.pi / 2)) * F.cos(0.015 * x) + 20 * F.sin(0.2 * x)


def wide_waves(x: Column, i: Column) -> Column:
    """Eight waves over thousands."""
    return (2000 + 500 * i) * F.sin((0.002 + 0.0005 * i) * x + i * 0.8) + 1000 * F.cos(0.001 * x)


#: Base functions of the line families, by name.
LINES = {
    "sine": F.sin,
    "damped": lambda x: F.cos(x) * F.exp(-x / 10),
    "harmonics": lambda x: 2 * F.sin(0.8 * x) + 0.5 * F.cos(3 * x),
    "modulated": lambda x: F.sqrt(x) * F.sin(x),
}


def shifted_line(x: Column, i: Column, base: str) -> Column:
    """A base function shifted and scaled by the curve's number."""
    return (0.8 + 0.4 * F.sin(i.cast("double"))) * LINES[base](x + i * 0.8)


def overlapping(x: Column, i: Column, bend: Column) -> Column:
    """Smooth curves one above the other that come near each other around 9, with a bend around ``bend``."""
    phase = i * 0.7
    near = F.exp(-((x - 9.0) * (x - 9.0)) / 18.0) * (0.25 - 0.04 * i)
    wave = (0.18 + 0.04 * i) * F.sin(0.9 * x + phase) + 0.06 * F.cos(1.7 * x + phase / 2)
    return 0.4 * F.sin(0.55 * x) + 0.07 * x + wave + i * 0.38 + near + 0.12 * F.exp(-((x - bend) * (x - bend)) / 2.5) * F.sin(2.5 + i)


#: Slopes of the crossing curves, in turn (fixed values).
SLOPES = (0.58, -0.50, 0.34, -0.30, 0.18, -0.16)


def crossing(x: Column, i: Column, n: Column, middle: Column | float) -> Column:
    """Nearly straight curves that cross around the middle."""
    slope = F.element_at(F.array(*map(F.lit, SLOPES)), (i % len(SLOPES) + 1).cast("int"))
    return 2.05 + (i - (n - 1) / 2.0) * 0.045 + slope * (x - middle) / 6.0 + 0.08 * F.sin(0.7 * x + i * 0.9)
