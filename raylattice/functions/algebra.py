"""Roots and splines."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def cubic_roots(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The real roots of a x³ + b x² + c x + d in ascending order, for a that isn't 0: by the cosines of thirds where there
    are three, else Cardano's one. Null coefficients give null."""
    p, q = (3 * a * c - b * b) / (3 * a * a), (2 * b * b * b - 9 * a * b * c + 27 * a * a * d) / (27 * a * a * a)
    shift, disc = b / (3 * a), q * q / 4 + p * p * p / 27
    cube = lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(1 / 3))
    size = 2 * F.sqrt(F.greatest(-p / 3, F.lit(0.0)))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(size > 0, 3 * q / (p * size)).otherwise(1.0))))
    three = F.array(*[size * F.cos((angle - 2 * math.pi * k) / 3) - shift for k in range(3)])
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    return F.when(disc.isNotNull(), F.when(disc < 0, F.array_sort(three)).otherwise(F.array(cube(-q / 2 + root) + cube(-q / 2 - root) - shift)))


def not_a_knot(xs: list[float], ys: list[float], x: float) -> float:
    """The cubic spline through the points of a small calibration, whose third derivative is continuous at the second and
    the last but one; beyond the ends it goes on. Fewer than four points give their polynomial. Points needn't be in
    order; of equal ones their mean counts."""
    order: dict[float, list[float]] = {}
    for a, b in sorted(zip(xs, ys, strict=True)):
        order.setdefault(float(a), []).append(float(b))
    t, y = np.array(list(order)), np.array([np.mean(v) for v in order.values()])
    n = len(t)
    if not n:
        raise ValueError("a spline needs points")
    if n < 4:
        return float(np.polyval(np.polyfit(t - t[0], y, n - 1), x - t[0]))
    h, slope = np.diff(t), np.diff(y) / np.diff(t)
    a, rhs = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 6 * (slope[i] - slope[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, rhs)
    i = int(np.clip(np.searchsorted(t, x) - 1, 0, n - 2))
    d = x - t[i]
    return float(y[i] + d * (slope[i] - h[i] * (2 * m[i] + m[i + 1]) / 6) + d * d * m[i] / 2 + d**3 * (m[i + 1] - m[i]) / (6 * h[i]))
