"""Residuals and Jacobians of the three kinds of measurement, as columns.

P: a pose seen from a pose; L: a landmark seen from a pose; G: a position fix of a pose. Each function gives
(e, A, B): the residual, and its derivatives by the first and the second node; G has no second.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphtide.functions.geometry import Matrix, Vector, multiply, wrap


def pose_pose(a: Vector, b: Vector, z: Vector) -> tuple[Vector, Matrix, Matrix]:
    (x1, y1, t1), (x2, y2, t2) = a, b
    c, s, cz, sz = F.cos(t1), F.sin(t1), F.cos(z[2]), F.sin(z[2])
    zero, one = F.lit(0.0), F.lit(1.0)
    dx, dy = x2 - x1, y2 - y1
    local = [c * dx + s * dy - z[0], c * dy - s * dx - z[1]]
    back = [[cz, sz], [-sz, cz]]
    e = [back[0][0] * local[0] + back[0][1] * local[1], back[1][0] * local[0] + back[1][1] * local[1], wrap(t2 - t1 - z[2])]
    by_first = multiply(back, [[-c, -s, c * dy - s * dx], [s, -c, -(c * dx + s * dy)]])
    by_second = multiply(back, [[c, s, zero], [-s, c, zero]])
    return e, [*by_first, [zero, zero, -one]], [*by_second, [zero, zero, one]]


def pose_landmark(a: Vector, l: Vector, z: Vector) -> tuple[Vector, Matrix, Matrix]:  # noqa: E741
    c, s = F.cos(a[2]), F.sin(a[2])
    dx, dy = l[0] - a[0], l[1] - a[1]
    e = [c * dx + s * dy - z[0], c * dy - s * dx - z[1]]
    return e, [[-c, -s, c * dy - s * dx], [s, -c, -(c * dx + s * dy)]], [[c, s], [-s, c]]


def pose_fix(a: Vector, z: Vector) -> tuple[Vector, Matrix, None]:
    zero, one = F.lit(0.0), F.lit(1.0)
    return [a[0] - z[0], a[1] - z[1]], [[one, zero, zero], [zero, one, zero]], None
