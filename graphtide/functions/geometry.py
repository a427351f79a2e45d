"""SE(2) geometry as column expressions: each function takes and returns columns, and stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
Vector = list[Column]
Matrix = list[list[Column]]


def wrap(angle: Column) -> Column:
    """To [-pi, pi): the floored modulus, so pi itself becomes -pi."""
    return F.pmod(angle + math.pi, F.lit(TWO_PI)) - math.pi


def wrap_upper(angle: Column) -> Column:
    """To (-pi, pi], as an angle read back from its rotation matrix."""
    return F.atan2(F.sin(angle), F.cos(angle))


def to_matrix(x: Column, y: Column, theta: Column) -> Matrix:
    """The homogeneous transform of a pose."""
    c, s, zero, one = F.cos(theta), F.sin(theta), F.lit(0.0), F.lit(1.0)
    return [[c, -s, x], [s, c, y], [zero, zero, one]]


def to_vector(m: Matrix) -> Vector:
    """(x, y, theta) of a homogeneous transform."""
    return [m[0][2], m[1][2], F.atan2(m[1][0], m[0][0])]


def inverse(m: Matrix) -> Matrix:
    """Of a rigid transform: the transposed rotation, and the translation turned back."""
    (a, b, x), (c, d, y), last = m
    return [[a, c, -(a * x + c * y)], [b, d, -(b * x + d * y)], last]


def multiply(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for row in a:
        line = []
        for j in range(len(b[0])):
            total = row[0] * b[0][j]
            for k in range(1, len(b)):
                total = total + row[k] * b[k][j]
            line.append(total)
        out.append(line)
    return out


def compose(a: Vector, b: Vector) -> Vector:
    """The pose b, given in the frame of pose a."""
    c, s = F.cos(a[2]), F.sin(a[2])
    return [a[0] + c * b[0] - s * b[1], a[1] + s * b[0] + c * b[1], wrap_upper(a[2] + b[2])]


def invert(a: Vector) -> Vector:
    c, s = F.cos(a[2]), F.sin(a[2])
    return [-(c * a[0] + s * a[1]), s * a[0] - c * a[1], wrap_upper(-a[2])]


def between(a: Vector, b: Vector) -> Vector:
    """Pose b as seen from pose a."""
    return compose(invert(a), b)


def transpose(m: Matrix) -> Matrix:
    return [list(column) for column in zip(*m, strict=True)]


def quadratic(e: Vector, w: Matrix) -> Column:
    """e' W e."""
    total = F.lit(0.0)
    for i, x in enumerate(e):
        for j, y in enumerate(e):
            total = total + x * w[i][j] * y
    return total
