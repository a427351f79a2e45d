"""Angles, transforms, residuals and Jacobians against hand values, numpy and central differences."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphtide.functions import geometry as geo
from graphtide.functions import residuals


def values(spark, columns, **given):
    row = spark.createDataFrame([tuple(float(v) for v in given.values())], list(given)).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return np.array([row[f"c{i}"] for i in range(len(columns))])


def c(*names):
    return [F.col(n) for n in names]


def test_wraps_at_pi(spark):
    for angle, low, high in ((math.pi, -math.pi, math.pi), (-math.pi, -math.pi, -math.pi), (0.5, 0.5, 0.5), (7.0, 7 - 2 * math.pi, 7 - 2 * math.pi), (-40.0, -40 + 12 * math.pi, -40 + 12 * math.pi)):
        got = values(spark, [geo.wrap(F.col("a")), geo.wrap_upper(F.col("a"))], a=angle)
        assert got == pytest.approx([low, high], abs=1e-12)


def test_transforms(spark):
    pose = {"x": 1.5, "y": -2.0, "t": 0.7}
    m = geo.to_matrix(*c("x", "y", "t"))
    assert values(spark, geo.to_vector(m), **pose) == pytest.approx([1.5, -2.0, 0.7])
    one = geo.multiply(m, geo.inverse(m))
    assert values(spark, [one[i][j] for i in range(3) for j in range(3)], **pose) == pytest.approx(np.eye(3).ravel(), abs=1e-12)
    back = geo.compose(c("x", "y", "t"), geo.invert(c("x", "y", "t")))
    assert values(spark, back, **pose) == pytest.approx([0, 0, 0], abs=1e-12)


@pytest.mark.parametrize("kind", ["P", "L", "G"])
def test_jacobians_equal_differences(spark, kind):
    rng = np.random.default_rng(5)
    names = ["x1", "y1", "t1", "x2", "y2", "t2", "z1", "z2", "z3"]
    make = {"P": lambda: residuals.pose_pose(c(*names[:3]), c(*names[3:6]), c(*names[6:])), "L": lambda: residuals.pose_landmark(c(*names[:3]), c(*names[3:5]), c(*names[6:8])), "G": lambda: residuals.pose_fix(c(*names[:3]), c(*names[6:8]))}[kind]
    e, a, b = make()
    at = dict(zip(names, rng.normal(size=9), strict=True))
    eps = 1e-6
    jac = [(a, names[:3])] + ([(b, names[3 : 3 + len(b[0])])] if b else [])
    for matrix, by in jac:
        got = values(spark, [x for row in matrix for x in row], **at).reshape(len(matrix), -1)
        for j, name in enumerate(by):
            up, down = (values(spark, e, **(at | {name: at[name] + s * eps})) for s in (1, -1))
            assert got[:, j] == pytest.approx((up - down) / (2 * eps), abs=1e-6)


def test_rotation_symmetric_error(spark):
    w = [[F.lit(x) for x in row] for row in ((4.0, 0.5, 0.0), (0.5, 4.0, 0.0), (0.0, 0.0, 16.0))]
    assert values(spark, [geo.quadratic(c("a", "b", "d"), w)], a=1, b=2, d=3)[0] == pytest.approx(4 + 16 + 2 + 144)
