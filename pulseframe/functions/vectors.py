"""Vectors and rotations as expressions over array<double> columns of three entries."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY = (0.0, 0.0, 9.81)


def vector(*xs: float) -> Column:
    return F.array(*(F.lit(float(x)) for x in xs))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def normalized(a: Column) -> Column:
    """a over its length; null for a zero vector."""
    return let(length(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)))


def cross(a: Column, b: Column) -> Column:
    part = lambda i, j: a[i] * b[j] - a[j] * b[i]
    return F.array(part(1, 2), part(2, 0), part(0, 1))


def cosine(a: Column, b: Column) -> Column:
    """Of the angle between the vectors; null if one is zero."""
    return F.try_divide(dot(a, b), length(a) * length(b))


def parallel(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether the vectors point the same or the opposite way."""
    return F.abs(F.abs(cosine(a, b)) - 1) <= atol + rtol


def some_orthogonal(a: Column) -> Column:
    """A unit vector orthogonal to a: a x y where a is parallel to x, else a x x."""
    return normalized(F.when(parallel(a, vector(1, 0, 0)), cross(a, vector(0, 1, 0))).otherwise(cross(a, vector(1, 0, 0))))


def orthogonal(a: Column, b: Column, exact: bool = False) -> Column:
    """A unit vector orthogonal to both; of nearly parallel ones one that is orthogonal to a, or, where exact, still their own, null where their product is zero."""
    if exact:
        return normalized(cross(a, b))
    return normalized(F.when(~parallel(a, b), cross(a, b)).when(parallel(a, vector(1, 0, 0)), cross(a, vector(0, 1, 0))).otherwise(cross(a, vector(1, 0, 0))))


def angle(a: Column, b: Column) -> Column:
    """Unsigned angle in radians; the cosine is clipped to -1..1."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b))))


def rotation(axis: Column, by: Column) -> Column:
    """3 x 3 matrix (array of rows) of the rotation by an angle about a unit axis."""

    def matrix(q: Column) -> Column:
        x, y, z, c, s, t = q.x, q.y, q.z, q.c, q.s, 1 - q.c
        return F.array(
            F.array(t * x * x + c, t * x * y - s * z, t * x * z + s * y), F.array(t * x * y + s * z, t * y * y + c, t * y * z - s * x), F.array(t * x * z - s * y, t * y * z + s * x, t * z * z + c)
        )

    return let(axis, lambda k: let(F.struct(k[0].alias("x"), k[1].alias("y"), k[2].alias("z"), F.cos(by).alias("c"), F.sin(by).alias("s")), matrix))


def shortest_rotation(a: Column, b: Column) -> Column:
    """The rotation of unit vector a to unit vector b about the axis orthogonal to both."""
    return rotation(orthogonal(a, b), angle(a, b))


def gravity_rotation(g: Column, expected: Sequence[float] = GRAVITY) -> Column:
    n = math.sqrt(sum(x * x for x in expected))
    return let(normalized(g), lambda u: shortest_rotation(u, vector(*(x / n for x in expected))))


def applied(matrix: Column, v: Column) -> Column:
    return F.transform(matrix, lambda row: dot(row, v))
