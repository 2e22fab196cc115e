"""Rotations and rigid poses as column expressions.

A rotation is a unit quaternion in an array (x, y, z, w), a vector an array of three. Each function binds its
arguments once, so that nested calls do not multiply the expression. A null argument gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def bound(body: Callable[..., Column], *values: Column) -> Column:
    """``body`` of the values, each evaluated once; null if one of them is null."""
    names = [f"v{i}" for i in range(len(values))]

    def of(p: Column) -> Column:
        there = p[names[0]].isNotNull()
        for n in names[1:]:
            there &= p[n].isNotNull()
        return F.when(there, body(*[p[n] for n in names]))

    return F.element_at(F.transform(F.array(F.struct(*[v.alias(n) for v, n in zip(values, names)])), of), 1)


def _dot(a: Column, b: Column, n: int) -> Column:
    return sum((a[i] * b[i] for i in range(1, n)), a[0] * b[0])


def unit(q: Column) -> Column:
    """At length one; the identity for a quaternion of no length."""
    return bound(lambda a, n: F.when(n < TINY, F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])).otherwise(F.transform(a, lambda x: x / n)), q, F.sqrt(_dot(q, q, 4)))


def conjugate(q: Column) -> Column:
    return bound(lambda a: F.array(-a[0], -a[1], -a[2], a[3]), q)


def product(a: Column, b: Column) -> Column:
    """The rotation ``b`` followed by ``a``."""

    def of(p: Column, q: Column) -> Column:
        x, y, z, w = (p[i] for i in range(4))
        return F.array(
            w * q[0] + x * q[3] + y * q[2] - z * q[1],
            w * q[1] - x * q[2] + y * q[3] + z * q[0],
            w * q[2] + x * q[1] - y * q[0] + z * q[3],
            w * q[3] - x * q[0] - y * q[1] - z * q[2],
        )

    return bound(of, a, b)


def turned(q: Column, v: Column) -> Column:
    """A vector turned by a rotation."""

    def of(p: Column, a: Column) -> Column:
        x, y, z, w = (p[i] for i in range(4))
        tx, ty, tz = 2 * (y * a[2] - z * a[1]), 2 * (z * a[0] - x * a[2]), 2 * (x * a[1] - y * a[0])
        return F.array(a[0] + w * tx + y * tz - z * ty, a[1] + w * ty + z * tx - x * tz, a[2] + w * tz + x * ty - y * tx)

    return bound(of, q, v)


def rotation_vector(q: Column) -> Column:
    """Axis times angle, the angle from 0 to pi; of the two signs of a quaternion that with w of 0 or more counts."""

    def of(p: Column) -> Column:
        def scaled(sign: Column, n: Column) -> Column:
            k = sign * F.when(n < TINY, F.lit(2.0)).otherwise(2 * F.atan2(n, F.abs(p[3])) / n)
            return bound(lambda c: F.array(*[c * p[i] for i in range(3)]), k)

        return bound(scaled, F.when(p[3] < 0, F.lit(-1.0)).otherwise(F.lit(1.0)), F.sqrt(_dot(p, p, 3)))

    return bound(of, q)


def from_rotation_vector(v: Column) -> Column:
    def of(a: Column, angle: Column) -> Column:
        k = F.when(angle < TINY, F.lit(0.5)).otherwise(F.sin(angle / 2) / angle)
        return bound(lambda c: F.array(*[c * a[i] for i in range(3)], F.cos(angle / 2)), k)

    return bound(of, v, F.sqrt(_dot(v, v, 3)))


def slerp(a: Column, b: Column, f: Column) -> Column:
    """The rotation ``f`` of the way from ``a`` to ``b``, at even speed over the shorter arc."""
    step = bound(lambda v, g: F.transform(v, lambda x: x * g), rotation_vector(product(conjugate(a), b)), f)
    return bound(lambda p, s: product(p, from_rotation_vector(s)), a, step)


def vector_blend(a: Column, b: Column, f: Column) -> Column:
    """The rotation of the rotation vectors' linear blend. Unlike :func:`slerp` it depends on the frame."""
    mixed = bound(lambda p, q, g: F.zip_with(p, q, lambda x, y: (1 - g) * x + g * y), rotation_vector(a), rotation_vector(b), f)
    return from_rotation_vector(mixed)


def linear(a: Column, b: Column, f: Column) -> Column:
    """Between two vectors."""
    return bound(lambda p, q, g: F.zip_with(p, q, lambda x, y: (1 - g) * x + g * y), a, b, f)


def angle_degrees(a: Column, b: Column) -> Column:
    """The angle between two rotations."""
    return bound(lambda v: F.degrees(F.sqrt(_dot(v, v, 3))), rotation_vector(product(conjugate(a), b)))


def inverse_pose(q: Column, t: Column) -> tuple[Column, Column]:
    """Rotation and translation of the inverse of x -> R x + t."""
    back = conjugate(q)
    return back, bound(lambda v: F.transform(v, lambda x: -x), turned(back, t))


def vector(*parts: Column | str | float) -> Column:
    """An array of doubles, null if a part is null."""
    cols = [F.col(p) if isinstance(p, str) else F.lit(p) if isinstance(p, (int, float)) else p for p in parts]
    there = cols[0].isNotNull()
    for c in cols[1:]:
        there &= c.isNotNull()
    return F.when(there, F.array(*[c.cast("double") for c in cols]))
