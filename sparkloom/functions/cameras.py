"""Camera models as column expressions: projection, its derivative, and the way back from distorted pixels.

Parameters are an array in the usual order of each model: focal lengths, principal point, then distortion. A model scales a
normalised point by a factor of its squared radius and may shift it tangentially; derivatives are written out, and the way
back is a Newton iteration on them, of a fixed number of steps, null where it does not settle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.rotations import bound

STEPS = 12
SETTLED = 1e-12


@dataclass(frozen=True)
class Model:
    """``focals``: 1 or 2. ``radial``: factor and its derivative by the squared radius, from that and the distortion parameters.
    ``tangential``: indices of p1 and p2 among these."""

    focals: int
    extra: int
    radial: Callable[[Column, list[Column]], tuple[Column, Column]] | None = None
    tangential: tuple[int, int] | None = None


def _power_sums(k: list[Column], s: Column) -> tuple[Column, Column]:
    """1 + k1 s + k2 s^2 + ..., and its derivative."""
    value, slope = F.lit(0.0), F.lit(0.0)
    for n, c in reversed(list(enumerate(k, 1))):
        value, slope = (value + c) * s, slope * s + n * c
    return 1 + value, slope


def _radial(n: int) -> Callable:
    return lambda s, k: _power_sums(k[:n], s)


def _rational(s: Column, k: list[Column]) -> tuple[Column, Column]:
    top, top_slope = _power_sums([k[0], k[1], k[4]], s)
    low, low_slope = _power_sums(k[5:8], s)
    return top / low, (top_slope * low - top * low_slope) / (low * low)


def _division(s: Column, k: list[Column]) -> tuple[Column, Column]:
    left = 1 - 4 * k[0] * s
    root = F.sqrt(F.when(left > 0, left))
    return 2 / (1 + root), 4 * k[0] / (root * (1 + root) * (1 + root))


def _fisheye(s: Column, k: list[Column]) -> tuple[Column, Column]:
    r = F.sqrt(s)
    angle = F.atan(r)
    bent, slope = _power_sums(k[:4], angle * angle)
    far, by_angle = angle * bent, bent + 2 * angle * angle * slope
    near = s < 1e-8
    return F.when(near, 1 + (k[0] - 1 / 3) * s).otherwise(far / r), F.when(near, k[0] - 1 / 3).otherwise((by_angle * r / (1 + s) - far) / (2 * s * r))


MODELS = {
    "SIMPLE_PINHOLE": Model(1, 0),
    "PINHOLE": Model(2, 0),
    "SIMPLE_RADIAL": Model(1, 1, _radial(1)),
    "RADIAL": Model(1, 2, _radial(2)),
    "OPENCV": Model(2, 4, _radial(2), (2, 3)),
    "FULL_OPENCV": Model(2, 8, _rational, (2, 3)),
    "SIMPLE_DIVISION": Model(1, 1, _division),
    "DIVISION": Model(2, 1, _division),
    "OPENCV_FISHEYE": Model(2, 4, _fisheye),
}


def _split(model: str, params: Column) -> tuple[Column, Column, Column, Column, list[Column]]:
    """fx, fy, cx, cy and the distortion parameters."""
    n = MODELS[model].focals
    return params[0], params[n - 1], params[n], params[n + 1], [params[n + 2 + i] for i in range(MODELS[model].extra)]


def sound_params(model: str, params: Column) -> Column:
    """Whether there are as many parameters as the model has, all finite, the focal lengths above 0."""
    n = MODELS[model].focals
    whole = F.size(params) == n + 2 + MODELS[model].extra
    finite = F.forall(params, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & finite & (F.element_at(params, 1) > 0) & (F.element_at(params, n) > 0), F.lit(False))


def _warped(model: str, u: Column, v: Column, k: list[Column]) -> list[Column]:
    """A normalised point as the lens sends it, and the three different entries of the (symmetric) derivative."""
    kind = MODELS[model]
    if kind.radial is None:
        one, none = F.lit(1.0), F.lit(0.0)
        return [u, v, one, none, one]
    s = u * u + v * v
    f, g = kind.radial(s, k)
    out = [u * f, v * f, f + 2 * u * u * g, 2 * u * v * g, f + 2 * v * v * g]
    if kind.tangential:
        p, q = (k[i] for i in kind.tangential)
        more = [2 * p * u * v + q * (s + 2 * u * u), 2 * q * u * v + p * (s + 2 * v * v), 2 * p * v + 6 * q * u, 2 * p * u + 2 * q * v, 2 * q * u + 6 * p * v]
        out = [a + b for a, b in zip(out, more)]
    return out


def project(model: str, params: Column, point: Column) -> Column:
    """The pixel of a camera-frame point, as an array; null at or behind the camera."""

    def of(m: Column, p: Column) -> Column:
        fx, fy, cx, cy, k = _split(model, m)

        def at(u: Column, v: Column) -> Column:
            x, y, *_ = _warped(model, u, v, k)
            return F.array(fx * x + cx, fy * y + cy)

        return F.when(p[2] > 0, bound(at, p[0] / p[2], p[1] / p[2]))

    return bound(of, params, point)


def projection_jacobian(model: str, params: Column, point: Column) -> Column:
    """The derivative of the pixel by the camera-frame point, a row-major 2 x 3 array."""

    def of(m: Column, p: Column) -> Column:
        fx, fy, _, _, k = _split(model, m)

        def at(u: Column, v: Column, z: Column) -> Column:
            _, _, a, b, d = _warped(model, u, v, k)
            return F.array(fx * a / z, fx * b / z, -fx * (a * u + b * v) / z, fy * b / z, fy * d / z, -fy * (b * u + d * v) / z)

        return F.when(p[2] > 0, bound(at, p[0] / p[2], p[1] / p[2], p[2]))

    return bound(of, params, point)


def unproject(model: str, params: Column, x: Column, y: Column) -> Column:
    """The normalised point (u, v) that a pixel shows, as an array; null where the iteration does not settle, or beyond a fisheye's half-sphere."""

    def of(m: Column, px: Column, py: Column) -> Column:
        fx, fy, cx, cy, k = _split(model, m)
        if MODELS[model].radial is None:
            return F.array((px - cx) / fx, (py - cy) / fy)
        return bound(lambda a, b: _back(model, k, a, b), (px - cx) / fx, (py - cy) / fy)

    return bound(of, params, x, y)


def _back(model: str, k: list[Column], x: Column, y: Column) -> Column:
    kind = MODELS[model]
    if kind.radial is _division:  # one factor, known from where the point ends up
        scale = 1 + k[0] * (x * x + y * y)
        return F.when(scale > 0, F.array(x / scale, y / scale))
    if kind.radial is _fisheye:
        return _from_angle(k, x, y)

    def step(at: Column, _: Column) -> Column:
        def newton(w: Column) -> Column:
            a, b, d = w[2], w[3], w[4]
            det, ex, ey = a * d - b * b, w[0] - x, w[1] - y
            return F.array(at[0] - (d * ex - b * ey) / det, at[1] - (a * ey - b * ex) / det)

        return bound(newton, F.array(*_warped(model, at[0], at[1], k)))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.array(x, y), step)

    def sure(at: Column) -> Column:
        def settled(w: Column) -> Column:
            same = F.greatest(F.abs(w[0] - x), F.abs(w[1] - y)) <= SETTLED * (1 + F.abs(x) + F.abs(y))
            return F.when(same & (w[2] * w[4] - w[3] * w[3] > 0) & (w[2] > 0), at)  # on the branch around the centre

        return bound(settled, F.array(*_warped(model, at[0], at[1], k)))

    return bound(sure, found)


def _from_angle(k: list[Column], x: Column, y: Column) -> Column:
    """A fisheye's point by its angle to the axis."""

    def of(r: Column) -> Column:
        def step(angle: Column, _: Column) -> Column:
            bent, slope = _power_sums(k[:4], angle * angle)
            return angle - (angle * bent - r) / (bent + 2 * angle * angle * slope)

        def sure(angle: Column) -> Column:
            bent, slope = _power_sums(k[:4], angle * angle)
            ok = (F.abs(angle * bent - r) <= SETTLED * (1 + r)) & (angle >= 0) & (angle < 1.5707963267948966) & (bent + 2 * angle * angle * slope > 0)
            scale = F.when(r < 1e-12, F.lit(1.0)).otherwise(F.tan(angle) / r)
            return F.when(ok, bound(lambda c: F.array(x * c, y * c), scale))

        return bound(sure, F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), r, step))

    return bound(of, F.sqrt(x * x + y * y))


def undistorted(model: str, params: Column, x: Column, y: Column) -> Column:
    """The pixel that a pinhole of the same focal lengths and principal point would show."""

    def of(m: Column, at: Column) -> Column:
        fx, fy, cx, cy, _ = _split(model, m)
        return F.array(fx * at[0] + cx, fy * at[1] + cy)

    return bound(of, params, unproject(model, params, x, y))


def by_model(model: Column, of: Callable[[str], Column], models: list[str] | None = None) -> Column:
    """``of`` each row's model; null for another."""
    out = None
    for name in models or list(MODELS):
        out = F.when(model == name, of(name)) if out is None else out.when(model == name, of(name))
    return out
