"""Inliers of two-view matches under each kind of pair geometry.

Residuals are column expressions of a match and its pair's geometry; the one decision that needs the other
matches of a pair, the vote on its orientation, is a count joined back, so a pair of any size is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import cos, radians

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import scalars as sc
from sparkloom.operators.names import free_prefix

EPSILON = 1e-12
CALIBRATED, UNCALIBRATED, PLANAR = "calibrated", "uncalibrated", "planar"


@dataclass(frozen=True)
class InlierOptions:
    """Largest errors, in pixels; the least angle to the epipole in degrees; the range of depths, in units of the baseline."""

    essential: float = 4.0
    fundamental: float = 4.0
    homography: float = 4.0
    epipole_degrees: float = 3.0
    nearest: float = 1e-2
    farthest: float = 100.0

    def __post_init__(self) -> None:
        if min(self.essential, self.fundamental, self.homography, self.epipole_degrees) < 0:
            raise ValueError("thresholds must not be negative")


def essential(q: list[Column], t: list[Column]) -> list[Column]:
    """Row-major [t]x R of a pose."""
    x, y, z, w = q
    r = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    return [t[(i + 1) % 3] * r[(i + 2) % 3][j] - t[(i + 2) % 3] * r[(i + 1) % 3][j] for i in range(3) for j in range(3)]


def lines(m: list[Column], a: list[Column], b: list[Column]) -> list[Column]:
    """The epipolar lines of both points of a match: ``m b`` across in the first image, ``m a`` in the second."""
    return [m[j] * b[0] + m[3 + j] * b[1] + m[6 + j] * b[2] for j in range(3)] + [m[3 * i] * a[0] + m[3 * i + 1] * a[1] + m[3 * i + 2] * a[2] for i in range(3)]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def bearing_error(line: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Squared Sampson error of two bearings with their lines, each line taken at its bearing's depth of one."""
    deep_a, deep_b = a[2] + EPSILON, b[2] + EPSILON
    c = _dot(line[3:], b) / deep_a
    return F.try_divide(c * c, (line[3] * line[3] + line[4] * line[4]) / (deep_a * deep_a) + (line[0] * line[0] + line[1] * line[1]) / (deep_b * deep_b))


def tangent_error(line: list[Column], b: list[Column], ja: Column, jb: Column) -> Column:
    """The same in pixels for any camera, with the rays' row-major 3 x 2 derivatives by the image point."""
    slopes = [own[0] * j[k] + own[1] * j[2 + k] + own[2] * j[4 + k] for own, j in ((line[:3], ja), (line[3:], jb)) for k in range(2)]
    c = _dot(line[3:], b)
    return F.try_divide(c * c, slopes[0] * slopes[0] + slopes[1] * slopes[1] + slopes[2] * slopes[2] + slopes[3] * slopes[3])


def in_front(turned: list[Column], t: list[Column], b: list[Column], nearest: float, farthest: float) -> Column:
    """Whether both rays, of length one, are nearest each other at depths within the range; ``turned``: the first in the second camera."""
    c, d1, d2 = -_dot(turned, b), -_dot(turned, t), _dot(b, t)
    first, second, scale = d1 - c * d2, d2 - c * d1, 1 - c * c
    return (first > nearest * scale) & (second > nearest * scale) & (first < farthest * scale) & (second < farthest * scale)


def epipole(t: list[Column]) -> list[Column]:
    """Direction of the other camera, on the side that is in front; one at the same place has none, and stays as it is."""
    n = F.sqrt(_dot(t, t))
    return [F.when(t[2] < 0, -x).otherwise(x) / F.when(n > EPSILON, n).otherwise(1.0) for x in t]


def fundamental_epipole(m: list[Column]) -> list[Column]:
    """The cross product of a fundamental matrix's first and last rows; of its last two where that is nothing."""
    across = lambda i, j: [m[3 * i + (k + 1) % 3] * m[3 * j + (k + 2) % 3] - m[3 * i + (k + 2) % 3] * m[3 * j + (k + 1) % 3] for k in range(3)]
    first, second = across(0, 2), across(1, 2)
    none = (F.abs(first[0]) <= EPSILON) & (F.abs(first[1]) <= EPSILON) & (F.abs(first[2]) <= EPSILON)
    return [F.when(none, y).otherwise(x) for x, y in zip(first, second)]


def orientation(m: list[Column], e: list[Column], a: list[Column], b: list[Column]) -> Column:
    """On which side of both images' epipolar geometry a match lies: its sign is one for all true matches of a pair."""
    return (m[0] * b[0] + m[3] * b[1] + m[6]) * (e[1] - e[2] * a[1])


def homography_error(h: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Squared distance of the second point to where the first one is sent."""
    w = h[6] * a[0] + h[7] * a[1] + h[8]
    dx, dy = (F.try_divide(h[3 * i] * a[0] + h[3 * i + 1] * a[1] + h[3 * i + 2], w) - b[i] for i in range(2))
    return dx * dx + dy * dy


def inlier_matches(matches: DataFrame, pairs: DataFrame, pair: str, options: InlierOptions = InlierOptions()) -> DataFrame:
    """The rows of ``matches`` that agree with their pair's geometry, all columns kept.

    ``matches``: ``pair``, ``x1, y1, x2, y2`` in pixels, and for calibrated pairs the unit rays ``ray1, ray2`` (and, for cameras that
    are no pinholes, their derivatives ``jac1, jac2``; null otherwise). ``pairs``: ``pair``, ``kind``, ``q, t`` of the second camera from
    the first, the mean focal lengths ``f1, f2``, and the row-major ``matrix`` of an uncalibrated (fundamental) or planar (homography) pair.

    Calibrated: an error below the threshold, taken to rays by the mean focal length (pixels for tangent errors), both depths in
    range, and neither ray near its epipole. Uncalibrated: an error below the threshold, then the orientation that most of these
    have; a tie leaves none, and a sign of 0 counts as negative. Planar: an error below the threshold. An error that can't be
    computed is no inlier; a pair without what its kind needs fails the query; matches of other pairs go.
    """
    p = free_prefix(matches)
    need = F.when(F.col("kind") == CALIBRATED, F.col("q").isNotNull() & F.col("t").isNotNull() & F.col("f1").isNotNull() & F.col("f2").isNotNull()).when(F.col("kind").isin(UNCALIBRATED, PLANAR), F.col("matrix").isNotNull())
    fail = F.raise_error(F.concat(F.lit("pair without the geometry of its kind: "), F.coalesce(F.col(pair).cast("string"), F.lit("null")))).cast("boolean")
    sound = pairs.where(F.when(F.coalesce(need, F.lit(False)), F.lit(True)).otherwise(fail))
    parts = lambda c, n: [F.col(c)[i] for i in range(n)]
    q, t, m = parts("q", 4), parts("t", 3), parts("matrix", 9)
    back = sc.rotated([-q[0], -q[1], -q[2], q[3]], [-x for x in t])
    # of a calibrated pair the essential matrix, of another its own, whose epipole is needed for an orientation
    held = [F.when(F.col("kind") == CALIBRATED, x).otherwise(y) for x, y in zip(essential(q, t), m)]
    own = {"q": q, "t": t, "m": held, "there": epipole(t), "back": epipole(back), "e": fundamental_epipole(m)}
    limit = (options.essential * 0.5 * (1 / F.col("f1") + 1 / F.col("f2"))).alias(f"{p}limit")
    geometry = sound.select(F.col(pair).alias(f"{p}pair"), F.col("kind").alias(f"{p}kind"), limit, *[x.alias(f"{p}{n}{i}") for n, xs in own.items() for i, x in enumerate(xs)])
    known = {n: [F.col(f"{p}{n}{i}") for i in range(len(xs))] for n, xs in own.items()}
    rows = matches.join(geometry, F.col(pair) == F.col(f"{p}pair"))

    calibrated = F.col(f"{p}kind") == CALIBRATED
    pixels = [[F.col(c).cast("double") for c in ("x1", "y1")], [F.col(c).cast("double") for c in ("x2", "y2")]]
    a, b = ([F.when(calibrated, F.col(f"ray{k}")[i]).otherwise(pixels[k - 1][i] if i < 2 else F.lit(1.0)) for i in range(3)] for k in (1, 2))
    staged = {"a": a, "b": b}
    rows = rows.withColumns({f"{p}{n}{i}": x for n, xs in staged.items() for i, x in enumerate(xs)})
    a, b = ([F.col(f"{p}{n}{i}") for i in range(3)] for n in "ab")
    staged = {"line": lines(known["m"], a, b), "turned": sc.rotated(known["q"], a)}
    rows = rows.withColumns({f"{p}{n}{i}": x for n, xs in staged.items() for i, x in enumerate(xs)})
    line, turned = ([F.col(f"{p}{n}{i}") for i in range(k)] for n, k in (("line", 6), ("turned", 3)))

    rays = bearing_error(line, a, b) < F.col(f"{p}limit") * F.col(f"{p}limit")
    if "jac1" in matches.columns:
        curved = tangent_error(line, b, F.col("jac1"), F.col("jac2")) < options.essential**2
        rays = F.when(F.col("jac1").isNotNull() & F.col("jac2").isNotNull(), curved).otherwise(rays)
    near = cos(radians(options.epipole_degrees)) + 1e-6
    apart = (_dot(a, known["back"]) < near) & (_dot(b, known["there"]) < near)
    sound_rays = rays & in_front(turned, known["t"], b, options.nearest, options.farthest) & apart
    c = _dot(line[3:], b)
    epipolar = F.try_divide(c * c, line[3] * line[3] + line[4] * line[4] + line[0] * line[0] + line[1] * line[1]) < options.fundamental**2
    planar = homography_error(known["m"], a, b) < options.homography**2
    first = rows.where(F.when(calibrated, sound_rays).when(F.col(f"{p}kind") == UNCALIBRATED, epipolar).otherwise(planar))
    first = first.withColumn(f"{p}side", F.when(F.col(f"{p}kind") == UNCALIBRATED, F.coalesce(orientation(known["m"], known["e"], a, b) > 0, F.lit(False))))
    votes = first.where(f"{p}side is not null").groupBy(F.col(f"{p}pair").alias(f"{p}voted")).agg(F.sum(F.when(F.col(f"{p}side"), 1).otherwise(-1)).alias(f"{p}lead"))
    counted = first.join(votes, F.col(f"{p}pair") == F.col(f"{p}voted"), "left")
    side, lead = F.col(f"{p}side"), F.col(f"{p}lead")
    return counted.where(side.isNull() | ((lead > 0) & side) | ((lead < 0) & ~side)).select(*[F.col(c) for c in matches.columns])
