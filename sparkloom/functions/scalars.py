"""Scalar functions as column expressions: names, rotations, projections and residuals."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seconds_of_name(name: Column) -> Column:
    """Seconds from an image name: the stem, or its part before the first '-', as a number; else 0.0."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.coalesce(stem.try_cast("double"), F.substring_index(stem, "-", 1).try_cast("double"), F.lit(0.0))


def nanoseconds_of_name(name: Column) -> Column:
    """Exact nanoseconds from a decimal name; null where it is no number or finer than a nanosecond."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.0-9]*$", "")
    part = F.when(stem.rlike(r"^\d+(\.\d+)?$"), stem).otherwise(F.substring_index(stem, "-", 1))
    ok = part.rlike(r"^\d{1,10}(\.\d{1,9}0*)?$")
    return F.when(ok, (part.try_cast("decimal(38,18)") * 1_000_000_000).cast("bigint"))


def canonical_json(value) -> str:
    """Sorted keys, ASCII, no NaN: equal values have equal texts."""
    return json.dumps(value, sort_keys=True, ensure_ascii=True, allow_nan=False, separators=(",", ":"))


def fingerprint(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def canonical_number(x: Column, places: int = 9) -> Column:
    """Rounded half to even, without a negative zero."""
    return F.bround(x, places) + F.lit(0.0)


def table_hash(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``(by..., rows, digest)``: a hash of the rows that does not depend on their order. Row hashes are summed in
    two 31-bit halves before the shuffle, so a group of any size is two numbers."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    sums = df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF))).alias("_a"), F.sum(F.shiftrightunsigned(h, 33)).alias("_b"))
    return sums.select(*by, "rows", F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("rows", "_a", "_b")]), 256).alias("digest"))


def set_digest(text: Column) -> Column:
    """A digest of a group's texts that does not depend on their order, as an aggregate: SHA-256 of their number and of two sums
    of parts of their MD5. Sums are partial before the shuffle, so no group is collected."""
    part = lambda at: F.sum(F.conv(F.substring(F.md5(text.cast("binary")), at, 8), 16, 10).cast("bigint"))
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), part(1).cast("string"), part(9).cast("string")), 256)


def rotation_error_degrees(a: list[Column], b: list[Column]) -> Column:
    """Angle between unit quaternions (x, y, z, w), from their dot product; the sign of either does not matter."""
    dot = sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])
    norm = lambda q: F.sqrt(sum((x * x for x in q[1:]), q[0] * q[0]))
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(dot) / (norm(a) * norm(b)))))


def rotated(q: list[Column], v: list[Column]) -> list[Column]:
    """A vector turned by a unit quaternion."""
    x, y, z, w = q
    tx, ty, tz = 2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0])
    return [v[0] + w * tx + y * tz - z * ty, v[1] + w * ty + z * tx - x * tz, v[2] + w * tz + x * ty - y * tx]


def similarity(s: Column, q: list[Column], t: list[Column], v: list[Column]) -> list[Column]:
    """s R v + t."""
    return [s * r + d for r, d in zip(rotated(q, v), t)]


def pinhole(fx: Column, fy: Column, cx: Column, cy: Column, v: list[Column]) -> list[Column]:
    """Image point of a camera-frame point; null at or behind the camera."""
    ok = v[2] > 0
    return [F.when(ok, fx * v[0] / v[2] + cx), F.when(ok, fy * v[1] / v[2] + cy)]


def bearing(x: Column, y: Column) -> list[Column]:
    """(x, y, 1) at unit length."""
    n = F.sqrt(x * x + y * y + 1)
    return [x / n, y / n, 1 / n]


def sampson(m: list[Column], p: list[Column], q: list[Column]) -> Column:
    """Squared Sampson error of homogeneous points p, q under a row-major 3 x 3 matrix m: (q' M p)^2 over the squared gradient."""
    mp = [m[3 * i] * p[0] + m[3 * i + 1] * p[1] + m[3 * i + 2] * p[2] for i in range(3)]
    mtq = [m[i] * q[0] + m[3 + i] * q[1] + m[6 + i] * q[2] for i in range(3)]
    c = q[0] * mp[0] + q[1] * mp[1] + q[2] * mp[2]
    return F.try_divide(c * c, mp[0] * mp[0] + mp[1] * mp[1] + mtq[0] * mtq[0] + mtq[1] * mtq[1])


def dead_zone_huber(s: Column, dead: float, width: float) -> Column:
    """Loss of a squared residual: none inside the dead zone, quadratic for ``width`` beyond it, then linear."""
    e = F.sqrt(s) - dead
    return F.when(e <= 0, 0.0).when(e <= width, e * e).otherwise(2 * width * e - width * width)


def log_depth_residual(depth: Column, scale: Column, measured: Column) -> Column:
    """log(scale * depth / measured); null unless all are above 0."""
    ok = (depth > 0) & (scale > 0) & (measured > 0)
    return F.when(ok, F.log(scale * depth / measured))


def quarter_turned(fx: Column, fy: Column, cx: Column, cy: Column, w: Column, h: Column, turns: int) -> list[Column]:
    """Intrinsics and size of an image turned ``turns`` quarters counter-clockwise: (fx, fy, cx, cy, w, h)."""
    now = [fx, fy, cx, cy, w, h]
    for _ in range(turns % 4):
        now = [now[1], now[0], now[3], now[4] - now[2], now[5], now[4]]
    return now


def scaled(x: Column, factor: Column) -> Column:
    """A keypoint coordinate in an image ``factor`` times the size, pixel centres at halves."""
    return (x + 0.5) * factor - 0.5


def inverse_2x2(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    """Row-major inverse; nulls where singular."""
    det = a * d - b * c
    return [F.try_divide(x, det) for x in (d, -b, -c, a)]


def metric_key(window: Column, threshold: Column) -> Column:
    """``wate_auc_{window}@{threshold}m``, the threshold in its shortest decimal form; a null window is 'full', in per cent."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", threshold.cast("double")), r"0+$", ""), r"\.$", "")
    return F.when(window.isNull(), F.concat(F.lit("wate_auc_full@"), text, F.lit("pct"))).otherwise(F.concat(F.lit("wate_auc_"), window.cast("string"), F.lit("@"), text, F.lit("m")))


def parsed_metric(key: Column) -> list[Column]:
    """(window, threshold, unit) of a metric key; nulls where it is none."""
    at = lambda i: F.nullif(F.regexp_extract(key, r"^wate_auc_([^@]+)@([0-9.]+)(m|pct)$", i), F.lit(""))
    return [at(1), at(2).try_cast("double"), at(3)]


def bilinear(values: list[Column], fx: Column, fy: Column) -> Column:
    """Between four corner values (00, 10, 01, 11) at fractions clamped to 0..1."""
    u, v = (F.least(F.greatest(f, F.lit(0.0)), F.lit(1.0)) for f in (fx, fy))
    return (1 - u) * (1 - v) * values[0] + u * (1 - v) * values[1] + (1 - u) * v * values[2] + u * v * values[3]
