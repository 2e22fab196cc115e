"""Values of dense maps at image points.

A map is a table of cells. It is cut into tiles of ``SIZE`` cells each way with one more on the right and below, so
that the cells around a point are in one tile, and points meet tiles in an equi-join: a map of any size is
many tasks, and a tile with very many points is split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.names import free_prefix

SIZE = 32


def tiles(cells: DataFrame, sizes: DataFrame, image: str, values: list[str], size: int = SIZE) -> DataFrame:
    """``(image, tx, ty, x0, y0, across, map_width, map_height, values...)``: each value an array of the tile's cells, row by row.

    ``cells``: ``image``, ``x``, ``y`` and the values; ``sizes``: ``image``, ``width``, ``height``. A map whose cells are not all there, or
    there more than once, fails the query; cells outside their map are left out.
    """
    own = cells.select(F.col(image).alias("image"), F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), *values)
    known = sizes.select(F.col(image).alias("own"), F.col("width").cast("bigint").alias("map_width"), F.col("height").cast("bigint").alias("map_height"))
    inside = own.join(known, F.col("image") == F.col("own")).where("x >= 0 and y >= 0 and x < map_width and y < map_height").drop("own")

    def along(c: str) -> Column:
        at = F.floor(F.col(c) / size).cast("bigint")
        return F.when((F.col(c) % size == 0) & (at > 0), F.array(at - 1, at)).otherwise(F.array(at))

    dealt = inside.withColumn("tx", F.explode(along("x"))).withColumn("ty", F.explode(along("y")))
    held = dealt.groupBy("image", "tx", "ty", "map_width", "map_height").agg(F.array_sort(F.collect_list(F.struct("y", "x", *values))).alias("held"))
    across = F.least(F.lit(size + 1), F.col("map_width") - F.col("tx") * size)
    down = F.least(F.lit(size + 1), F.col("map_height") - F.col("ty") * size)
    held = held.select("*", (F.col("tx") * size).alias("x0"), (F.col("ty") * size).alias("y0"), across.cast("int").alias("across"), down.cast("int").alias("down"))
    fail = F.raise_error(F.concat(F.lit("cells of a map are missing or repeated: "), F.col("image").cast("string"))).cast("boolean")
    in_place = F.forall(F.transform("held", lambda h, i: (h["y"] - F.col("y0")) * F.col("across") + h["x"] - F.col("x0") == i), lambda ok: ok)
    whole = held.where(F.when((F.size("held") == F.col("across") * F.col("down")) & in_place, F.lit(True)).otherwise(fail))
    return whole.select("image", "tx", "ty", "x0", "y0", "across", "map_width", "map_height", *[F.transform("held", lambda h: h[v]).alias(v) for v in values])  # noqa: B023


def sampled(points: DataFrame, tiled: DataFrame, image: str, x: Column, y: Column, smooth: dict[str, str], nearest: dict[str, str], edge: str = "clamp", size: int = SIZE) -> DataFrame:
    """``points`` with a column for each of ``smooth`` (bilinear) and ``nearest``, named by their keys, from the maps' values.

    ``x``, ``y``: the place in cells, whole numbers at the cells' centres. ``edge='clamp'``: places outside are moved to the border; halves go up.
    ``edge='zero'``: cells outside count as 0; halves go to the even cell. Points without a map, or with a null or NaN place, get nulls.
    """
    if edge not in ("clamp", "zero"):
        raise ValueError(f"unknown edge: {edge}")
    p = free_prefix(points)
    sizes = tiled.where("tx = 0 and ty = 0").select(F.col("image").alias(f"{p}image"), F.col("map_width").alias(f"{p}w"), F.col("map_height").alias(f"{p}h"))
    rows = points.withColumns({f"{p}x": x.cast("double"), f"{p}y": y.cast("double")}).join(sizes, F.col(image) == F.col(f"{p}image"), "left").drop(f"{p}image")
    for c, n in ((f"{p}x", f"{p}w"), (f"{p}y", f"{p}h")):
        at = F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(n) - 1.0) if edge == "clamp" else F.col(c)
        rows = rows.withColumn(c, F.when(F.col(c).isNotNull() & ~F.isnan(c), at))
        rows = rows.withColumn(f"{c}0", F.floor(F.least(F.greatest(F.col(c), F.lit(-4.0)), F.col(n) + 4.0)).cast("bigint"))
        rows = rows.withColumn(f"{c}t", F.floor(F.least(F.greatest(F.col(f"{c}0"), F.lit(0)), F.col(n) - 1) / size).cast("bigint"))
    named = tiled.select(F.col("image").alias(f"{p}image"), F.col("tx").alias(f"{p}tx"), F.col("ty").alias(f"{p}ty"), F.col("x0").alias(f"{p}tx0"), F.col("y0").alias(f"{p}ty0"), F.col("across").alias(f"{p}across"), *[F.col(v).alias(f"{p}v_{v}") for v in dict.fromkeys([*smooth.values(), *nearest.values()])])
    met = rows.join(named, (F.col(image) == F.col(f"{p}image")) & (F.col(f"{p}xt") == F.col(f"{p}tx")) & (F.col(f"{p}yt") == F.col(f"{p}ty")), "left")

    def cell(v: str, cx: Column, cy: Column) -> Column:
        inside = (cx >= 0) & (cy >= 0) & (cx < F.col(f"{p}w")) & (cy < F.col(f"{p}h"))
        value = F.get(F.col(f"{p}v_{v}"), ((cy - F.col(f"{p}ty0")) * F.col(f"{p}across") + cx - F.col(f"{p}tx0")).cast("int")).cast("double")
        return F.when(inside, value).when(F.col(f"{p}image").isNotNull(), 0.0)

    u, v = F.col(f"{p}x") - F.col(f"{p}x0"), F.col(f"{p}y") - F.col(f"{p}y0")
    x1, y1 = F.col(f"{p}x0") + 1, F.col(f"{p}y0") + 1
    if edge == "clamp":
        x1, y1 = F.least(x1, F.col(f"{p}w") - 1), F.least(y1, F.col(f"{p}h") - 1)
    far = F.lit(edge == "zero") & ((F.abs(F.col(f"{p}x") - F.col(f"{p}x0")) > 1) | (F.abs(F.col(f"{p}y") - F.col(f"{p}y0")) > 1))
    out = {}
    for name, c in smooth.items():
        mixed = cell(c, F.col(f"{p}x0"), F.col(f"{p}y0")) * (1 - u) * (1 - v) + cell(c, x1, F.col(f"{p}y0")) * u * (1 - v) + cell(c, F.col(f"{p}x0"), y1) * (1 - u) * v + cell(c, x1, y1) * u * v
        out[name] = F.when(far, 0.0).otherwise(mixed)
    half = (lambda c: F.floor(c + 0.5)) if edge == "clamp" else F.rint
    for name, c in nearest.items():
        px, py = half(F.col(f"{p}x")).cast("bigint"), half(F.col(f"{p}y")).cast("bigint")
        if edge == "clamp":
            px, py = F.least(px, F.col(f"{p}w") - 1), F.least(py, F.col(f"{p}h") - 1)
        out[name] = F.when(far, 0.0).otherwise(cell(c, px, py))
    there = F.col(f"{p}x").isNotNull() & F.col(f"{p}y").isNotNull()
    return met.select(*[F.col(c) for c in points.columns], *[F.when(there, v).alias(n) for n, v in out.items()])


def attached_depth(keypoints: DataFrame, tiled: DataFrame, images: DataFrame, image: str, uncertainty: float) -> DataFrame:
    """``keypoints`` with ``depth``, ``stddev`` and ``valid``: bilinear depth and nearest validity of their image's map.

    ``images``: ``image``, ``original_width``, ``original_height``; a keypoint's ``x``, ``y`` in the original image are scaled to the map, cells outside
    count as 0. An image with a map but without an original size above 0 fails the query; images without a map give nulls.
    """
    p = free_prefix(keypoints)
    maps = tiled.where("tx = 0 and ty = 0").select(F.col("image").alias(f"{p}map"), F.col("map_width").alias(f"{p}mw"), F.col("map_height").alias(f"{p}mh"))
    own = images.select(F.col(image).alias(f"{p}own"), F.col("original_width").alias(f"{p}ow"), F.col("original_height").alias(f"{p}oh"))
    fail = F.raise_error(F.concat(F.lit("original image size is unavailable or invalid: "), F.col(f"{p}map").cast("string"))).cast("double")
    ok = (F.col(f"{p}ow") > 0) & (F.col(f"{p}oh") > 0)
    scale = maps.join(own, F.col(f"{p}map") == F.col(f"{p}own"), "left").select(f"{p}map", *[F.when(F.coalesce(ok, F.lit(False)), (F.col(a) / F.col(b)).cast("float").cast("double")).otherwise(fail).alias(n) for n, a, b in ((f"{p}sx", f"{p}mw", f"{p}ow"), (f"{p}sy", f"{p}mh", f"{p}oh"))])
    rows = keypoints.join(scale, F.col(image) == F.col(f"{p}map"), "left").drop(f"{p}map")
    found = sampled(rows, tiled, image, F.col("x") * F.col(f"{p}sx"), F.col("y") * F.col(f"{p}sy"), {"depth": "depth"}, {f"{p}valid": "valid"}, "zero")
    return found.select(*keypoints.columns, "depth", (F.col("depth") * uncertainty).alias("stddev"), (F.col(f"{p}valid") != 0).alias("valid"))
