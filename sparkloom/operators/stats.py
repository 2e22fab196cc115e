"""Error curves, robust group statistics and multi-level reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ranks import ranked

MISSING = 1e6  # the marker of an error that could not be measured
REGISTERED = 1e5  # errors below it are of registered rows


def error_auc(rows: DataFrame, by: list[str], error: str, thresholds: list[float]) -> DataFrame:
    """``(by..., threshold, auc, recall)``: area under the recall curve up to each threshold, over the threshold.

    Errors are ranked; recall at a rank is rank / n. Only errors strictly below a threshold move the curve, the
    last recall holds up to it; ``recall`` counts errors at or below it. Both to 4 places, halves to even.
    Null and NaN errors are left out; a group without errors gives no row. The curve is sums over ranks, so
    after one sort per group everything is aggregated.
    """
    w = Window.partitionBy(*by).orderBy(error)
    clean = rows.where(F.col(error).isNotNull() & ~F.isnan(error))
    ranked = clean.select(*by, F.col(error).alias("_e"), F.row_number().over(w).alias("_i"), F.count("*").over(Window.partitionBy(*by)).alias("_n"), F.coalesce(F.lag(error).over(w), F.lit(0.0)).alias("_pe"))
    aggs = []
    for i, t in enumerate(thresholds):
        below = F.col("_e") < t
        r, pr = F.col("_i") / F.col("_n"), (F.col("_i") - 1) / F.col("_n")
        area = F.coalesce(F.sum(F.when(below, (F.col("_e") - F.col("_pe")) * (r + pr) / 2)), F.lit(0.0))
        last_e, last_r = F.coalesce(F.max(F.when(below, F.col("_e"))), F.lit(0.0)), F.coalesce(F.max(F.when(below, r)), F.lit(0.0))
        aggs += [((area + (t - last_e) * last_r) / t).alias(f"_a{i}"), F.avg((F.col("_e") <= t).cast("double")).alias(f"_r{i}")]
    wide = ranked.groupBy(*by).agg(*aggs)
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.bround(F.col(f"_a{i}"), 4).alias("auc"), F.bround(F.col(f"_r{i}"), 4).alias("recall")) for i, t in enumerate(thresholds)]))
    return wide.select(*by, each.alias("x")).select(*by, "x.threshold", "x.auc", "x.recall")


def finite(rows: DataFrame, error: str) -> DataFrame:
    """Rows with a finite error."""
    return rows.where(F.col(error).isNotNull() & ~F.isnan(error) & (F.abs(error) < float("inf")))


def error_summary(rows: DataFrame, by: list[str], error: str) -> DataFrame:
    """``(by..., mean, median, n)`` over registered errors; ``n`` counts all rows."""
    ok = F.when(F.col(error) < REGISTERED, F.col(error))
    return rows.groupBy(*by).agg(F.avg(ok).alias("mean"), F.median(ok).alias("median"), F.count("*").alias("n"))


def imputed(expected: DataFrame, found: DataFrame, on: list[str], error: str, penalty: float = MISSING) -> DataFrame:
    """``expected`` with its error, the penalty where it was not found."""
    return expected.join(found.select(*on, error), on, "left").withColumn(error, F.coalesce(error, F.lit(penalty)))


def ate_statistics(rows: DataFrame, by: list[str], error: str) -> DataFrame:
    """rmse, mean, median, std (of the population), min, max and sum of squares of the errors."""
    e = F.col(error)
    return rows.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean"), F.median(e).alias("median"), F.stddev_pop(e).alias("std"), F.min(e).alias("min"), F.max(e).alias("max"), F.sum(e * e).alias("sse"))


def median_scale(rows: DataFrame, by: list[str], ratio: Column, default: float = 1.0) -> DataFrame:
    """``(by..., scale)``: exact median of the valid ratios, ``default`` without one."""
    return rows.groupBy(*by).agg(F.coalesce(F.median(ratio), F.lit(default)).alias("scale"))


def whole_median(rows: DataFrame, value: str, name: str = "median") -> DataFrame:
    """One row with the exact median of a whole table, null without a value; Spark's own keeps all distinct values in one task.

    A sketch tells a range of values that should hold the middle, counts tell whether it does, and only values of that range, or all if
    it does not, are ranked.
    """
    v = F.col(value)
    there = rows.where(v.isNotNull())
    low, high = there.agg(F.percentile_approx(value, [0.499, 0.501], 10_000).alias("p")).first()["p"] or (None, None)
    n, below, upto = there.agg(F.count("*"), F.count_if(v < F.lit(low)), F.count_if(v <= F.lit(high))).first()
    first, last = (n + 1) // 2, n // 2 + 1
    near = there
    if below < first and last <= upto:
        near, first, last = there.where((v >= F.lit(low)) & (v <= F.lit(high))), first - below, last - below
    held = ranked(near.groupBy(v.alias("v")).agg(F.count("*").alias("n")), ["v"], "rank", total="upto", value="n")
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("v")))
    return held.agg(((at(first) + at(last)) / 2).alias(name))


def median_log_scale(rows: DataFrame, by: list[str], a: Column, b: Column, floor: float = 1e-6) -> DataFrame:
    """``(by..., log_scale)``: median of log(max(a, floor) / max(b, floor)) over rows with both above 0."""
    ok = (a > 0) & (b > 0)
    return rows.groupBy(*by).agg(F.median(F.when(ok, F.log(F.greatest(a, F.lit(floor)) / F.greatest(b, F.lit(floor))))).alias("log_scale"))


def mad_sigma(rows: DataFrame, by: list[str], value: str, floor: float = 1e-3) -> DataFrame:
    """``(by..., sigma)``: 1.4826 times the median absolute deviation, at least ``floor``; 1 without a value."""
    middle = rows.groupBy(*by).agg(F.median(value).alias("_m"))
    joined = rows.join(middle, by)
    return joined.groupBy(*by).agg(F.greatest(F.coalesce(1.4826 * F.median(F.abs(F.col(value) - F.col("_m"))), F.lit(1.0)), F.lit(floor)).alias("sigma"))


def observation_counts(obs: DataFrame, track: str, image: str, feature: str, loop: Column) -> DataFrame:
    """``(image, regular, loop)``: regular rows, and distinct loop features within each track."""
    regular = obs.where(~loop).groupBy(image).agg(F.count("*").alias("regular"))
    looped = obs.where(loop).select(track, image, feature).distinct().groupBy(image).agg(F.count("*").alias("loop"))
    return regular.join(looped, image, "full_outer").na.fill(0, ["regular", "loop"])


def selection_counts(obs: DataFrame, track: str, image: str, feature: str, loop: Column) -> DataFrame:
    """One row: regular rows, distinct loop rows, distinct points, and whether there is any."""
    looped = F.count_distinct(F.when(loop, F.struct(track, image, feature)))
    return obs.agg(F.count_if(~loop).alias("regular"), looped.alias("loop"), F.count_distinct(track).alias("points"), (F.count("*") > 0).alias("any_support"))


def edge_support(matches: DataFrame, a: str, b: str, match: list[str], score: str) -> DataFrame:
    """``(first, second, matches, score)`` per undirected edge: distinct matches and the sum of finite scores."""
    ok = F.when(~F.isnan(score) & (F.abs(score) < float("inf")), F.col(score))
    return matches.groupBy(F.least(a, b).alias("first"), F.greatest(a, b).alias("second")).agg(F.count_distinct(F.struct(*match)).alias("matches"), F.coalesce(F.sum(ok), F.lit(0.0)).alias("score"))


def preceding_support(obs: DataFrame, frame: str, point: str, history: int) -> DataFrame:
    """``(frame, before, shared, share)``: distinct points shared with each of the ``history`` frames before (by rank),
    also over the most shared of the row's frame; frames that share none are kept with 0.

    Points meet on equi-joins of (point, rank); a point's pairs are bounded by ``history`` per observation.
    """
    ranks = ranked(obs.select(frame).distinct(), [frame], "_r")
    seen = obs.select(frame, point).distinct().join(ranks, frame).select(point, "_r")
    back = seen.select(point, F.col("_r").alias("_now"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(history).cast("bigint"))).alias("_d")).withColumn("_r", F.col("_now") - F.col("_d"))
    shared = back.join(seen, [point, "_r"]).groupBy("_now", "_r").agg(F.count("*").alias("shared"))
    grid = ranks.select(F.col("_r").alias("_now"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(history).cast("bigint"))).alias("_d")).withColumn("_r", F.col("_now") - F.col("_d")).where("_r >= 1")
    full = grid.join(shared, ["_now", "_r"], "left").na.fill(0, ["shared"])
    name = lambda col, to: ranks.select(F.col("_r").alias(col), F.col(frame).alias(to))
    top = F.max("shared").over(Window.partitionBy("_now"))
    return full.withColumn("share", F.coalesce(F.try_divide(F.col("shared").cast("double"), top), F.lit(0.0))).join(name("_now", frame), "_now").join(name("_r", "before"), "_r").select(frame, "before", "shared", "share")


def path_unit(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """``(by, unit)``: median of the finite steps over 1e-9, else span / (n - 1), else 1."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(*order)))
    s = rows.select(by, value, step.alias("_s"))
    good = F.when((F.col("_s") > 1e-9) & (F.col("_s") < float("inf")), F.col("_s"))
    span = F.try_divide(F.max(value) - F.min(value), F.count("*") - 1)
    return s.groupBy(by).agg(F.coalesce(F.median(good), F.when(span > 0, span), F.lit(1.0)).alias("unit"))


def point_quality(rays: DataFrame, point: str, x: str, y: str, z: str) -> DataFrame:
    """``(point, score)``: trace of the inverse of the sum of projectors I - d d' over unit rays d; infinity where singular.

    Six sums per point, then the closed form of the 3 x 3 inverse.
    """
    n = F.sqrt(F.col(x) ** 2 + F.col(y) ** 2 + F.col(z) ** 2)
    d = rays.where(n > 0).select(point, (F.col(x) / n).alias("x"), (F.col(y) / n).alias("y"), (F.col(z) / n).alias("z"))
    s = d.groupBy(point).agg(F.sum(1 - F.col("x") ** 2).alias("a"), F.sum(1 - F.col("y") ** 2).alias("d"), F.sum(1 - F.col("z") ** 2).alias("f"), F.sum(-F.col("x") * F.col("y")).alias("b"), F.sum(-F.col("x") * F.col("z")).alias("c"), F.sum(-F.col("y") * F.col("z")).alias("e"))
    det = F.expr("a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)")
    trace = F.expr("(d * f - e * e) + (a * f - c * c) + (a * d - b * b)")
    return s.select(point, F.when(det > 1e-9, trace / det).otherwise(float("inf")).alias("score"))


def lowest_share(rows: DataFrame, key: str, score: str, percent: float) -> DataFrame:
    """The floor(n * percent / 100) rows with the lowest (score, key)."""
    n = rows.count()
    return ranked(rows, [score, key], "_rank").where(F.col("_rank") <= int(n * percent // 100)).drop("_rank")


def kernel_density(points: DataFrame, group: str, key: str, x: str, y: str, sigma: float, blind: float, reach_sigmas: float = 6.0) -> DataFrame:
    """``(group, key, density)``: sum of exp(-d^2 / 2 sigma^2) over the points of the group, but for those between 1e-7 and
    ``blind``. Points farther than ``reach_sigmas`` are left out: each would add less than exp(-18) = 1.6e-8.
    Rows that repeat a key are added up.

    Points of one place are one row with their number; places meet in grid cells as wide as the reach.
    """
    reach = reach_sigmas * sigma
    cell = lambda c: F.floor(F.col(c) / reach)
    places = points.groupBy(group, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_n"))
    a = places.select(group, "_x", "_y", cell("_x").alias("_cx"), cell("_y").alias("_cy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = places.select(group, F.col("_x").alias("_u"), F.col("_y").alias("_v"), "_n", cell("_x").alias("_cu"), cell("_y").alias("_cv"), around.alias("o"))
    b = b.select(group, "_u", "_v", "_n", (F.col("_cu") + F.col("o.i")).alias("_cx"), (F.col("_cv") + F.col("o.j")).alias("_cy"))
    d2 = (F.col("_x") - F.col("_u")) ** 2 + (F.col("_y") - F.col("_v")) ** 2
    d = F.sqrt(d2)
    hit = a.join(b, [group, "_cx", "_cy"]).where((d <= reach) & ((d >= blind) | (d <= 1e-7)))
    at = hit.groupBy(group, "_x", "_y").agg(F.sum(F.col("_n") * F.exp(-d2 / (2 * sigma * sigma))).alias("density"))
    own = points.select(group, key, F.col(x).alias("_x"), F.col(y).alias("_y")).join(at, [group, "_x", "_y"])
    return own.groupBy(group, key).agg(F.sum("density").alias("density"))


def best_source(rows: DataFrame, target: str, source: str, certainty: str) -> DataFrame:
    """Of each target the row with the highest certainty, ties to the smallest source."""
    best = F.max(F.struct(F.col(certainty).alias("c"), (-F.col(source)).alias("s")))
    return rows.groupBy(target).agg(best.alias("b")).select(target, (-F.col("b.s")).alias(source), F.col("b.c").alias(certainty))


def scene_report(rows: DataFrame, scene: str, target: str, error: str, thresholds: list[float]) -> DataFrame:
    """``(scene, threshold, mean_auc, pooled_auc, targets)``: the mean of the targets' curves, and the curve of all of a
    scene's errors together."""
    each = error_auc(rows, [scene, target], error, thresholds)
    mean = each.groupBy(scene, "threshold").agg(F.avg("auc").alias("mean_auc"), F.count("*").alias("targets"))
    pooled = error_auc(finite(rows, error), [scene], error, thresholds).select(scene, "threshold", F.col("auc").alias("pooled_auc"))
    return mean.join(pooled, [scene, "threshold"])


def auc_errors(full: DataFrame, windowed: DataFrame, by: str, name: str, penalty: float | None = MISSING) -> DataFrame:
    """``(by, window, name, error)``: the errors that the curves of a trajectory are made of; ``window`` is null for the whole trajectory.

    ``full``: ``by``, ``name``, ``error``, ``have`` (whether the pose was estimated) and the trajectory's ``path_length``, a row for each expected name;
    ``windowed``: ``by``, ``window``, ``name``, ``error``. Errors over the whole trajectory are taken over its path length; those not finite, and
    trajectories without a length, are left out. With a ``penalty`` it stands for every name not estimated, and in each window that its trajectory has for
    every expected name without an error there; without one such names are left out of windows.
    """
    whole = full.select(F.col(by).alias("by"), F.col(name).alias("name"), F.col("error").cast("double").alias("error"), F.coalesce("have", F.lit(False)).alias("have"), F.col("path_length").alias("length"))
    value = F.col("error") if penalty is None else F.when(F.col("have"), F.col("error")).otherwise(F.lit(float(penalty)))
    over = finite(whole.where("length > 0").withColumn("error", value), "error").select("by", F.lit(None).cast("double").alias("window"), "name", (F.col("error") / F.col("length")).alias("error"))
    own = windowed.select(F.col(by).alias("by"), F.col("window").cast("double").alias("window"), F.col(name).alias("name"), F.col("error").cast("double").alias("error"))
    out = over.unionByName(own)
    if penalty is not None:
        due = own.select("by", "window").distinct().join(whole.select("by", "name").distinct(), "by")
        out = out.unionByName(due.join(own.select("by", "window", "name"), ["by", "window", "name"], "left_anti").withColumn("error", F.lit(float(penalty))))
    return out.select(F.col("by").alias(by), "window", F.col("name").alias(name), "error")


def report_lines(rows: DataFrame, cases: DataFrame, scene: str, target: str, error: str, thresholds: list[float]) -> DataFrame:
    """``(scene, threshold, percent, completed, failed)``: the mean over a scene's targets of their curves in per cent, at all thresholds but the
    last, which only bounds the curve; and how many of the scene's ``cases`` (``scene``, ``completed``) are done. A scene without errors has no line."""
    each = error_auc(rows, [scene, target], error, thresholds).where(F.col("threshold") < float(max(thresholds)))
    mean = each.groupBy(scene, "threshold").agg((F.avg("auc") * 100).alias("percent"))
    done = cases.groupBy(F.col(scene).alias("_scene")).agg(F.count_if(F.col("completed")).alias("completed"), F.count_if(~F.coalesce("completed", F.lit(False))).alias("failed"))
    return mean.join(done, F.col(scene).eqNullSafe(F.col("_scene")), "left").select(scene, "threshold", "percent", F.coalesce("completed", F.lit(0)).alias("completed"), F.coalesce("failed", F.lit(0)).alias("failed"))


def summed_counts(counts: DataFrame, scene: str, key: str, value: str) -> DataFrame:
    """``(scene, key, total, trajectories)``: each count summed over a scene's trajectories, and over how many that is; nulls count for neither."""
    return counts.where(F.col(value).isNotNull()).groupBy(scene, key).agg(F.sum(value).cast("bigint").alias("total"), F.count("*").alias("trajectories"))


def difficulty(name: Column) -> Column:
    """easy, medium, hard or other, by what the name contains."""
    low = F.lower(name)
    return F.when(low.contains("easy"), "easy").when(low.contains("medium"), "medium").when(low.contains("hard") | low.contains("difficult"), "hard").otherwise("other")
