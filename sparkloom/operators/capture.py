"""Checked selections of images, frames, pairs and cameras, and summaries of a scene, as table operators.

A rule that data break is an error: it is raised when the result is read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import rotations as rt
from sparkloom.functions import scalars as sc
from sparkloom.functions.scalars import rotated
from sparkloom.operators import content
from sparkloom.operators.pairs import in_tiles, require
from sparkloom.operators.ranks import ranked
from sparkloom.operators.topk import natural_key

#: The pose that stands for "not available" in published files.
NO_ROTATION, NO_TRANSLATION = (0.0, 0.0, 0.0, -1.0), (0.0, 0.0, 0.0)
IMAGE_SUFFIXES = ("jpg", "jpeg", "png")


def has_public_pose(q: list[Column], t: list[Column]) -> Column:
    """Whether a pose (quaternion x, y, z, w and translation) is there and is not the exact marker of a missing one."""
    same = F.lit(True)
    for c, x in zip((*q, *t), (*NO_ROTATION, *NO_TRANSLATION)):
        same = same & (c == x)
    return ~F.coalesce(same, F.lit(True))


def selected_images(names: DataFrame, name: str, present: DataFrame, camera_dir: str | None = None) -> DataFrame:
    """``(name, rank)`` in natural order. Names must be safe relative paths with an image's suffix, of ``camera_dir`` if
    given, each once, in ``present`` (same column), and there must be one."""
    c = F.col(name)
    parts = F.split(c, "/")
    unsafe = c.isNull() | c.contains("\\") | F.exists(parts, lambda p: p.isin("", ".", ".."))
    bad = unsafe | ~F.lower(F.regexp_extract(c, r"[^/]\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES)
    if camera_dir is not None:
        bad = bad | (parts[0] != camera_dir)
    problems = names.where(F.coalesce(bad, F.lit(True))).select(F.lit("bad name").alias("problem"))
    problems = problems.unionByName(names.groupBy(name).count().where("count > 1").select(F.lit("name repeats").alias("problem")))
    problems = problems.unionByName(names.join(present.select(name).distinct(), name, "left_anti").select(F.lit("no such file").alias("problem")))
    problems = problems.unionByName(names.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("nothing selected").alias("problem")))
    order = ranked(names.select(name, natural_key(c).alias("_natural")), ["_natural", name])
    return require(order.select(name, "rank"), problems, "the image selection is not sound")


def cross_reference_violations(matches: DataFrame, images: DataFrame) -> DataFrame:
    """``(problem, n)`` of matches ``(img1, feat1, img2, feat2, score)`` against images ``(image, features)``: images that are not there, features
    at or beyond the image's number of them or below 0, and scores that are not finite."""
    side = lambda i: images.select(F.col("image").alias(f"img{i}"), F.col("features").alias(f"_n{i}"))
    j = matches.join(side(1), "img1", "left").join(side(2), "img2", "left")
    outside = (F.col("feat1") < 0) | (F.col("feat1") >= F.col("_n1")) | (F.col("feat2") < 0) | (F.col("feat2") >= F.col("_n2"))
    odd = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    found = [("image", F.col("_n1").isNull() | F.col("_n2").isNull()), ("feature", F.coalesce(outside, F.lit(False))), ("score", odd)]
    each = j.select(F.explode(F.array(*[F.when(bad, kind) for kind, bad in found])).alias("problem")).where("problem is not null")
    return each.groupBy("problem").agg(F.count("*").alias("n"))


def existing_files(wanted: DataFrame, present: DataFrame, path: str) -> DataFrame:
    """``(path, basename)`` of the wanted files that are there; two of one basename are an error."""
    base = F.element_at(F.split(path, "/"), -1)
    kept = wanted.select(path).distinct().join(present.select(path).distinct(), path, "left_semi").withColumn("basename", base)
    return require(kept, kept.groupBy("basename").count().where("count > 1"), "a basename repeats")


def whole_frames(images: DataFrame, selection: DataFrame, image: str, frame: str) -> DataFrame:
    """``images`` that are selected, without poses' columns (all but image, frame and those named ``*_id``). A selection that names an unknown image, or
    a part of a frame only, is an error."""
    chosen = selection.select(image).distinct()
    kept = images.join(chosen, image, "left_semi")
    unknown = chosen.join(images, image, "left_anti").select(F.lit("unknown image").alias("problem"))
    left = images.join(chosen, image, "left_anti").join(kept.select(frame).distinct(), frame, "left_semi").select(F.lit("part of a frame").alias("problem"))
    columns = [c for c in images.columns if c in (image, frame) or c.endswith("_id")]
    return require(kept.select(*columns), unknown.unionByName(left), "the selection does not keep whole frames")


def surviving_tracks(
    points: DataFrame, by: str, order: list[str], x: str, y: str, confidence: str, var_x: str, var_y: str, size: tuple[float, float], least: float, sigma: float | None
) -> DataFrame:
    """Points inside the image (from -0.5 on, before size - 0.5), with a confidence over ``least`` and the root of the covariance's trace at most
    ``sigma``, with ``id``: their number in ``order`` within ``by``, from 0 on. Nulls and NaN do not survive."""
    keep = (F.col(x) >= -0.5) & (F.col(x) < size[0] - 0.5) & (F.col(y) >= -0.5) & (F.col(y) < size[1] - 0.5)
    keep = keep & (F.col(confidence) > least) & ~F.isnan(x) & ~F.isnan(y) & ~F.isnan(confidence)
    if sigma is not None:
        spread = F.sqrt(F.greatest(F.col(var_x) + F.col(var_y), F.lit(0.0)))
        keep = keep & (spread <= sigma) & ~F.isnan(spread)
    at = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return points.where(keep).withColumn("id", at.cast("bigint"))


def frame_sequence(capture: DataFrame, allocated: DataFrame, frame: str, order: list[str]) -> DataFrame:
    """``(frame, ordinal)``: allocated frames in the order of capture, from 0 on. Every allocated frame must have been captured, once."""
    want = allocated.select(frame).distinct()
    kept = capture.select(frame, *[o for o in order if o != frame]).join(want, frame, "left_semi")
    missing = want.join(capture, frame, "left_anti").select(F.lit("not captured").alias("problem"))
    twice = kept.groupBy(frame).count().where("count > 1").select(F.lit("captured twice").alias("problem"))
    found = ranked(kept, [*order, frame] if frame not in order else order, "ordinal")
    return require(found.select(frame, (F.col("ordinal") - 1).alias("ordinal")), missing.unionByName(twice), "the frame sequence is not that of the capture")


def _linspace(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    numbered = rows.withColumn("_n", n).withColumn("_m", F.count("*").over(Window.partitionBy(*by)))
    step = F.col("_n") * (most - 1)  # i * (m - 1) / (most - 1), cut to a whole number, is n for some i
    if most == 1:
        return numbered.where("_n = 0").drop("_n", "_m")
    i = F.ceil(step / F.greatest(F.col("_m") - 1, F.lit(1)))
    hit = F.floor(i * (F.col("_m") - 1) / (most - 1)) == F.col("_n")
    return numbered.where((F.col("_m") <= most) | hit & (i <= most - 1)).drop("_n", "_m")


def even_calibration_matches(pairs: DataFrame, matches: DataFrame, excluded: DataFrame, pair: str, match: str, most_pairs: int, most_matches: int) -> DataFrame:
    """``(camera, pair, match)``: of each camera at most ``most_pairs`` pairs ``(pair, camera1, camera2, valid)``, evenly spaced by ``pair``, and of each of
    these at most ``most_matches`` matches, evenly spaced by ``match``. Pairs must be valid, not excluded, and have both images from one camera."""
    own = pairs.where("valid and camera1 = camera2").join(excluded.select(pair).distinct(), pair, "left_anti")
    chosen = _linspace(own.select(F.col("camera1").alias("camera"), pair), ["camera"], [pair], most_pairs)
    return _linspace(matches.select(pair, match).join(chosen, pair), [pair], [match], most_matches).select("camera", pair, match)


def initial_focals(predictions: DataFrame, by: str, fx: str, fy: str, same: list[str]) -> DataFrame:
    """``(by, focal, n, same...)``: the median of (fx + fy) / 2; cameras of one group must agree in the columns ``same``."""
    g = predictions.groupBy(by).agg(F.median((F.col(fx) + F.col(fy)) / 2).alias("focal"), F.count("*").alias("n"), F.count_distinct(F.struct(*same)).alias("_k"), *[F.min(c).alias(c) for c in same])
    ok = F.when(F.col("_k") > 1, F.raise_error(F.lit("cameras differ in model or size")).cast("boolean")).otherwise(F.lit(True))
    return g.where(ok).drop("_k")


def focal_priors(observations: DataFrame, cameras: DataFrame, images: DataFrame) -> DataFrame:
    """``(camera, rows)``: for each camera its images' (mean focal, least deviation over focal), in image order.

    ``observations``: ``(image, camera, fx, fy, std, width, height)``, ``std`` an array; ``cameras``: ``(camera, width, height)``; ``images``: ``(image, camera,
    position)``. Observations must be one for each image, of its camera, in its size.
    """
    i = images.select("image", F.col("camera").alias("_c"), "position")
    c = cameras.select("camera", F.col("width").alias("_w"), F.col("height").alias("_h"))
    j = observations.join(i, "image", "full_outer").join(c, "camera", "left")
    fine = (F.col("_c") == F.col("camera")) & (F.col("_w") == F.col("width")) & (F.col("_h") == F.col("height"))
    bad = j.where(~F.coalesce(fine, F.lit(False))).select(F.lit("membership or size").alias("problem"))
    bad = bad.unionByName(observations.groupBy("image").count().where("count > 1").select(F.lit("image repeats").alias("problem")))
    focal = (F.col("fx") + F.col("fy")) / 2
    row = F.struct("position", focal.alias("focal"), (F.array_min("std") / focal).alias("sigma"))
    listed = F.transform(F.array_sort(F.collect_list(row)), lambda r: F.struct(r["focal"].alias("focal"), r["sigma"].alias("sigma")))
    return require(j.groupBy("camera").agg(listed.alias("rows")), bad, "observations disagree with the cameras")


def first_seen(tracks: DataFrame, point: str, ordinal: str, ordinals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(point, first, position)`` in order of (first, point) from 0 on, and ``(ordinal, n, start)`` for every keyframe of ``ordinals``: how many points are first
    seen there, and the position of the first. Points that no keyframe sees are left out."""
    seen = tracks.join(ordinals.select(ordinal).distinct(), ordinal, "left_semi").groupBy(point).agg(F.min(ordinal).alias("first"))
    order = ranked(seen, ["first", point], "position").withColumn("position", F.col("position") - 1)
    n = seen.groupBy(F.col("first").alias(ordinal)).agg(F.count("*").alias("n"))
    full = ordinals.select(ordinal).distinct().join(n, ordinal, "left").na.fill(0, ["n"])
    return order, ranked(full, [ordinal], "_r", "_upto", "n").select(ordinal, "n", (F.col("_upto") - F.col("n")).alias("start"))


def covariance_ranks(points: DataFrame, key: str, score: str) -> DataFrame:
    """``(key, rank)``: from 0 on by (score, key); -1 where the score is null or NaN."""
    good = ranked(points.where(F.col(score).isNotNull() & ~F.isnan(score)).select(key, score), [score, key], "_r").select(key, (F.col("_r") - 1).alias("_r"))
    return points.select(key).join(good, key, "left").select(key, F.coalesce("_r", F.lit(-1).cast("bigint")).alias("rank"))


def name_token(name: Column) -> Column:
    """The number that a file's name begins with, as text; null if it begins with none that ends there or at '-' or '_'."""
    stem = F.regexp_replace(F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1), r"\.[^.]*$", "")
    return F.nullif(F.regexp_extract(stem, r"^(\d+(?:\.\d+)?)(?:[-_]|$)", 1), F.lit(""))


def image_timelines(images: DataFrame, by: str, image: str, name: str) -> DataFrame:
    """``(by, image, position, seconds)``: the images of a stream by the numbers in their names if all have one, else by id.

    Seconds count from the first image; they are null where times do not rise or their unit is not plain. The unit is 1 s with a decimal point; else, if all
    numbers have 10, 13, 16 or 19 digits, that of this width, if the upper-middle step is then 0.001 s to 10 s; else the only one of
    1, 10^3, 10^6 and 10^9 that makes it so. Without times the order is that of the ids.
    """
    unit = {10: 1.0, 13: 1e3, 16: 1e6, 19: 1e9}
    rows = images.select(by, image, name, name_token(F.col(name)).alias("_t")).withColumn("_v", F.col("_t").cast("double"))
    g = rows.groupBy(by).agg(
        F.bool_and(F.col("_t").isNotNull()).alias("_all"), F.coalesce(F.bool_or(F.col("_t").contains(".")), F.lit(False)).alias("_point"),
        F.min(F.length("_t")).alias("_lo"), F.max(F.length("_t")).alias("_hi"), F.min("_v").alias("_first"), F.count("*").alias("_n"),
    )
    w = Window.partitionBy(by).orderBy("_v", name)
    steps = rows.select(by, (F.col("_v") - F.lag("_v").over(w)).alias("_d")).where("_d is not null")
    k = F.row_number().over(Window.partitionBy(by).orderBy("_d"))
    middle = steps.withColumn("_k", k).withColumn("_m", F.count("*").over(Window.partitionBy(by))).withColumn("_least", F.min("_d").over(Window.partitionBy(by)))
    middle = middle.where("_k = floor(_m / 2) + 1").select(by, F.col("_d").alias("_median"), "_least")
    j = g.join(middle, by, "left")
    wide = F.lit(None).cast("double")
    for digits, u in unit.items():
        wide = F.when((F.col("_lo") == digits) & (F.col("_hi") == digits), u).otherwise(wide)
    first = F.lit(None).cast("double")
    for digits, u in unit.items():
        first = F.when(F.col("_lo") == digits, u).otherwise(first)
    fits = lambda u: F.coalesce((F.col("_median") / u >= 0.001) & (F.col("_median") / u <= 10), F.lit(False))
    only = F.filter(F.array(*[F.lit(u) for u in unit.values()]), fits)
    scale = F.when(F.col("_point"), 1.0).when(F.col("_n") == 1, first).when(fits(wide), wide).when(F.size(only) == 1, F.try_element_at(only, F.lit(1)))
    scale = F.when(F.col("_all") & ((F.col("_n") == 1) | (F.col("_least") > 0)), scale)
    told = rows.join(j.select(by, scale.alias("_scale"), "_first"), by)
    timed = F.col("_scale").isNotNull()
    order = Window.partitionBy(by).orderBy(F.when(timed, F.col("_v")), F.when(timed, F.col(name)), image)
    return told.select(by, image, (F.row_number().over(order) - 1).cast("bigint").alias("position"), ((F.col("_v") - F.col("_first")) / F.col("_scale")).alias("seconds"))


def fixed_stereo_poses(pairs: DataFrame, images: DataFrame, sensors: DataFrame) -> DataFrame:
    """``(first, second, qx, qy, qz, qw, tx, ty, tz)`` of pairs within one frame: the second camera's pose relative to the first's, from the rig.

    ``images``: ``(image, frame, rig, camera)``; ``sensors``: ``(rig, camera, has_prior, is_ref, q, t)`` with pose from the rig as arrays (x, y, z, w) and
    (x, y, z); the reference sensor stands at the origin. Two images of one camera, a camera without focal prior, and a pose that is missing, not finite or
    not of unit length within 1e-8 are errors. Pairs of different frames are left out.
    """
    side = lambda n: images.select(F.col("image").alias(n), F.col("frame").alias(f"_f{n}"), F.col("rig").alias("_rig"), F.col("camera").alias(f"_c{n}"))
    j = pairs.select("first", "second").join(side("first"), "first").join(side("second").drop("_rig"), "second").where("_ffirst = _fsecond")
    for n in ("first", "second"):
        s = sensors.select(F.col("rig").alias("_rig"), F.col("camera").alias(f"_c{n}"), F.col("has_prior").alias(f"_p{n}"), F.when(F.col("is_ref"), F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0)))).otherwise(F.col("q")).alias(f"_q{n}"), F.when(F.col("is_ref"), F.array(*[F.lit(0.0)] * 3)).otherwise(F.col("t")).alias(f"_t{n}"))
        j = j.join(s, ["_rig", f"_c{n}"], "left")
    sound = F.col("_cfirst") != F.col("_csecond")
    for n in ("first", "second"):
        norm = F.sqrt(F.aggregate(f"_q{n}", F.lit(0.0), lambda a, x: a + x * x))
        finite = F.forall(F.concat(f"_q{n}", f"_t{n}"), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
        sound = sound & F.col(f"_p{n}") & finite & (F.abs(norm - 1) <= 1e-8)
    ok = F.when(F.coalesce(sound, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a same-frame pair has no fixed sensor poses")).cast("boolean"))
    a, b = [F.col("_qfirst")[i] for i in range(4)], [F.col("_qsecond")[i] for i in range(4)]
    return j.where(ok).select("first", "second", *_relative(a, [F.col("_tfirst")[i] for i in range(3)], b, [F.col("_tsecond")[i] for i in range(3)]))


def _relative(a: list[Column], at: list[Column], b: list[Column], bt: list[Column]) -> list[Column]:
    """``qx`` to ``tz`` of the pose ``b, bt`` relative to ``a, at``."""
    ax, ay, az, aw = -a[0], -a[1], -a[2], a[3]  # second * inverse of first
    bx, by, bz, bw = b
    q = [bw * ax + bx * aw + by * az - bz * ay, bw * ay - bx * az + by * aw + bz * ax, bw * az + bx * ay - by * ax + bz * aw, bw * aw - bx * ax - by * ay - bz * az]
    back = rotated(q, at)
    t = [bt[i] - back[i] for i in range(3)]
    return [c.alias(n) for c, n in zip([*q, *t], ("qx", "qy", "qz", "qw", "tx", "ty", "tz"))]


def fixed_frame_poses(images: DataFrame, sensors: DataFrame) -> DataFrame:
    """:func:`fixed_stereo_poses` of all pairs of every frame, ``first`` below ``second``; two rigs in a frame are an error too.

    Poses are joined and tested once an image, not once a pair, and pairs are made in tiles (:func:`pairs.in_tiles`), never shuffled.
    """
    origin = F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))), F.array(*[F.lit(0.0)] * 3)
    pose = [F.when(F.col("is_ref"), o).otherwise(F.col(c)).alias(f"_{c}") for o, c in zip(origin, "qt")]
    own = sensors.select(F.col("rig").alias("_rig"), F.col("camera").alias("_camera"), "has_prior", *pose)
    placed = images.where("frame is not null and image is not null").join(own, (F.col("rig") == F.col("_rig")) & (F.col("camera") == F.col("_camera")), "left")
    norm = F.sqrt(F.aggregate("_q", F.lit(0.0), lambda a, x: a + x * x))
    finite = F.forall(F.concat("_q", "_t"), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(F.col("has_prior") & finite & (F.abs(norm - 1) <= 1e-8), F.lit(False))
    parts = [*[F.col("_q")[i].alias(f"q{i}") for i in range(4)], *[F.col("_t")[i].alias(f"t{i}") for i in range(3)]]
    a, b = in_tiles(placed.select(F.col("frame").alias("block"), F.col("image").alias("key"), "rig", "camera", sound.alias("sound"), *parts))
    a, b = a.alias("a"), b.hint("merge").alias("b")
    met = (F.col("a.block") == F.col("b.block")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    held = F.col("a.sound") & F.col("b.sound") & (F.col("a.camera") != F.col("b.camera")) & (F.col("a.rig") == F.col("b.rig"))
    ordered = F.when(F.col("a.key") >= F.col("b.key"), F.lit(False))  # part of the test, as Spark may test parts of a condition in any order
    ok = ordered.when(F.coalesce(held, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a same-frame pair has no fixed sensor poses")).cast("boolean"))
    side = lambda n, c, m: [F.col(f"{n}.{c}{i}") for i in range(m)]
    pairs = a.join(b, met).where(ok)
    return pairs.select(F.col("a.key").alias("first"), F.col("b.key").alias("second"), *_relative(side("a", "q", 4), side("a", "t", 3), side("b", "q", 4), side("b", "t", 3)))


def path_up(centres: DataFrame, by: str, x: str, y: str, z: str) -> DataFrame:
    """``(by, ux, uy, uz)``: the unit direction in which the centres spread least, its largest part above 0; (0, 0, 1) for fewer than three.

    Nine sums a group are made on the rows; only they go to the numeric part.
    """
    c = [F.col(x), F.col(y), F.col(z)]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = centres.groupBy(by).agg(F.count("*").alias("n"), *[F.covar_pop(c[i], c[j]).alias(f"s{i}{j}") for i, j in pairs])

    def run(batches):
        for g in batches:
            m = np.zeros((len(g), 3, 3))
            for i, j in pairs:
                m[:, i, j] = m[:, j, i] = g[f"s{i}{j}"]
            up = np.linalg.eigh(m)[1][:, :, 0]
            top = np.take_along_axis(up, np.abs(up).argmax(1)[:, None], 1)
            up = np.where(top < 0, -up, up)
            up[g["n"].to_numpy() < 3] = (0.0, 0.0, 1.0)
            yield pd.DataFrame({by: g[by], "ux": up[:, 0], "uy": up[:, 1], "uz": up[:, 2]})

    return sums.mapInPandas(run, f"{by} {centres.schema[by].dataType.simpleString()}, ux double, uy double, uz double")


def extents(points: DataFrame, by: str, xyz: list[str], axes: dict[str, tuple[float, float, float]]) -> DataFrame:
    """``(by, axis...)``: how far the points' projections on each axis reach from the least to the greatest."""
    along = {n: sum((F.col(c) * a for c, a in zip(xyz[1:], v[1:])), F.col(xyz[0]) * v[0]) for n, v in axes.items()}
    return points.groupBy(by).agg(*[(F.max(p) - F.min(p)).alias(n) for n, p in along.items()])


INTRINSICS = ("fx", "fy", "cx", "cy", "width", "height")


def inferred_turns(cameras: DataFrame, targets: DataFrame, key: str, focal_tolerance: float = 1e-9, centre_tolerance: float = 1e-9) -> DataFrame:
    """``(key, turns)``: the clockwise quarter turns of the image that take each camera's intrinsics to its target's.

    Both have ``key`` and ``INTRINSICS``. Each camera is joined to its four turned forms; exactly one must have the target's size, and its
    focal lengths and principal point within the tolerances, else the query fails. Keys of one side only are left out.
    """
    a, b = cameras.select(key, *INTRINSICS), targets.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in INTRINSICS])
    own = [F.col(c).cast("double") for c in INTRINSICS]
    forms = F.array(*[F.struct(F.lit(k).alias("turns"), *[c.alias(n) for c, n in zip(sc.quarter_turned(*own, -k % 4), INTRINSICS)]) for k in range(4)])
    each = a.join(b, F.col(key) == F.col("_key")).select(key, *[f"_{c}" for c in INTRINSICS], F.explode(forms).alias("f"))
    same = (F.col("f.width") == F.col("_width")) & (F.col("f.height") == F.col("_height"))
    for c, tolerance in (("fx", focal_tolerance), ("fy", focal_tolerance), ("cx", centre_tolerance), ("cy", centre_tolerance)):
        same = same & (F.abs(F.col(f"f.{c}") - F.col(f"_{c}")) <= tolerance)
    fits = each.groupBy(key).agg(F.count_if(same).alias("_n"), F.max(F.when(same, F.col("f.turns"))).alias("turns"))
    fail = F.raise_error(F.concat(F.lit("not exactly one quarter turn fits: "), F.col(key).cast("string"), F.lit(" has "), F.col("_n").cast("string"))).cast("int")
    return fits.select(key, F.when(F.col("_n") == 1, F.col("turns")).otherwise(fail).alias("turns"))


def official_poses(records: DataFrame, cameras: DataFrame, images: DataFrame, pinned: str | None = None, centre_tolerance: float = 1 + 1e-9) -> DataFrame:
    """``(name, turns, q, t)``: for each image with a record its world-to-camera pose, turned like the image.

    ``records``: ``name``, ``camera``, and the pose ``q`` (x, y, z, w), ``t``; ``cameras``: ``camera`` and ``INTRINSICS``; ``images``: ``name`` and the
    intrinsics that it has now. Names must be unique; the digest of all records in the order of their names must be ``pinned``, if
    given; each image needs exactly one fitting quarter turn. Records without an image are left out.
    """
    twice = records.groupBy("name").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"a name has several poses: {twice[0]['name']}")
    if pinned is not None:
        found = content.table_summary(records.select("name", "q", "t"), ["name"], places=15).first()["sha256"]
        if found != pinned:
            raise ValueError("the poses differ from the pinned ones")
    own = records.join(images.select("name"), "name", "left_semi")
    raw = own.select("name", F.col("camera").alias("_camera")).join(cameras, F.col("_camera") == F.col("camera")).select("name", *INTRINSICS)
    turns = inferred_turns(raw, images, "name", centre_tolerance=centre_tolerance)
    half = F.col("turns") * (3.141592653589793 / 4)
    image = F.array(F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half))
    turned = own.join(turns, "name").withColumn("_image", image)
    return turned.select("name", "turns", rt.product(F.col("_image"), rt.unit(F.col("q"))).alias("q"), rt.turned(F.col("_image"), F.col("t")).alias("t"))


def mapping_timeline(sequence: DataFrame, frames: DataFrame, rigs: DataFrame, images: DataFrame, by: str) -> DataFrame:
    """``(by, ordinal, first, second)``: the images of each sensor in neighbouring frames of a stream, by the later frame's ordinal.

    ``sequence``: ``by``, ``ordinal``, ``frame``, ``time`` (null in all rows of a stream, or in none); ``frames``: ``by``, ``frame``, ``rig``; ``rigs``: ``by``, ``rig``,
    ``sensor``; ``images``: ``by``, ``frame``, ``sensor``, ``image``, ``camera``. The query fails unless a stream's frames are there once each, with numbers from 0 to
    2 ** 32 - 2, and are those of ``frames``; times increase; a frame has one image for each sensor of its rig and no other; and
    neighbouring frames have as many images, of the same cameras if there is more than one.
    """
    def fails(why: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{why}: stream "), F.coalesce(F.col("by").cast("string"), F.lit("null")))).cast("boolean")

    def must(ok: Column, why: str) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(fails(why))

    named = lambda df, *cols: df.select(F.col(by).alias("by"), *cols)
    order = named(sequence, F.col("ordinal"), F.col("frame").cast("bigint").alias("frame"), F.col("time").cast("bigint").alias("time"))
    known = named(frames, F.col("frame").cast("bigint").alias("frame"), "rig").groupBy("by", "frame").agg(F.max("rig").alias("rig"), F.count("*").alias("frames"))
    both = order.groupBy("by", "frame").agg(F.count("*").alias("n"), F.min("ordinal").alias("ordinal"), F.max("time").alias("time")).join(known, ["by", "frame"], "full")
    both = both.where(must((F.col("n") == 1) & (F.col("frames") == 1), "the sequence must have every frame once")).where(must(F.col("frame").between(0, 2**32 - 2), "a frame number is out of range"))
    wanted = named(rigs, "rig", "sensor").distinct().groupBy("by", "rig").agg(F.array_sort(F.collect_list("sensor")).alias("sensors"))
    held = named(images, F.col("frame").cast("bigint").alias("frame"), F.struct("sensor", "image", "camera").alias("one")).groupBy("by", "frame").agg(F.array_sort(F.collect_list("one")).alias("held"))
    rows = both.join(wanted, ["by", "rig"], "left").join(held, ["by", "frame"], "left")
    rows = rows.where(must(F.transform("held", lambda h: h["sensor"]) == F.col("sensors"), "a frame must have its rig's images"))
    w = Window.partitionBy("by").orderBy("ordinal")
    before = rows.select("by", "ordinal", "time", "held", F.lag("held").over(w).alias("prior"), F.lag("time").over(w).alias("since"), F.lag("ordinal").over(w).alias("was")).where("was is not null")
    timed = (F.col("time").isNull() & F.col("since").isNull()) | (F.col("time") > F.col("since"))
    cameras = lambda c: F.transform(c, lambda h: h["camera"])
    same = (F.size("held") == F.size("prior")) & ((F.size("held") == 1) | (cameras("held") == cameras("prior")))
    sound = before.where(must(timed & (F.col("ordinal") > F.col("was")), "times must increase, or be left out of the whole stream")).where(must(same, "neighbouring frames must have the same cameras"))
    pairs = F.transform(F.arrays_zip("prior", "held"), lambda p: F.struct(p["prior"]["image"].alias("first"), p["held"]["image"].alias("second")))
    return sound.select(F.col("by").alias(by), "ordinal", F.explode(pairs).alias("p")).select(by, "ordinal", "p.first", "p.second")
