"""Operators on match graphs: tracks, reachability, bridging and closure, over long edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import rotations as rt
from sparkloom.functions import scalars as sc
from sparkloom.operators.components import connected_components
from sparkloom.session import stored


def observation(image: Column, feature: Column) -> Column:
    """One whole number for (image, feature); images under 2^31, features under 2^32."""
    return F.shiftleft(image.cast("bigint"), 32).bitwiseOR(feature.cast("bigint"))


def tracks(matches: DataFrame, a: str, b: str) -> DataFrame:
    """``(obs, track)``: observations joined by matches; the track is its least observation."""
    return connected_components(matches, a, b).select(F.col("node").alias("obs"), F.col("component").alias("track"))


def consistent(members: DataFrame, track: str, image: str, x: str, y: str, reach: float, least: int) -> DataFrame:
    """Members of tracks without two points of one image farther apart than ``reach`` (10.0 of 10 stays) and with ``least`` images or more.

    A point too far exists in a group only if one is too far from some extreme one, so groups whose extent is
    within reach pass by minima and maxima alone; only the others' points are compared.
    """
    box = members.groupBy(track, image).agg(((F.max(x) - F.min(x)) ** 2 + (F.max(y) - F.min(y)) ** 2).alias("_d"))
    wide = box.where(F.col("_d") > reach * reach).select(track, image)
    p = members.join(wide, [track, image], "left_semi").select(track, image, x, y).distinct()
    q = p.select(track, image, F.col(x).alias("_u"), F.col(y).alias("_v"))
    bad = p.join(q, [track, image]).where((F.col(x) - F.col("_u")) ** 2 + (F.col(y) - F.col("_v")) ** 2 > reach * reach).select(track).distinct()
    views = members.groupBy(track).agg(F.count_distinct(image).alias("_n")).where(F.col("_n") >= least).select(track)
    return members.join(bad, track, "left_anti").join(views, track, "left_semi")


def loop_observations(obs_tracks: DataFrame, loops: DataFrame, a: str, b: str) -> DataFrame:
    """``(track, obs, anchor)`` of loop-closure matches: each end is seen from the other's track. An end without a track is
    a track of its own, named by the observation; matches within one track are dropped."""
    t = lambda c, to: obs_tracks.select(F.col("obs").alias(c), F.col("track").alias(to))
    j = loops.select(a, b).distinct().join(t(a, "_ta"), a, "left").join(t(b, "_tb"), b, "left")
    j = j.withColumn("_ta", F.coalesce("_ta", a)).withColumn("_tb", F.coalesce("_tb", b)).where("_ta <> _tb")
    both = F.explode(F.array(F.struct(F.col("_ta").alias("track"), F.col(b).alias("obs"), F.col(a).alias("anchor")), F.struct(F.col("_tb").alias("track"), F.col(a).alias("obs"), F.col(b).alias("anchor"))))
    return j.select(both.alias("x")).select("x.*").distinct()


def filtered_tracks(members: DataFrame, track: str, image: str, registered: DataFrame, low: int, high: int, depth_ok: Column) -> DataFrame:
    """``(track, n, n_registered)``: tracks of ``low`` to ``high`` observations, ``low`` or more of them in registered images;
    tracks seen in only two images need valid depth everywhere."""
    j = members.join(registered.select(image).distinct().withColumn("_reg", F.lit(True)), image, "left")
    n = j.groupBy(track).agg(F.count("*").alias("n"), F.count("_reg").alias("n_registered"), F.count_distinct(image).alias("_views"), F.bool_and(F.coalesce(depth_ok, F.lit(False))).alias("_deep"))
    return n.where((F.col("n") >= low) & (F.col("n") <= high) & (F.col("n_registered") >= low) & ((F.col("_views") > 2) | F.col("_deep"))).select(track, "n", "n_registered")


def problem_tracks(members: DataFrame, images: DataFrame, track: str, low: int, high: int, depth_gate: bool = True) -> DataFrame:
    """``(track, n, n_registered)``: tracks of ``low`` to ``high`` regular observations, ``low`` or more of them in registered images.

    ``members``: ``track``, ``image``, ``feature``, ``loop`` (seen by loop closure only), ``depth_ok`` and the unit ``ray``; ``images``: the registered
    ones, with ``frame``, ``camera``, ``prior_focal``, and the pose of the sensor in its rig, ``q`` and ``t``. A track seen in just two
    registered images, loop closures included, needs a valid depth at every observation there, or two cameras of one frame that
    meet: one feature in each, both with a prior focal length, apart from each other, rays that are not parallel, and the point halfway between
    them ahead of both. Nulls count as missing.
    """
    m = members.select(F.col(track).alias("track"), F.col("image").alias("image"), "feature", F.coalesce("loop", F.lit(False)).alias("loop"), F.coalesce("depth_ok", F.lit(False)).alias("depth_ok"), "ray")
    known = images.select(F.col("image").alias("own")).distinct()
    j = m.join(known, F.col("image") == F.col("own"), "left").withColumn("here", F.col("own").isNotNull())
    at = lambda f: f(F.when(F.col("here"), F.struct("feature", "ray")), F.when(F.col("here"), F.col("image")))
    counts = [F.count_if(~F.col("loop")).alias("n"), F.count_if(~F.col("loop") & F.col("here")).alias("n_registered"), F.bool_and(F.when(F.col("here"), F.col("depth_ok"))).alias("deep")]
    ends = [F.min(F.when(F.col("here"), F.col("image"))).alias("a"), F.max(F.when(F.col("here"), F.col("image"))).alias("b"), at(F.min_by).alias("first"), at(F.max_by).alias("second")]
    views = j.where("here").groupBy("track").agg(F.count_distinct("image").alias("views"), F.count_distinct(F.struct("image", "feature")).alias("features"))
    found = j.groupBy("track").agg(*counts, *ends).where(F.col("n").between(low, high) & (F.col("n_registered") >= low)).join(views.withColumnRenamed("track", "of"), F.col("track") == F.col("of")).drop("of")
    gated = (F.col("views") == 2) & ~F.col("deep") if depth_gate else F.lit(False)
    pair = found.where(gated & (F.col("features") == 2)).select("track", "a", "b", "first", "second")
    for side in ("a", "b"):
        pose = images.select(F.col("image").alias(f"{side}_image"), *[F.col(c).alias(f"{side}_{c}") for c in ("frame", "camera", "prior_focal", "q", "t")])
        pair = pair.join(pose, F.col(side) == F.col(f"{side}_image"))
    rig = (F.col("a_frame") == F.col("b_frame")) & (F.col("a_camera") != F.col("b_camera")) & F.col("a_prior_focal") & F.col("b_prior_focal")
    turn = rt.product(F.col("b_q"), rt.conjugate(F.col("a_q")))
    pair = pair.where(rig).withColumn("turn", turn).withColumn("shift", F.zip_with("b_t", rt.turned(F.col("turn"), F.col("a_t")), lambda x, y: x - y))
    # kept, so that the test below is not written out over all that it is made from
    pair = stored(pair.select("track", "turn", "shift", F.col("first.ray").alias("ray1"), F.col("second.ray").alias("ray2")), "stereo")
    stereo = pair.where(_meet([F.col("turn")[i] for i in range(4)], [F.col("shift")[i] for i in range(3)], [F.col("ray1")[i] for i in range(3)], [F.col("ray2")[i] for i in range(3)])).select("track")
    kept = found.where(~gated).unionByName(found.where(gated).join(stereo, "track", "left_semi"))
    return kept.select(F.col("track").alias(track), "n", "n_registered")


def _meet(q: list[Column], t: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Whether two rays from cameras that are apart are not parallel, and the point halfway between them is ahead of both."""
    dot = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
    r = sc.rotated(q, a)
    cross = [r[1] * b[2] - r[2] * b[1], r[2] * b[0] - r[0] * b[2], r[0] * b[1] - r[1] * b[0]]
    # depths along r from t and along b from the origin, in the second camera
    aa, bb, ab, ta, tb = dot(r, r), dot(b, b), dot(r, b), dot(t, r), dot(t, b)
    det = aa * bb - ab * ab
    one, two = F.try_divide(ab * tb - bb * ta, det), F.try_divide(aa * tb - ab * ta, det)
    middle = [(t[i] + one * r[i] + two * b[i]) / 2 for i in range(3)]
    before = dot([middle[i] - t[i] for i in range(3)], r)  # along the first ray, whose camera stands at t
    return (dot(t, t) > 1e-12) & (dot(cross, cross) > 1e-12) & (before > 1e-6) & (dot(middle, b) > 1e-6)


def transitive_pairs(members: DataFrame, track: str, image: str, feature: str) -> DataFrame:
    """``(image_a, feature_a, image_b, feature_b)`` of observations of one track in different images, image_a < image_b, each once.

    This lists all pairs of a track, so it is for graphs whose tracks are bounded, as those of :func:`filtered_tracks`.
    """
    a = members.select(track, F.col(image).alias("image_a"), F.col(feature).alias("feature_a"))
    b = members.select(track, F.col(image).alias("image_b"), F.col(feature).alias("feature_b"))
    return a.join(b, track).where("image_a < image_b").select("image_a", "feature_a", "image_b", "feature_b").distinct()


def largest_component(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, b, in_largest)``: whether the edge lies in the component with most nodes, ties to the least name."""
    c = stored(connected_components(edges, a, b), "components")
    top = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select(F.col("component").alias("_top"))
    at = c.select(F.col("node").alias(a), "component")
    return edges.join(at, a).crossJoin(F.broadcast(top)).withColumn("in_largest", F.col("component") == F.col("_top")).drop("component", "_top")


def tracking_edges(matches: DataFrame, key: str, inlier: Column, loop: Column, same_frame: Column) -> DataFrame:
    """``(key, inliers, loops, tracking)``: pairs with inliers of which at most half are loop closures, not within one frame."""
    n = matches.groupBy(key).agg(F.count_if(inlier).alias("inliers"), F.count_if(inlier & loop).alias("loops"), F.bool_or(same_frame).alias("_same"))
    return n.select(key, "inliers", "loops", ((F.col("inliers") > 0) & (2 * F.col("loops") <= F.col("inliers")) & ~F.col("_same")).alias("tracking"))


def bridges(nodes: DataFrame, tracking: DataFrame, others: DataFrame, node: str, a: str, b: str, order: list[str], max_rounds: int = 40) -> DataFrame:
    """The ``others`` edges that join the components of ``tracking`` into one, cheapest first by ``order`` (which must be unique).

    Each round every component picks its cheapest edge to another one and picked edges merge; with a unique
    order this gives the edges that adding one by one from the cheapest would give.
    """
    comp = connected_components(tracking, a, b).select(F.col("node").alias("_old"), F.col("component").alias("_new"))
    label = stored(nodes.select(node).distinct().join(comp, F.col(node) == F.col("_old"), "left").select(node, F.coalesce("_new", node).alias("c")), "labels")
    picked = None
    ends = lambda col, to: label.select(F.col(node).alias(col), F.col("c").alias(to))
    # an edge is looked at by its ends' components alone, and goes once they are one
    cross = stored(others.join(ends(a, "_ca"), a).join(ends(b, "_cb"), b).where("_ca <> _cb").select(*others.columns, "_ca", "_cb"), "cross")
    for _ in range(max_rounds):
        each = cross.withColumn("_c", F.col("_ca")).unionByName(cross.withColumn("_c", F.col("_cb")))
        first = F.min_by(F.struct(*others.columns, "_ca", "_cb"), F.struct(*order))
        best = stored(each.groupBy("_c").agg(first.alias("e")).select("e.*").distinct(), "bridges")
        if not best.limit(1).count():
            break
        picked = best.drop("_ca", "_cb") if picked is None else picked.unionByName(best.drop("_ca", "_cb"))
        merged = stored(connected_components(best, "_ca", "_cb"), "merged")
        for end in ("_ca", "_cb"):
            new = merged.select(F.col("node").alias(end), F.col("component").alias("_new"))
            cross = cross.join(new, end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
        cross = stored(cross.where("_ca <> _cb").select(*others.columns, "_ca", "_cb"), "cross")
    return picked if picked is not None else others.limit(0)


def reachable(seeds: DataFrame, edges: DataFrame, node: str, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """``(node)``: what can be reached from the seeds along edges from ``a`` to ``b``, seeds included; a round per step, over
    the frontier alone, each kept in the shared folder. Edges are written once, and what was seen is one table again after every tenth round."""
    step = stored(edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct(), "step")
    seen = front = stored(seeds.select(node).distinct(), "seen")
    for i in range(max_rounds):
        front = stored(front.join(step, F.col(node) == F.col("_a")).select(F.col("_b").alias(node)).distinct().join(seen, node, "left_anti"), "front")
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front)
        if i % 10 == 9:
            seen = stored(seen, "seen")
    raise RuntimeError(f"reachability did not settle in {max_rounds} rounds")


def forward_taint(matches: DataFrame, seeds: DataFrame, node: str, a: str, b: str, usable: Column, loop: Column) -> DataFrame:
    """``matches`` with ``tainted``: usable matches that were no loop closure and start at a reachable observation."""
    live = matches.where(usable & ~loop)
    hit = reachable(seeds, live, node, a, b).withColumn("_hit", F.lit(True))
    return matches.join(hit.withColumnRenamed(node, a), a, "left").withColumn("tainted", usable & ~loop & F.col("_hit").isNotNull()).drop("_hit")


def boundaries(members: DataFrame, tainted: DataFrame, track: str, obs: str, order: str, boundary: str, seq: str) -> DataFrame:
    """``(track, obs, boundary, outlier)``: a track takes the boundary of its first tainted observation by ``order``; observations
    of a later ``seq`` than that are outliers."""
    first = members.join(tainted.select(obs, order, boundary), obs).groupBy(track).agg(F.min_by(boundary, F.struct(order, obs)).alias("_b"))
    j = members.join(first, track, "left")
    return j.select(track, obs, F.col("_b").alias("boundary"), F.coalesce(F.col(seq) > F.col("_b"), F.lit(False)).alias("outlier"))


def prepared_observations(obs: DataFrame, track: str, image: str, feature: str, loop: Column, anchor: str) -> DataFrame:
    """``(track, image, feature, loop, anchors)``: loop observations once per track and feature with all their anchors;
    a regular observation that repeats is an error."""
    g = obs.groupBy(track, image, feature, loop.alias("loop")).agg(F.count("*").alias("_n"), F.array_sort(F.collect_set(anchor)).alias("anchors"))
    ok = F.when(~F.col("loop") & (F.col("_n") > 1), F.raise_error(F.lit("a regular observation repeats")).cast("boolean")).otherwise(F.lit(True))
    return g.where(ok).select(track, image, feature, "loop", F.when(F.col("loop"), F.col("anchors")).alias("anchors"))
