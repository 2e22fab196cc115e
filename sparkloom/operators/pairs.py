"""Operators on undirected pairs of images and their matches, all in long form with explicit ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.names import free_names
from sparkloom.operators.ranks import ranked
from sparkloom.session import stored

PAIR_BASE = 2147483647
TILE = 1000  # rows of a side of a tile


def pair_id(a: Column, b: Column) -> Column:
    """min * 2147483647 + max."""
    return F.least(a, b) * F.lit(PAIR_BASE) + F.greatest(a, b)


def pair_ends(pair: Column) -> tuple[Column, Column]:
    """The two images of a pair id."""
    second = pair % PAIR_BASE
    return ((pair - second) / PAIR_BASE).cast("bigint"), second


def pair_name(a: Column, b: Column) -> Column:
    """The stored name: '/' within a name becomes '-', and the two are joined by '/'."""
    return F.concat_ws("/", F.replace(a, F.lit("/"), F.lit("-")), F.replace(b, F.lit("/"), F.lit("-")))


def name_collisions(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``(name, pairs)`` of stored names that more than one pair has."""
    named = pairs.select(pair_name(F.col(a), F.col(b)).alias("name"), F.struct(a, b).alias("p"))
    return named.groupBy("name").agg(F.count_distinct("p").alias("pairs")).where("pairs > 1")


def require(df: DataFrame, violations: DataFrame, message: str) -> DataFrame:
    """``df``, or an error when it is read while ``violations`` has rows, even if ``df`` has none: the check is a part of its own, without rows."""
    bad = violations.agg(F.count("*").alias("_bad"))
    check = F.when(F.col("_bad") > 0, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(False))
    return df.unionByName(bad.where(check).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))


def first_direction(pairs: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """One row per unordered pair, the first in ``order``, whose direction stays."""
    w = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(*order)
    (r,) = free_names(pairs, "r")
    return pairs.withColumn(r, F.row_number().over(w)).where(F.col(r) == 1).drop(r)


def union_first(lists: list[DataFrame], a: str, b: str, order: str) -> DataFrame:
    """Union of pair lists without repeated unordered pairs; earlier lists, then ``order``, own the direction."""
    (number,) = free_names(lists[0], "list")
    all_rows = None
    for i, one in enumerate(lists):
        marked = one.withColumn(number, F.lit(i))
        all_rows = marked if all_rows is None else all_rows.unionByName(marked)
    return first_direction(all_rows, a, b, [number, order, a, b]).drop(number)


def differences(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """``(on..., state)``: 'missing' rows of expected, and 'extra' rows of present."""
    e, p = expected.select(*on).distinct(), present.select(*on).distinct()
    return e.join(p, on, "left_anti").withColumn("state", F.lit("missing")).unionByName(p.join(e, on, "left_anti").withColumn("state", F.lit("extra")))


def filter_by_inliers(pairs: DataFrame, matches: DataFrame, key: str, inlier: Column, least: int | None = None, ratio: float | None = None) -> DataFrame:
    """``pairs`` with counts and ``valid``: pairs under ``least`` inliers become invalid; so do pairs under ``ratio`` of
    inliers to rows, but for pairs without rows. ``newly_invalid`` tells those that were valid."""
    n = matches.groupBy(key).agg(F.count("*").alias("rows"), F.count_if(inlier).alias("inliers"))
    j = pairs.join(n, key, "left").na.fill(0, ["rows", "inliers"])
    bad = F.lit(False)
    if least is not None:
        bad |= F.col("inliers") < least
    if ratio is not None:
        bad |= (F.col("rows") > 0) & (F.col("inliers") < F.col("rows") * ratio)
    return j.withColumn("newly_invalid", F.col("valid") & bad).withColumn("valid", F.col("valid") & ~bad)


def reclassified(pairs: DataFrame, cameras: DataFrame, cam1: str, cam2: str) -> DataFrame:
    """PLANAR becomes CALIBRATED where the pair is valid and both cameras (``camera_id``, ``has_prior``) have a focal prior."""
    a = cameras.select(F.col("camera_id").alias(cam1), F.col("has_prior").alias("_p1"))
    b = cameras.select(F.col("camera_id").alias(cam2), F.col("has_prior").alias("_p2"))
    j = pairs.join(a, cam1, "left").join(b, cam2, "left")
    ok = (F.col("config") == "PLANAR") & F.col("valid") & F.coalesce("_p1", F.lit(False)) & F.coalesce("_p2", F.lit(False))
    return j.withColumn("config", F.when(ok, "CALIBRATED").otherwise(F.col("config"))).drop("_p1", "_p2")


def outcomes(pairs: DataFrame, bypass: int = 50) -> DataFrame:
    """``pairs`` (columns matches, ok, forward, low_tri) with ``outcome`` and ``excluded``; too few matches count but do not
    exclude; with fewer than ``bypass`` kept pairs in all, nothing is excluded."""
    outcome = F.when(F.col("matches") < 15, "few_matches").when(~F.col("ok"), "decompose_fail").when(F.col("forward"), "forward").when(F.col("low_tri"), "low_tri").otherwise("kept")
    rows = pairs.withColumn("outcome", outcome)
    kept = rows.agg(F.count_if(F.col("outcome") == "kept").alias("_kept"))
    excluded = F.col("outcome").isin("decompose_fail", "forward", "low_tri") & (F.col("_kept") >= bypass)
    return rows.crossJoin(F.broadcast(kept)).withColumn("excluded", excluded).drop("_kept")


def aligned(matches: DataFrame, masks: DataFrame, key: str) -> DataFrame:
    """``(key, problem)``: pairs only on one side, and pairs whose match and mask rows differ in number."""
    a, b = matches.groupBy(key).agg(F.count("*").alias("_m")), masks.groupBy(key).agg(F.count("*").alias("_k"))
    j = a.join(b, key, "full_outer")
    problem = F.when(F.col("_k").isNull(), "no mask").when(F.col("_m").isNull(), "no match").when(F.col("_m") != F.col("_k"), "length")
    return j.select(key, problem.alias("problem")).where("problem is not null")


def without_loops(matches: DataFrame, loop: Column, protected: DataFrame | None = None, key: str = "pair") -> DataFrame:
    """Matches that are not loop closures; those of ``protected`` pairs stay. Pairs left without matches vanish."""
    if protected is None:
        return matches.where(~loop)
    keep = protected.select(key).distinct().withColumn("_keep", F.lit(True))
    return matches.join(keep, key, "left").where(~loop | F.col("_keep").isNotNull()).drop("_keep")


def loops_by_score(matches: DataFrame, scores: DataFrame, keys: list[str], loop: Column, score: str, least: float) -> DataFrame:
    """Matches that are no loop closure, and loop closures scored ``least`` or more; one without a score is an error."""
    j = matches.join(scores.select(*keys, F.col(score).alias("_s")), keys, "left")
    s = F.when(F.col("_s").isNull(), F.raise_error(F.lit("a loop closure has no score")).cast("double")).otherwise(F.col("_s"))
    return j.where(~loop | F.when(loop, s >= least)).drop("_s")


def unoccupied(extended: DataFrame, base: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Rows of ``extended`` whose source and target are both unused in ``base``'s pair."""
    return extended.join(base.select(key, a).distinct(), [key, a], "left_anti").join(base.select(key, b).distinct(), [key, b], "left_anti")


def merged_matches(base: DataFrame, extended: DataFrame, key: str, a: str, b: str, row: str) -> DataFrame:
    """``base`` rows, then unoccupied ``extended`` rows flagged ``is_lc`` with ordinals that go on; a pair that is new is all loop closure."""
    new = unoccupied(extended, base, key, a, b)
    last = base.groupBy(key).agg((F.max(row) + 1).alias("_n"))
    order = F.row_number().over(Window.partitionBy(key).orderBy(row)) - 1
    tail = new.join(last, key, "left").withColumn(row, (order + F.coalesce("_n", F.lit(0))).cast(base.schema[row].dataType)).drop("_n").withColumn("is_lc", F.lit(True))
    return base.withColumn("is_lc", F.lit(False)).unionByName(tail.select(*base.columns, "is_lc"))


def in_tiles(rows: DataFrame, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Two sides that meet on ``block, i, j`` once for each two rows ``(block, key, ...)`` of a block, the lesser key on the first.

    A block is cut into runs of ``size`` keys (``TILE``, if not given), and every two runs are a tile of their own, so a block of any size is many tasks, each of
    bounded memory; rows are repeated by the number of their block's runs. Within a run both orders meet.
    """
    run = F.floor((F.col("rank") - 1) / (size or TILE))
    placed = stored(ranked(rows, ["block", "key"]).withColumn("run", run).drop("rank"), "runs")
    spans = placed.groupBy("block").agg(F.min("run").alias("least"), F.max("run").alias("most"))
    placed, own = placed.join(spans.hint("merge"), "block"), F.col("run")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number: tiles are small, and what they make is not

    def side(i: Column, j: Column) -> DataFrame:
        return placed.select(*rows.columns, "run", "least", "most", i.alias("i")).withColumn("j", j).drop("run", "least", "most").repartition(tasks, "block", "i", "j")

    return side(own, F.explode(F.sequence("run", "most"))), side(F.explode(F.sequence("least", "run")), own)


def candidate_pairs(images: DataFrame, image: str, frame: str, excluded: DataFrame, block: str) -> DataFrame:
    """Unordered pairs of images in the same ``block`` from different frames, but for excluded ones in either direction.

    Pairs are made in tiles and never shuffled: each is made once, in the least block that its images share, and a first image
    takes along which of a tile's seconds are excluded with it.
    """
    homes = images.select(F.col(block).alias("block"), F.col(image).alias("key"), F.col(frame).alias("f")).dropna()
    homes = homes.groupBy("key", "block").agg(F.min("f").alias("f"), F.max("f").alias("g"))
    homes = homes.select("key", "block", F.when(F.col("f") == F.col("g"), F.col("f")).alias("frame"))  # null: several, so any other image's differs from one
    each = homes.groupBy("key").agg(F.collect_list(F.struct("block", "frame")).alias("homes"))
    several = F.when(F.size("homes") > 1, F.transform("homes", lambda h: h["block"]))
    a, b = in_tiles(each.select("key", several.alias("blocks"), F.explode("homes").alias("home")).select("key", "blocks", "home.block", "home.frame"))
    gone = excluded.select(F.least("first", "second").alias("key"), F.greatest("first", "second").alias("second")).distinct()
    seconds = b.where("i = j").select(F.col("key").alias("second"), "block", "j")
    gone = gone.join(seconds.hint("merge"), "second").groupBy("key", "block", "j").agg(F.collect_list("second").alias("gone"))
    a = a.join(gone.hint("merge"), ["key", "block", "j"], "left")
    a, b = a.alias("a"), b.hint("merge").alias("b")
    met = (F.col("a.block") == F.col("b.block")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j")) & (F.col("a.key") < F.col("b.key"))
    apart = F.coalesce(F.col("a.frame") != F.col("b.frame"), F.lit(True))
    here = F.col("a.blocks").isNull() | F.col("b.blocks").isNull() | (F.array_min(F.array_intersect("a.blocks", "b.blocks")) == F.col("a.block"))
    free = F.col("a.gone").isNull() | ~F.array_contains("a.gone", F.col("b.key"))
    return a.join(b, met & apart & here & free).select(F.col("a.key").alias("first"), F.col("b.key").alias("second"))


def nearest_within(a: DataFrame, b: DataFrame, group: str, key_a: str, key_b: str, x: str, y: str, reach: float) -> DataFrame:
    """``(group, key_a, key_b, distance)``: of each point of ``a`` the nearest point of ``b`` within ``reach`` (inclusive), ties
    to the smaller key. Points meet in grid cells as wide as ``reach``."""
    p = a.select(group, key_a, F.col(x).alias("_x"), F.col(y).alias("_y"), F.floor(F.col(x) / reach).alias("_cx"), F.floor(F.col(y) / reach).alias("_cy"))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    q = b.select(group, key_b, F.col(x).alias("_u"), F.col(y).alias("_v"), step.alias("_o")).select(group, key_b, "_u", "_v", (F.floor(F.col("_u") / reach) + F.col("_o.i")).alias("_cx"), (F.floor(F.col("_v") / reach) + F.col("_o.j")).alias("_cy"))
    d = F.sqrt((F.col("_x") - F.col("_u")) ** 2 + (F.col("_y") - F.col("_v")) ** 2)
    hit = p.join(q, [group, "_cx", "_cy"]).withColumn("_d", d).where(F.col("_d") <= reach)
    return hit.groupBy(group, key_a).agg(F.min(F.struct(F.col("_d").alias("d"), F.col(key_b).alias("k"))).alias("m")).select(group, key_a, F.col("m.k").alias(key_b), F.col("m.d").alias("distance"))


def by_name_else_id(tracks: DataFrame, centres: DataFrame, name: str, key: str, value: str) -> DataFrame:
    """``tracks`` with the centre of the same name, else of the same id."""
    n = centres.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(value).alias("_n"))
    i = centres.groupBy(key).agg(F.min(value).alias("_i"))
    return tracks.join(n, name, "left").join(i, key, "left").withColumn("centre", F.coalesce("_n", "_i")).drop("_n", "_i")


def shared_points(obs: DataFrame, edges: DataFrame, image: str, point: str) -> DataFrame:
    """``(first, second, shared)``: distinct points both images of an edge observe; 0 stays. A null point on the left never matches."""
    seen = obs.select(image, point).distinct().where(F.col(point).isNotNull())
    left, right = seen.select(F.col(image).alias("first"), F.col(point).alias("_p")), seen.select(F.col(image).alias("second"), F.col(point).alias("_p"))
    n = edges.join(left, "first").join(right, ["second", "_p"]).groupBy("first", "second").agg(F.count("*").alias("shared"))
    return edges.join(n, ["first", "second"], "left").na.fill(0, ["shared"]).select("first", "second", "shared")


def shared_observations(obs: DataFrame, edges: DataFrame, image: str, point: str, row: str) -> DataFrame:
    """``(first, second, point, left_row, right_row)``: the first observation of a point on the left with every one on the right."""
    left = obs.groupBy(F.col(image).alias("first"), F.col(point).alias("_p")).agg(F.min(row).alias("left_row"))
    right = obs.select(F.col(image).alias("second"), F.col(point).alias("_p"), F.col(row).alias("right_row"))
    return edges.join(left, "first").join(right, ["second", "_p"]).select("first", "second", F.col("_p").alias(point), "left_row", "right_row")


def match_classes(matches: DataFrame, points: DataFrame) -> DataFrame:
    """``matches`` (img1, feat1, img2, feat2, is_lc) with ``class``: 0 ordinary, 1 loop closure, 2 loop closure whose ends share a valid point."""
    p = lambda i: points.select(F.col("image").alias(f"img{i}"), F.col("feature").alias(f"feat{i}"), F.col("point").alias(f"_p{i}"))
    j = matches.join(p(1), ["img1", "feat1"], "left").join(p(2), ["img2", "feat2"], "left")
    return j.withColumn("class", F.when(~F.col("is_lc"), 0).when(F.col("_p1") == F.col("_p2"), 2).otherwise(1)).drop("_p1", "_p2")


def decoded_matches(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(pair_id, row, feature1, feature2)`` of the pairs ``wanted`` (``first``, ``second``, in either order), decoded from ``blobs``.

    ``blobs``: ``pair_id``, ``rows``, ``cols`` and ``data``, little-endian unsigned 32-bit numbers row by row. A pair without a blob, or one whose shape is not
    ``rows`` by two, fails the query.
    """
    asked = wanted.select(pair_id(F.col("first"), F.col("second")).alias("pair_id")).distinct()
    lost = asked.join(blobs.select("pair_id"), "pair_id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"a pair has no matches: {lost[0]['pair_id']}")
    held = asked.join(blobs.select("pair_id", "rows", "cols", "data"), "pair_id")
    shape = F.coalesce((F.col("cols") == 2) & (F.octet_length("data") == F.col("rows") * 8), F.lit(False))
    fail = F.raise_error(F.concat(F.lit("matches have an invalid shape: "), F.col("pair_id").cast("string"))).cast("int")
    numbers = F.sequence(F.lit(0), F.when(shape, F.col("rows").cast("int")).otherwise(fail))
    each = held.withColumn("row", F.explode(numbers)).where("row < rows")

    def number(at: Column) -> Column:
        h = F.hex(F.substring(F.col("data"), at, F.lit(4)))
        return F.conv(F.concat(*[F.substring(h, 7 - 2 * i, 2) for i in range(4)]), 16, 10).cast("bigint")

    return each.select("pair_id", "row", number(F.col("row") * 8 + 1).alias("feature1"), number(F.col("row") * 8 + 5).alias("feature2"))


def masked_match_classes(matches: DataFrame, masks: DataFrame, points: DataFrame) -> DataFrame:
    """``matches`` (``pair_id``, ``row``, ``img1``, ``feat1``, ``img2``, ``feat2``) with ``class`` as in :func:`match_classes`, loop closures being the
    rows that ``masks`` (``pair_id``, ``row``) name. A mask row that is there twice or names no match fails the query."""
    named = masks.groupBy(F.col("pair_id").alias("_pair"), F.col("row").alias("_row")).agg(F.count("*").alias("_times"))
    meet = (F.col("pair_id") == F.col("_pair")) & (F.col("row") == F.col("_row"))
    lost = named.join(matches.select("pair_id", "row"), meet, "left_anti").unionByName(named.where("_times > 1")).limit(1).collect()
    if lost:
        raise ValueError(f"a mask row names no match, or is there twice: {lost[0]['_pair']}/{lost[0]['_row']}")
    marked = matches.join(named, meet, "left").withColumn("is_lc", F.col("_row").isNotNull()).drop("_pair", "_row", "_times")
    return match_classes(marked, points)


def complete_frames(selection: DataFrame, frames: DataFrame, image: str, frame: str) -> DataFrame:
    """Selected images of frames that are selected whole; ``complete`` tells, incomplete frames stay flagged."""
    s = selection.select(image).distinct().withColumn("_in", F.lit(1))
    j = frames.join(s, image, "left")
    whole = j.groupBy(frame).agg(F.count("_in").alias("_n"), F.count("*").alias("_all")).where("_n > 0").select(frame, (F.col("_n") == F.col("_all")).alias("complete"))
    return j.where("_in = 1").join(whole, frame).select(frame, image, "complete")


def unchanged_dropped(frames: DataFrame, by: str, order: str, payload: Column) -> DataFrame:
    """Frames whose payload differs from that of the frame before; a null payload is one of its own kind."""
    w = Window.partitionBy(by).orderBy(order)
    h = F.sha2(F.coalesce(payload, F.lit("")), 256)
    return frames.withColumn("_h", h).withColumn("_b", F.lag("_h").over(w)).where(F.col("_b").isNull() | (F.col("_h") != F.col("_b"))).drop("_h", "_b")
