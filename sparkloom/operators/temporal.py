"""As-of joins, path windows and other operators over ordered streams.

A stream is a group of rows (column ``by``) ordered by time (column ``at``). Ordered windows run per stream
and time bucket where a bucket width is given: what a bucket needs from earlier and later ones is carried
over a table with a row per bucket, so one very long stream is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import rotations as rt
from sparkloom.operators.names import free_prefix
from sparkloom.operators.ranks import ranked
from sparkloom.session import stored


def bracket(source: DataFrame, target: DataFrame, by: str, at: str, bucket: int | None = None, past: bool = False) -> DataFrame:
    """``source`` with ``prev`` and ``next``, the target times around each row, and ``fraction`` between them.

    An exact hit gives (t, t, 0), or with ``past`` (t, the target after t, 0); before the first target prev is null, after the
    last next is null, and the fraction is 0 or null as in (null, first, 0) and (last, null, null). A stream without targets gives nulls.
    Targets may repeat; times are whole numbers. Rows with a null time or stream get nulls.
    """
    cols, p = source.columns, free_prefix(source, target)
    places = target.select(F.col(by), F.col(at).cast("bigint").alias(f"{p}t")).where(F.col(f"{p}t").isNotNull() & F.col(by).isNotNull())
    marked = source.withColumn(f"{p}s", F.col(at).cast("bigint"))
    both = marked.select(*cols, f"{p}s", F.col(f"{p}s").alias(f"{p}o"), F.lit(None).cast("bigint").alias(f"{p}t"), F.lit(1).alias(f"{p}k"))
    points = places.select(*[F.col(by) if c == by else F.lit(None).cast(source.schema[c].dataType).alias(c) for c in cols], F.lit(None).cast("bigint").alias(f"{p}s"), F.col(f"{p}t").alias(f"{p}o"), f"{p}t", F.lit(0).alias(f"{p}k"))
    rows = both.unionByName(points)
    keys = [by]
    if bucket:
        rows = rows.withColumn(f"{p}b", F.floor(F.col(f"{p}o") / bucket))
        ends = rows.groupBy(by, f"{p}b").agg(F.min(f"{p}t").alias(f"{p}lo"), F.max(f"{p}t").alias(f"{p}hi"))
        w = Window.partitionBy(by).orderBy(f"{p}b")
        ends = ends.select(by, f"{p}b", F.last(f"{p}hi", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"{p}before"), F.first(f"{p}lo", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias(f"{p}after"))
        rows = rows.join(ends, [by, f"{p}b"], "left")
        keys.append(f"{p}b")
    up = Window.partitionBy(*keys).orderBy(f"{p}o", f"{p}k").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc(f"{p}o"), F.desc(f"{p}k") if past else F.asc(f"{p}k")).rowsBetween(Window.unboundedPreceding, 0)
    prev, nxt = F.last(f"{p}t", True).over(up), F.last(f"{p}t", True).over(down)
    if bucket:
        prev, nxt = F.coalesce(prev, f"{p}before"), F.coalesce(nxt, f"{p}after")
    timed = F.col(f"{p}s").isNotNull() & F.col(by).isNotNull()
    out = rows.withColumn("prev", F.when(timed, prev)).withColumn("next", F.when(timed, nxt)).where(f"{p}k = 1")
    fraction = F.when(F.col("prev").isNull() & F.col("next").isNotNull(), 0.0).when(F.col("prev") == F.col("next"), 0.0).otherwise((F.col(f"{p}s") - F.col("prev")) / (F.col("next") - F.col("prev")))
    return out.select(*cols, "prev", "next", fraction.alias("fraction"))


def nearest(bracketed: DataFrame, at: str, tolerance: int | None = None) -> DataFrame:
    """Adds ``nearest``: of prev and next the one nearer to ``at``, ties to the earlier; null beyond ``tolerance`` (inclusive)."""
    t = F.col(at).cast("bigint")
    back, ahead = t - F.col("prev"), F.col("next") - t
    pick = F.when(F.col("next").isNull() | (back <= ahead), F.col("prev")).otherwise(F.col("next"))
    if tolerance is not None:
        pick = F.when(F.abs(t - pick) <= tolerance, pick)
    return bracketed.withColumn("nearest", pick)


def interpolated(bracketed: DataFrame, target: DataFrame, by: str, at: str, value: str, first_ok: bool, last_ok: bool, widest: int | None = None) -> DataFrame:
    """Adds ``interpolated``: the target's value between prev and next, linear in time.

    Outside the targets' range it is null; at the very first (last) target time only if ``first_ok``
    (``last_ok``); brackets wider than ``widest`` give null. Target times must be unique in a stream.
    """
    ends = target.groupBy(by).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    known = target.select(by, F.col(at).alias("_at"), F.col(value).alias("_v"))
    rows = bracketed.join(ends, by, "left")
    rows = rows.join(known.select(by, F.col("_at").alias("prev"), F.col("_v").alias("_v0")), [by, "prev"], "left")
    rows = rows.join(known.select(by, F.col("_at").alias("next"), F.col("_v").alias("_v1")), [by, "next"], "left")
    ok = F.col("prev").isNotNull() & F.col("next").isNotNull()
    ok &= F.lit(first_ok) | (F.col(at) != F.col("_first"))
    ok &= F.lit(last_ok) | (F.col(at) != F.col("_last"))
    if widest is not None:
        ok &= F.col("next") - F.col("prev") <= widest
    return rows.withColumn("interpolated", F.when(ok, F.col("_v0") + F.col("fraction") * (F.col("_v1") - F.col("_v0")))).drop("_first", "_last", "_v0", "_v1")


def posed(bracketed: DataFrame, target: DataFrame, by: str, at: str, blend: str, first_ok: bool, last_ok: bool, widest: int | None = None) -> DataFrame:
    """Adds ``position`` and ``rotation``, those of ``target`` (arrays ``position``, ``rotation``) between prev and next.

    Positions are blended linearly, rotations by ``blend``: 'slerp' at even speed over the shorter arc, 'vector' by their rotation
    vectors. Nulls outside the targets' range, at the very first (last) target time unless ``first_ok`` (``last_ok``), and where
    prev and next are more than ``widest`` apart, also for a row right at prev if the bracket was made with ``past``. Target
    times must be unique in a stream; quaternions are brought to length one.
    """
    p = free_prefix(bracketed)
    mixed = {"slerp": rt.slerp, "vector": rt.vector_blend}[blend]
    ends = target.groupBy(F.col(by).alias(f"{p}own")).agg(F.min(at).alias(f"{p}first"), F.max(at).alias(f"{p}last"))
    known = lambda c, n: target.select(F.col(by).alias(f"{p}s{n}"), F.col(at).alias(f"{p}at{n}"), F.col("position").alias(f"{p}p{n}"), rt.unit(F.col("rotation")).alias(f"{p}q{n}"))
    rows = bracketed.join(ends, F.col(by) == F.col(f"{p}own"), "left")
    for c, n in (("prev", 0), ("next", 1)):
        rows = rows.join(known(c, n), (F.col(by) == F.col(f"{p}s{n}")) & (F.col(c) == F.col(f"{p}at{n}")), "left")
    ok = F.col("prev").isNotNull() & F.col("next").isNotNull()
    ok &= F.lit(first_ok) | (F.col(at) != F.col(f"{p}first"))
    ok &= F.lit(last_ok) | (F.col(at) != F.col(f"{p}last"))
    if widest is not None:
        ok &= F.col("next") - F.col("prev") <= widest
    position, rotation = rt.linear(F.col(f"{p}p0"), F.col(f"{p}p1"), F.col("fraction")), mixed(F.col(f"{p}q0"), F.col(f"{p}q1"), F.col("fraction"))
    return rows.select(*bracketed.columns, F.when(ok, position).alias("position"), F.when(ok, rotation).alias("rotation"))


def remapped_poses(target: DataFrame, source: DataFrame, by: str, at: str, name: str, fill_missing: bool = True, bucket: int | None = None) -> DataFrame:
    """``(by, at, name, mode, position, rotation)``: the source's poses on the target's rows.

    Both have ``by``, ``at``, ``name`` and a world-to-camera pose (arrays ``position``, ``rotation``; null for a row without one), one row
    to a time. Source rows whose name is a target row without a pose are unavailable. 'exact' where every other source row with a pose
    stands at the time of a posed target row of its own: these rows get its pose. Else 'interpolate': each posed target row within the posed source's
    range gets the pose between its neighbours, camera centres and world rotations blended; without ``fill_missing`` those named like a source row
    without a pose do not. A stream without posed source or target rows has no rows.
    """
    have = F.col("position").isNotNull() & F.col("rotation").isNotNull()
    target, source = (df.select(by, at, name, "position", "rotation") for df in (target, source))
    goal, poses = target.where(have), source.where(have)
    blocked = target.where(~have).select(F.col(by).alias("_b"), F.col(name).alias("_n")).distinct()
    open_poses = poses.join(blocked, (F.col(by) == F.col("_b")) & (F.col(name) == F.col("_n")), "left_anti")
    times = goal.select(F.col(by).alias("_g"), F.col(at).alias("_t"), F.lit(1).alias("_hit"))
    gate = open_poses.join(times, (F.col(by) == F.col("_g")) & (F.col(at) == F.col("_t")), "left").groupBy(by, at).agg(F.count("*").alias("_m"), F.count("_hit").alias("_h"))
    gate = gate.groupBy(F.col(by).alias("_gate")).agg(F.bool_and((F.col("_h") == 1) & (F.col("_m") == 1)).alias("_exact"))
    streams = goal.select(F.col(by).alias("_goal")).distinct().join(poses.select(F.col(by).alias("_have")).distinct(), F.col("_goal") == F.col("_have"))
    modes = stored(streams.join(gate, F.col("_goal") == F.col("_gate"), "left").select("_goal", F.coalesce("_exact", F.lit(True)).alias("_exact")), "modes")

    own = open_poses.select(F.col(by).alias("_s"), F.col(at).alias("_a"), F.col("position").alias("_p"), F.col("rotation").alias("_q"))
    exact = goal.select(by, at, name).join(modes.where("_exact"), F.col(by) == F.col("_goal"), "left_semi").join(own, (F.col(by) == F.col("_s")) & (F.col(at) == F.col("_a")))
    exact = exact.select(by, at, name, F.lit("exact").alias("mode"), F.col("_p").alias("position"), F.col("_q").alias("rotation"))

    back, centre = rt.inverse_pose(rt.unit(F.col("rotation")), F.col("position"))
    world = stored(poses.join(modes.where("not _exact"), F.col(by) == F.col("_goal"), "left_semi").select(by, at, centre.alias("position"), back.alias("rotation")), "world")
    wanted = goal.select(by, at, name).join(modes.where("not _exact"), F.col(by) == F.col("_goal"), "left_semi")
    if not fill_missing:
        gone = source.where(~have).select(F.col(by).alias("_b"), F.col(name).alias("_n")).distinct()
        wanted = wanted.join(gone, (F.col(by) == F.col("_b")) & (F.col(name) == F.col("_n")), "left_anti")
    between = posed(bracket(wanted, world, by, at, bucket), world, by, at, "slerp", True, True).where("position is not null")
    q, t = rt.inverse_pose(F.col("rotation"), F.col("position"))
    return exact.unionByName(between.select(by, at, name, F.lit("interpolate").alias("mode"), t.alias("position"), q.alias("rotation")))


def merge_counts(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One row: matched keys, and keys only in the left and only in the right stream (keys unique per side)."""
    a, b = left.select(*on).withColumn("_l", F.lit(1)), right.select(*on).withColumn("_r", F.lit(1))
    both = a.join(b, on, "full_outer")
    return both.agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"))


def synchronised(rows: DataFrame, at: str, camera: str, cameras: int, number_by: str | None = None) -> DataFrame:
    """Times at which all ``cameras`` have a row, numbered from 1 in time order (per ``number_by``, if given)."""
    keys = [number_by] if number_by else []
    full = rows.groupBy(*keys, at).agg(F.count_distinct(camera).alias("_n")).where(F.col("_n") == cameras).drop("_n")
    return full.withColumn("frame_id", F.row_number().over(Window.partitionBy(*keys).orderBy(at)))


def hop_pairs(rows: DataFrame, by: str, order: list[str], key: str, hops: list[int]) -> DataFrame:
    """``(by, first, second, hop)``: each row's key with that ``hop`` rows before it; of the same two keys the
    first in (row, hop) order owns the direction."""
    w = Window.partitionBy(by).orderBy(*order)
    numbered = rows.select(by, key, F.row_number().over(w).alias("_n"), *[F.lag(key, h).over(w).alias(f"_h{h}") for h in hops])
    each = numbered.select(by, key, "_n", F.explode(F.array(*[F.struct(F.lit(h).alias("hop"), F.col(f"_h{h}").alias("first")) for h in hops])).alias("p")).where("p.first is not null")
    pair = each.select(by, F.col("p.first").alias("first"), F.col(key).alias("second"), F.col("p.hop").alias("hop"), "_n")
    own = Window.partitionBy(by, F.least("first", "second"), F.greatest("first", "second")).orderBy("_n", "hop")
    return pair.where("first <> second").withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r", "_n")


def consecutive_pairs(rows: DataFrame, by: str, order: list[str], key: str, edges: DataFrame | None = None) -> DataFrame:
    """``(by, first, second)`` of neighbouring rows; only those among ``edges`` ``(first, second)``, in either direction, if given."""
    w = Window.partitionBy(by).orderBy(*order)
    pairs = rows.select(by, F.col(key).alias("first"), F.lead(key).over(w).alias("second")).where("second is not null")
    if edges is None:
        return pairs
    canon = edges.select(F.least("first", "second").alias("_a"), F.greatest("first", "second").alias("_b")).distinct()
    return pairs.join(canon, (F.least("first", "second") == F.col("_a")) & (F.greatest("first", "second") == F.col("_b")), "left_semi")


def path_lengths(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Adds ``cum_len``, the length of the path so far (0 at the start), with steps of absolute change in ``value``."""
    w = Window.partitionBy(by).orderBy(*order)
    step = F.abs(F.col(value) - F.lag(value).over(w))
    return rows.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("cum_len", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def path_windows(rows: DataFrame, by: str, key: str, lengths: list[float], least: int = 3) -> DataFrame:
    """``(by, key, w, lo, hi, n)``: the window of path length ``w`` centred on each row, moved at the ends so that
    it keeps its width; rows in it, both ends included. Lengths over the path's, and windows of fewer than
    ``least`` rows, are left out. The range join is an equi-join on cells of width ``w``."""
    total = rows.groupBy(by).agg(F.max("cum_len").alias("_total"))
    centre = rows.select(by, key, F.col("cum_len").alias("_c")).join(total, by).withColumn("w", F.explode(F.array(*[F.lit(float(x)) for x in lengths]))).where("w <= _total")
    lo = F.least(F.greatest(F.col("_c") - F.col("w") / 2, F.lit(0.0)), F.col("_total") - F.col("w"))
    centre = centre.withColumn("lo", lo).withColumn("hi", F.col("lo") + F.col("w"))
    cells = centre.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") / F.col("w")), F.floor(F.col("hi") / F.col("w")))))
    other = rows.select(F.col(by).alias("_by"), F.col("cum_len").alias("_o"), F.explode(F.array(*[F.lit(float(x)) for x in lengths])).alias("_w"))
    other = other.withColumn("_cell2", F.floor(F.col("_o") / F.col("_w")))
    hit = cells.join(other, (cells[by] == other["_by"]) & (F.col("w") == F.col("_w")) & (F.col("_cell") == F.col("_cell2")) & (F.col("_o") >= F.col("lo")) & (F.col("_o") <= F.col("hi")))
    return hit.groupBy(by, key, "w", "lo", "hi").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def context_window(rows: DataFrame, by: str, order: list[str], key: str, size: int) -> DataFrame:
    """``(by, key, members, centre)``: ``size`` neighbouring keys of each row, moved inwards at the ends of the
    stream, and the row's index among them; a shorter stream gives all it has."""
    w = Window.partitionBy(by).orderBy(*order)
    numbered = rows.select(by, key, F.row_number().over(w).alias("_n"), F.count("*").over(Window.partitionBy(by)).alias("_all"))
    start = F.greatest(F.lit(1), F.least(F.col("_n") - size // 2, F.col("_all") - size + 1))
    near = Window.partitionBy(by).orderBy("_n").rowsBetween(-size, size)
    held = numbered.withColumn("_start", start).withColumn("_near", F.collect_list(F.struct("_n", key)).over(near))
    inside = F.filter("_near", lambda x: (x["_n"] >= F.col("_start")) & (x["_n"] < F.col("_start") + size))
    return held.select(by, key, F.transform(inside, lambda x: x[key]).alias("members"), (F.col("_n") - F.col("_start")).cast("int").alias("centre"))


def triplets(rows: DataFrame, by: str, at: str, tie: str, registered: Column) -> DataFrame:
    """``(by, prev, key, next, dt_prev, dt_next)`` of three registered neighbours; times must increase, else the query fails."""
    w = Window.partitionBy(by).orderBy(at, tie)
    t = F.col(at).cast("bigint")
    spec = rows.select(by, F.lag(tie).over(w).alias("prev"), F.col(tie).alias("key"), F.lead(tie).over(w).alias("next"), (t - F.lag(t).over(w)).alias("dt_prev"), (F.lead(t).over(w) - t).alias("dt_next"), registered.alias("_ok"), F.lag(registered).over(w).alias("_ok0"), F.lead(registered).over(w).alias("_ok2"))
    sound = F.when((F.col("dt_prev") <= 0) | (F.col("dt_next") <= 0), F.raise_error(F.lit("times do not increase")).cast("boolean")).otherwise(F.lit(True))
    return spec.where("prev is not null and next is not null").where("_ok and _ok0 and _ok2").where(sound).drop("_ok", "_ok0", "_ok2")


def acceleration(rows: DataFrame, by: str, at: str, tie: str, value: str, scale: float = 1.0) -> DataFrame:
    """``(by, key, residual)``: 2 / (d0 + d1) * ((n - c) / d1 - (c - p) / d0) of each row with two neighbours."""
    w = Window.partitionBy(by).orderBy(at, tie)
    t = F.col(at).cast("bigint") / F.lit(scale)
    v = F.col(value)
    found = rows.select(by, F.col(tie).alias("key"), v.alias("_c"), F.lag(value).over(w).alias("_p"), F.lead(value).over(w).alias("_n"), (t - F.lag(t).over(w)).alias("_d0"), (F.lead(t).over(w) - t).alias("_d1"))
    residual = 2 / (F.col("_d0") + F.col("_d1")) * ((F.col("_n") - F.col("_c")) / F.col("_d1") - (F.col("_c") - F.col("_p")) / F.col("_d0"))
    return found.where("_p is not null and _n is not null and _d0 > 0 and _d1 > 0").select(by, "key", residual.alias("residual"))


def outer_motion(rows: DataFrame, by: str, order: list[str], key: str, value: str) -> DataFrame:
    """``(by, key, scale)``: median of the six outer steps among the eight around a row; 0 near the ends or where a value is missing."""
    w = Window.partitionBy(by).orderBy(*order)
    steps = [F.abs(F.lag(value, -(i + 1)).over(w) - F.lag(value, -i).over(w)) for i in (-4, -3, -2, 1, 2, 3)]
    found = rows.select(by, key, F.array_sort(F.array(*steps)).alias("_s"), F.array_contains(F.transform(F.array(*steps), lambda s: s.isNull()), True).alias("_gap"))
    return found.select(by, key, F.when(F.col("_gap"), 0.0).otherwise((F.col("_s")[2] + F.col("_s")[3]) / 2).alias("scale"))


def fixed_chunks(rows: DataFrame, by: str, order: list[str], size: int, first: int, lengths: tuple[int, ...] | None = None) -> DataFrame:
    """Rows of the first ``first`` full chunks of ``size`` rows (or of each of ``lengths``) with ``chunk`` (and ``length``); a short last chunk goes."""
    w = Window.partitionBy(by).orderBy(*order)
    at = rows.withColumn("_n", F.row_number().over(w)).withColumn("length", F.explode(F.array(*[F.lit(x) for x in lengths or (size,)])))
    at = at.withColumn("chunk", F.floor((F.col("_n") - 1) / F.col("length")).cast("int")).where(F.col("chunk") < first)
    return at.withColumn("_c", F.count("*").over(Window.partitionBy(by, "length", "chunk"))).where("_c = length").drop("_c", "_n")


def linspace_rows(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """At most ``k`` evenly spaced rows of each stream, first and last among them, by whole-number arithmetic."""
    w = Window.partitionBy(by).orderBy(*order)
    numbered = rows.withColumn("_n", F.row_number().over(w) - 1).withColumn("_all", F.count("*").over(Window.partitionBy(by)))
    step = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_all") - 1) / (k - 1)).cast("int")))
    return numbered.where((F.col("_all") <= k) | F.array_contains(step, F.col("_n"))).drop("_n", "_all")


def every_kth(rows: DataFrame, by: str, order: list[str], at_most: int) -> DataFrame:
    """Every k-th row of a stream, k the least that leaves ``at_most`` or fewer."""
    w = Window.partitionBy(by).orderBy(*order)
    numbered = rows.withColumn("_n", F.row_number().over(w) - 1).withColumn("_k", F.ceil(F.count("*").over(Window.partitionBy(by)) / at_most))
    return numbered.where("_n % _k = 0").drop("_n", "_k")


def forward_fill(rows: DataFrame, by: str, order: list[str], value: Column) -> DataFrame:
    """Adds ``filled``: the last non-null ``value`` at or before each row."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("filled", F.last(value, ignorenulls=True).over(w))


def support_rank(rows: DataFrame, track: str, order: str, n: int) -> DataFrame:
    """Rows within the ``n`` smallest distinct ``order`` values of their track; ties share the cut."""
    return rows.withColumn("_r", F.dense_rank().over(Window.partitionBy(track).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def first_appearance(obs: DataFrame, point: str, frame: str, pos: str, points: DataFrame) -> DataFrame:
    """``(frame, point, pos)`` of each point's first observation; points never seen come with a null frame."""
    first = obs.groupBy(point).agg(F.min(F.struct(F.col(frame).alias("frame"), F.col(pos).alias("pos"))).alias("f")).select(F.col("f.frame").alias(frame), point, F.col("f.pos").alias(pos))
    unseen = points.select(point).distinct().join(first, point, "left_anti")
    return first.unionByName(unseen.withColumns({frame: F.lit(None).cast(obs.schema[frame].dataType), pos: F.lit(None).cast(obs.schema[pos].dataType)}))


def unit_of_times(rows: DataFrame, by: str, at: str, tie: str, units: tuple[int, ...] = (1, 1_000_000, 1_000_000_000), low: float = 1e-4, high: float = 10.0) -> DataFrame:
    """``(by, unit)``: the unit in which the median step of a stream is between ``low`` and ``high`` seconds; null unless exactly one fits."""
    w = Window.partitionBy(by).orderBy(at, tie)
    t = F.col(at).cast("bigint")
    step = rows.select(by, (t - F.lag(t).over(w)).alias("_d")).where("_d is not null").groupBy(by).agg(F.median("_d").alias("_m"))
    fits = F.filter(F.array(*[F.lit(u) for u in units]), lambda u: (F.col("_m") / u >= low) & (F.col("_m") / u <= high))
    return step.select(by, F.when(F.size(fits) == 1, F.element_at(fits, 1)).alias("unit"))


def elapsed_seconds(rows: DataFrame, by: str, name: str, pattern: str, units: tuple[float, ...] = (1.0, 1e6, 1e9), low: float = 1 / 240, high: float = 2.0) -> DataFrame:
    """``(by, name, seconds)``: the time of each image since its stream's first, from the number that ``pattern`` finds in its file's stem.

    Numbers with a decimal point are seconds; whole numbers are in that of ``units`` in which the median step is between ``low`` and ``high``
    seconds. The query fails for a stem without a number, a stream with both kinds, equal times, or if not exactly one unit fits.
    """
    stem = F.regexp_replace(F.regexp_extract(name, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    token = F.nullif(F.regexp_extract(stem, pattern, 1), F.lit(""))
    parsed = rows.select(F.col(by).alias("by"), F.col(name).alias("name"), token.alias("token")).withColumn("at", F.col("token").cast("double")).withColumn("point", F.col("token").contains("."))
    w = Window.partitionBy("by").orderBy("at", "name")
    steps = parsed.withColumn("step", F.col("at") - F.lag("at").over(w))
    known = steps.groupBy(F.col("by").alias("own")).agg(F.min("at").alias("first"), F.min("step").alias("least"), F.coalesce(F.median("step"), F.lit(0.0)).alias("median"), F.count_if(F.col("token").isNull()).alias("nameless"), F.max("point").alias("any"), F.min("point").alias("all"))
    fits = F.filter(F.array(*[F.lit(float(u)) for u in units]), lambda u: (F.col("median") / u >= low) & (F.col("median") / u <= high))
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{why}: stream "), F.coalesce(F.col("own").cast("string"), F.lit("null")))).cast("double")
    unit = F.when(F.col("nameless") > 0, fail("a name has no time")).when(F.col("any") != F.col("all"), fail("times mix whole and decimal numbers")).when(F.col("least") <= 0, fail("times are not unique"))
    unit = unit.when(F.col("any"), 1.0).when(F.size(fits) == 1, F.element_at(fits, 1)).otherwise(fail("not exactly one unit of time fits"))
    scaled = parsed.join(known.select("own", "first", unit.alias("unit")), F.col("by").eqNullSafe(F.col("own")))
    return scaled.select(F.col("by").alias(by), F.col("name").alias(name), ((F.col("at") - F.col("first")) / F.col("unit")).alias("seconds"))


def rank_gap_pairs(pairs: DataFrame, nodes: DataFrame, node: str, natural: Column, gap: int) -> DataFrame:
    """``pairs`` ``(first, second)`` whose nodes are more than ``gap`` ranks apart in natural order; adds ``gap``."""
    names = ranked(nodes.select(node, natural.alias("_o")), ["_o", node], "_r").withColumn("_r", F.col("_r").cast("int"))
    a, b = names.select(F.col(node).alias("first"), F.col("_r").alias("_a")), names.select(F.col(node).alias("second"), F.col("_r").alias("_b"))
    return pairs.join(a, "first").join(b, "second").withColumn("gap", F.abs(F.col("_a") - F.col("_b"))).where(F.col("gap") > gap).drop("_a", "_b")
