"""Queries over ordered streams: the events of a user stand in for the frames of a camera."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import rotations as rt
from sparkloom.operators import alignment, scans
from sparkloom.operators import temporal as tm
from sparkloom.plans.registry import Tables, query

BUCKET = 5 * 86_400_000_000  # microseconds of a time bucket
EV = "ev AS (SELECT user_id AS s, epoch_us(ts) AS t, event_id AS k, value AS v, event_type AS e FROM events)"


def events(t: Tables, kind: str | None = None) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("s"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("k"), F.col("value").alias("v"), F.col("event_type").alias("e"))
    return rows if kind is None else rows.where(F.col("e") == kind)


def bracketed(t: Tables) -> DataFrame:
    return tm.bracket(events(t, "error").select("s", "t", "k"), events(t, "purchase").select("s", "t"), "s", "t", BUCKET)


BR = f"""{EV}, src AS (SELECT s, t, k FROM ev WHERE e = 'error'), dst AS (SELECT s, t, avg(v) AS v FROM ev WHERE e = 'purchase' GROUP BY s, t),
br AS (SELECT src.*, (SELECT max(dst.t) FROM dst WHERE dst.s = src.s AND dst.t <= src.t) AS prev, (SELECT min(dst.t) FROM dst WHERE dst.s = src.s AND dst.t >= src.t) AS next FROM src),
bf AS (SELECT *, CASE WHEN prev IS NULL AND next IS NOT NULL THEN 0.0 WHEN prev = next THEN 0.0 ELSE (t - prev)::DOUBLE / (next - prev) END AS fraction FROM br)"""


@query("j2_asof_bracket", f"WITH {BR} SELECT s, t, k, prev, next, round(fraction, 6) AS fraction FROM bf")
def _(t):
    return bracketed(t).withColumn("fraction", F.round("fraction", 6))


NEAR = "CASE WHEN next IS NULL OR t - prev <= next - t THEN prev ELSE next END"


@query("j3_asof_nearest", f"WITH {BR} SELECT s, t, k, {NEAR} AS nearest FROM bf")
def _(t):
    return tm.nearest(bracketed(t), "t").select("s", "t", "k", "nearest")


@query("j4_asof_tolerance", f"WITH {BR} SELECT s, t, k, CASE WHEN abs(t - {NEAR}) <= 3600000000 THEN {NEAR} END AS nearest FROM bf")
def _(t):
    return tm.nearest(bracketed(t), "t", 3_600_000_000).select("s", "t", "k", "nearest")


# poses of the purchases: where they are, and a turn about z; SQL needs no quaternions for it
POSES = f"""{BR}, po AS (SELECT s, t, v AS x, 2 * v - 1 AS y, v / 10 AS z, (v * 37) % 6.0 - 3.0 AS a FROM dst),
pf AS (SELECT bf.*, p.x AS x0, n.x AS x1, p.y AS y0, n.y AS y1, p.z AS z0, n.z AS z1, p.a AS a0, n.a AS a1, (SELECT min(t) FROM po WHERE po.s = bf.s) AS f, (SELECT max(t) FROM po WHERE po.s = bf.s) AS l FROM bf LEFT JOIN po p ON p.s = bf.s AND p.t = prev LEFT JOIN po n ON n.s = bf.s AND n.t = next)"""


def poses(t: Tables) -> DataFrame:
    v = F.col("v")
    rows = events(t, "purchase").groupBy("s", "t").agg(F.avg("v").alias("v")).withColumn("a", (v * 37) % 6.0 - 3.0)
    return rows.select("s", "t", rt.vector(v, 2 * v - 1, v / 10).alias("position"), rt.vector(0.0, 0.0, F.sin(F.col("a") / 2), F.cos(F.col("a") / 2)).alias("rotation"))


def _pose_sql(ok: str, angle: str) -> str:
    part = lambda c: f"round(CASE WHEN {ok} THEN {c}0 + fraction * ({c}1 - {c}0) END, 5) AS {c}"
    return f"""WITH {POSES} SELECT s, t, k, {part("x")}, {part("y")}, {part("z")}, round(CASE WHEN {ok} THEN cos({angle}) END, 5) AS c, round(CASE WHEN {ok} THEN sin({angle}) END, 5) AS i FROM pf"""


def _pose_columns() -> list:
    p, q = F.col("position"), F.col("rotation")
    return [*[F.round(p[i], 5).alias(c) for i, c in enumerate("xyz")], F.round(q[3] * q[3] - q[2] * q[2], 5).alias("c"), F.round(2 * q[2] * q[3], 5).alias("i")]


@query("j5_asof_interpolate_open_start", _pose_sql("prev IS NOT NULL AND next IS NOT NULL AND pf.t <> f", "(1 - fraction) * a0 + fraction * a1"))
def _(t):
    found = tm.posed(bracketed(t), poses(t), "s", "t", "vector", first_ok=False, last_ok=True)
    return found.select("s", "t", "k", *_pose_columns())


SHORT = "a0 + fraction * ((a1 - a0) - 2 * pi() * round((a1 - a0) / (2 * pi())))"


@query("j6_asof_interpolate_gap", _pose_sql("prev IS NOT NULL AND next IS NOT NULL AND pf.t <> l AND next - prev <= 172800000000", SHORT).replace("dst.t >= src.t", "dst.t > src.t"))
def _(t):
    near = tm.bracket(events(t, "error").select("s", "t", "k"), poses(t).select("s", "t"), "s", "t", BUCKET, past=True)
    return tm.posed(near, poses(t), "s", "t", "slerp", first_ok=True, last_ok=False, widest=172_800_000_000).select("s", "t", "k", *_pose_columns())


@query("j7_merge_counts", "WITH a AS (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events WHERE event_type = 'purchase') SELECT count_if(a.h IS NOT NULL AND b.h IS NOT NULL)::BIGINT AS matched, count_if(b.h IS NULL)::BIGINT AS left_only, count_if(a.h IS NULL)::BIGINT AS right_only FROM a FULL JOIN b ON a.h = b.h")
def _(t):
    side = lambda kind: t.events.where(F.col("event_type") == kind).select(F.date_trunc("hour", F.col("ts")).alias("h")).distinct()
    return tm.merge_counts(side("error"), side("purchase"), ["h"])


@query("j8_synchronised_frames", "WITH h AS (SELECT user_id, date_trunc('day', ts) AS d, count(DISTINCT event_type) AS n FROM events GROUP BY 1, 2) SELECT user_id, epoch_us(d) AS day, row_number() OVER (PARTITION BY user_id ORDER BY d)::INT AS frame_id FROM h WHERE n = 3")
def _(t):
    rows = t.events.select("user_id", "event_type", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d"))
    return tm.synchronised(rows, "d", "event_type", 3, "user_id").select("user_id", F.unix_micros("d").alias("day"), "frame_id")


# cameras see the world from a centre (v, 0, 0), turned about z; every third user's errors stand on purchase times, so some streams are exact
REMAP = f"""{EV}, pu AS (SELECT s, t, 'n' || (t % 7) AS name, avg(v) AS v FROM ev WHERE e = 'purchase' GROUP BY s, t), er AS (SELECT s, t, max(k) AS k, max(v) AS v FROM ev WHERE e = 'error' GROUP BY s, t),
so AS (SELECT s, t, 'n' || (t % 7) AS name, v AS x, (v * 37) % 6.0 - 3.0 AS a, t % 5 <> 0 AS ok FROM pu), first AS (SELECT s, min(t) AS t FROM so WHERE ok GROUP BY s),
ta AS (SELECT s, t, 'm' || (t % 11) AS name, t % 13 <> 0 AS ok FROM er WHERE s % 3 > 0 UNION ALL SELECT s, t, CASE WHEN t % 4 = 0 THEN name ELSE 'm' END, t % 4 <> 0 FROM so WHERE s % 3 = 0)"""


@query("j9_pose_remap", f"""WITH {REMAP}, bl AS (SELECT DISTINCT s, name FROM ta WHERE NOT ok), op AS (SELECT * FROM so WHERE ok AND (s, name) NOT IN (SELECT (s, name) FROM bl)),
m AS (SELECT s, coalesce((SELECT bool_and(EXISTS (SELECT 1 FROM ta WHERE ta.s = op.s AND ta.t = op.t AND ta.ok)) FROM op WHERE op.s = x.s), true) AS exact FROM (SELECT DISTINCT s FROM ta WHERE ok AND s IN (SELECT s FROM so WHERE ok)) x),
br AS (SELECT ta.s, ta.t, ta.name, (SELECT max(t) FROM so WHERE so.s = ta.s AND so.t <= ta.t AND so.ok) AS p, (SELECT min(t) FROM so WHERE so.s = ta.s AND so.t >= ta.t AND so.ok) AS n FROM ta JOIN m USING (s) WHERE ta.ok AND NOT exact),
bx AS (SELECT br.*, CASE WHEN p = n THEN 0.0 ELSE (br.t - p)::DOUBLE / (n - p) END AS f, a.x AS x0, b.x AS x1, a.a AS a0, b.a AS a1 FROM br JOIN so a ON a.s = br.s AND a.t = p JOIN so b ON b.s = br.s AND b.t = n),
r AS (SELECT s, t, name, 'interpolate' AS mode, x0 + f * (x1 - x0) AS x, {SHORT.replace("fraction", "f")} AS a FROM bx UNION ALL SELECT ta.s, ta.t, ta.name, 'exact', op.x, op.a FROM ta JOIN m USING (s) JOIN op ON op.s = ta.s AND op.t = ta.t WHERE exact AND ta.ok)
SELECT s, t, name, mode, round(-x * cos(a), 5) AS x, round(x * sin(a), 5) AS y, 0.0::DOUBLE AS z, round(cos(a), 5) AS c, round(-sin(a), 5) AS i FROM r""")
def _(t):
    ev, at = events(t), F.col("t")
    v = F.col("v")
    bought = ev.where("e = 'purchase'").groupBy("s", "t").agg(F.avg("v").alias("v")).withColumn("a", (v * 37) % 6.0 - 3.0)
    name = lambda stem, n: F.concat(F.lit(stem), (at % n).cast("string"))
    world = rt.vector(0.0, 0.0, F.sin(F.col("a") / 2), F.cos(F.col("a") / 2))
    q, p = rt.inverse_pose(world, rt.vector(v, 0.0, 0.0))
    source = bought.select("s", "t", name("n", 7).alias("name"), F.when(at % 5 != 0, p).alias("position"), F.when(at % 5 != 0, q).alias("rotation"))
    pose = lambda ok: [F.when(ok, rt.vector(0.0, 0.0, 0.0)).alias("position"), F.when(ok, rt.vector(0.0, 0.0, 0.0, 1.0)).alias("rotation")]
    target = ev.where("e = 'error' and s % 3 > 0").select("s", "t").distinct().select("s", "t", name("m", 11).alias("name"), *pose(at % 13 != 0))
    target = target.unionByName(bought.where("s % 3 = 0").select("s", "t", F.when(at % 4 == 0, name("n", 7)).otherwise("m").alias("name"), *pose(at % 4 != 0)))
    return tm.remapped_poses(target, source, "s", "t", "name", bucket=BUCKET).select("s", "t", "name", "mode", *_pose_columns())


@query("j11_hop_pairs", f"""WITH {EV}, n AS (SELECT s, k, row_number() OVER (PARTITION BY s ORDER BY t, k) AS n FROM ev),
p AS (SELECT b.s, a.k AS first, b.k AS second, h.h AS hop, b.n FROM (SELECT unnest([1, 2, 4, 6, 8]) AS h) h JOIN n b ON true JOIN n a ON a.s = b.s AND a.n = b.n - h.h),
q AS (SELECT *, row_number() OVER (PARTITION BY s, least(first, second), greatest(first, second) ORDER BY n, hop) AS r FROM p WHERE first <> second) SELECT s, first, second, hop FROM q WHERE r = 1""")
def _(t):
    return tm.hop_pairs(events(t), "s", ["t", "k"], "k", [1, 2, 4, 6, 8])


@query("j12_consecutive_edges", f"""WITH {EV}, p AS (SELECT s, k AS first, lead(k) OVER (PARTITION BY s ORDER BY t, k) AS second FROM ev), x AS (SELECT DISTINCT least(k, k + 3) AS a, greatest(k, k + 3) AS b FROM ev)
SELECT s, first, second FROM p WHERE second IS NOT NULL AND (least(first, second), greatest(first, second)) IN (SELECT (a, b) FROM x)""")
def _(t):
    ev = events(t)
    return tm.consecutive_pairs(ev, "s", ["t", "k"], "k", ev.select((F.col("k") + 3).alias("first"), F.col("k").alias("second")))


def walked(t: Tables) -> DataFrame:
    return tm.path_lengths(events(t), "s", ["t", "k"], "v")


PATH = f"""{EV}, st AS (SELECT *, coalesce(abs(v - lag(v) OVER (PARTITION BY s ORDER BY t, k)), 0) AS d FROM ev),
pl AS (SELECT *, sum(d) OVER (PARTITION BY s ORDER BY t, k ROWS UNBOUNDED PRECEDING) AS c FROM st)"""


@query("w1_path_length", f"WITH {PATH} SELECT s, k, round(c, 5) AS cum_len FROM pl")
def _(t):
    return walked(t).select("s", "k", F.round("cum_len", 5).alias("cum_len"))


@query("w2_j18_path_windows", f"""WITH {PATH}, r AS (SELECT *, round(c, 3) AS o FROM pl), x AS (SELECT s, max(o) AS total FROM r GROUP BY s),
q AS (SELECT r.s, r.k, w.w, least(greatest(o - w / 2, 0.0), total - w) AS lo FROM r JOIN x USING (s) JOIN (SELECT unnest([50.0::DOUBLE, 250.0::DOUBLE]) AS w) w ON w <= total)
SELECT q.s, q.k, q.w, count(*) AS n FROM q JOIN r ON r.s = q.s AND r.o >= q.lo AND r.o <= q.lo + q.w GROUP BY ALL HAVING count(*) >= 3""")
def _(t):
    rows = walked(t).withColumn("cum_len", F.round("cum_len", 3))
    return tm.path_windows(rows, "s", "k", [50.0, 250.0]).select("s", "k", "w", "n")


@query("w3_windowed_similarity_error")
def _(t):
    rows = walked(t).select("s", "k", F.round("cum_len", 3).alias("cum_len"), F.col("v").alias("gx"), F.sin("v").alias("gy"), F.cos(F.round("cum_len", 3)).alias("gz"))
    near = F.sin(F.col("k").cast("double"))
    rows = rows.withColumns({"ex": 2 * F.col("gx") + 1 + 0.01 * near, "ey": 2 * F.col("gy") - 3, "ez": 2 * F.col("gz")})
    zero = F.lit(0.0)
    rows = rows.withColumns({"eqx": zero, "eqy": F.sin(F.col("gx") / 100), "eqz": zero, "eqw": F.cos(F.col("gx") / 100)})
    rows = rows.withColumns({"gqx": F.sin(near / 50), "gqy": zero, "gqz": zero, "gqw": F.cos(near / 50)})
    return alignment.windowed_errors(rows, "s", "k", [60.0, 240.0])


@query("w4_context_window", f"""WITH {EV}, n AS (SELECT s, k, row_number() OVER (PARTITION BY s ORDER BY t, k) AS n, count(*) OVER (PARTITION BY s) AS m FROM ev),
b AS (SELECT *, greatest(1, least(n - 2, m - 4)) AS a FROM n)
SELECT b.s, b.k, (b.n - b.a)::INT AS centre, string_agg(c.k::VARCHAR, ',' ORDER BY c.n) AS members FROM b JOIN n c ON c.s = b.s AND c.n BETWEEN b.a AND b.a + 4 GROUP BY b.s, b.k, b.n, b.a""")
def _(t):
    return tm.context_window(events(t), "s", ["t", "k"], "k", 5).select("s", "k", "centre", F.array_join("members", ",").alias("members"))


@query("w5_triplets", f"""WITH {EV}, n AS (SELECT s, k, t, e, lag(k) OVER o AS prev, lead(k) OVER o AS next, lag(t) OVER o AS t0, lead(t) OVER o AS t2, lag(e) OVER o AS e0, lead(e) OVER o AS e2 FROM ev WINDOW o AS (PARTITION BY s ORDER BY t, k))
SELECT s, prev, k AS key, next, t - t0 AS dt_prev, t2 - t AS dt_next FROM n WHERE prev IS NOT NULL AND next IS NOT NULL AND e <> 'error' AND e0 <> 'error' AND e2 <> 'error'""")
def _(t):
    return tm.triplets(events(t), "s", "t", "k", F.col("e") != "error")


@query("w6_outer_median_motion", f"""WITH {EV}, n AS (SELECT s, k, [abs(lead(v, -3) OVER o - lead(v, -4) OVER o), abs(lead(v, -2) OVER o - lead(v, -3) OVER o), abs(lead(v, -1) OVER o - lead(v, -2) OVER o), abs(lead(v, 2) OVER o - lead(v, 1) OVER o), abs(lead(v, 3) OVER o - lead(v, 2) OVER o), abs(lead(v, 4) OVER o - lead(v, 3) OVER o)] AS x FROM ev WINDOW o AS (PARTITION BY s ORDER BY t, k))
SELECT s, k, round(CASE WHEN list_count(x) < 6 THEN 0.0 ELSE (list_sort(x)[3] + list_sort(x)[4]) / 2 END, 6) AS scale FROM n""")
def _(t):
    return tm.outer_motion(events(t), "s", ["t", "k"], "k", "v").select("s", "k", F.round("scale", 6).alias("scale"))


@query("w7_acceleration_residual", f"""WITH {EV}, n AS (SELECT s, k, v, lag(v) OVER o AS p, lead(v) OVER o AS n, (t - lag(t) OVER o) / 3.6e9 AS d0, (lead(t) OVER o - t) / 3.6e9 AS d1 FROM ev WINDOW o AS (PARTITION BY s ORDER BY t, k))
SELECT s, k AS key, round(2 / (d0 + d1) * ((n - v) / d1 - (v - p) / d0), 4) AS residual FROM n WHERE p IS NOT NULL AND n IS NOT NULL AND d0 > 0.05 AND d1 > 0.05""")
def _(t):
    found = tm.acceleration(events(t), "s", "t", "k", "v", 3.6e9)
    near = tm.triplets(events(t), "s", "t", "k", F.lit(True)).where("dt_prev / 3.6e9D > 0.05D and dt_next / 3.6e9D > 0.05D").select("s", "key")
    return found.join(near, ["s", "key"]).select("s", "key", F.round("residual", 4).alias("residual"))


@query("w8_bidirectional_smoothing")
def _(t):
    return scans.smoothed(events(t), "s", "t", "v", 3.6e9)


@query("w9_support_rank", "WITH n AS (SELECT l_partkey, l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS r FROM lineitem) SELECT l_partkey, l_orderkey, l_linenumber FROM n WHERE r <= 3")
def _(t):
    return tm.support_rank(t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber"), "l_partkey", "l_orderkey", 3)


@query("w10_rank_gap_pairs", """WITH r AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY regexp_replace(s_name, '[0-9]+', ''), s_suppkey) AS n FROM supplier), p AS (SELECT DISTINCT least(l_suppkey, (l_suppkey * 7) % 50 + 1) AS first, greatest(l_suppkey, (l_suppkey * 7) % 50 + 1) AS second FROM lineitem)
SELECT first, second, abs(a.n - b.n)::INT AS gap FROM p JOIN r a ON a.k = first JOIN r b ON b.k = second WHERE abs(a.n - b.n) > 10""")
def _(t):
    other = (F.col("l_suppkey") * 7) % 50 + 1
    pairs = t.lineitem.select(F.least("l_suppkey", other).alias("first"), F.greatest("l_suppkey", other).alias("second")).distinct()
    natural = F.struct(F.regexp_replace("s_name", "[0-9]+", ""), "s_suppkey")
    return tm.rank_gap_pairs(pairs, t.supplier, "s_suppkey", natural, 10)


@query("w11_every_kth", f"WITH {EV}, n AS (SELECT s, k, row_number() OVER (PARTITION BY s ORDER BY t, k) - 1 AS n, ceil(count(*) OVER (PARTITION BY s) / 20) AS m FROM ev) SELECT s, k FROM n WHERE n % m = 0")
def _(t):
    return tm.every_kth(events(t).select("s", "t", "k"), "s", ["t", "k"], 20).select("s", "k")


@query("w12_linspace_rows", f"WITH {EV}, n AS (SELECT s, k, row_number() OVER (PARTITION BY s ORDER BY t, k) - 1 AS n, count(*) OVER (PARTITION BY s) AS m FROM ev), i AS (SELECT unnest(range(10)) AS i) SELECT s, k FROM n WHERE m <= 10 OR EXISTS (SELECT 1 FROM i WHERE i * (m - 1) // 9 = n)")
def _(t):
    return tm.linspace_rows(events(t).select("s", "t", "k"), "s", ["t", "k"], 10).select("s", "k")


@query("w13_chunk_and_expand", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders), c AS (SELECT *, (n - 1) // 300 AS chunk FROM n), f AS (SELECT o_orderpriority, chunk, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM c WHERE chunk < 20 GROUP BY 1, 2 HAVING count(*) = 300)
SELECT f.o_orderpriority, f.chunk::INT AS chunk, count(*) AS n FROM f JOIN orders o ON o.o_orderpriority = f.o_orderpriority AND o.o_orderkey BETWEEN lo AND hi GROUP BY 1, 2""")
def _(t):
    chunks = tm.fixed_chunks(t.orders, "o_orderpriority", ["o_orderdate", "o_orderkey"], 300, 20)
    spans = chunks.groupBy("o_orderpriority", "chunk").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    return spans.join(t.orders.select("o_orderpriority", "o_orderkey"), "o_orderpriority").where("o_orderkey between lo and hi").groupBy("o_orderpriority", "chunk").agg(F.count("*").alias("n"))


@query("w14_forward_fill", f"WITH {EV} SELECT s, k, last_value(CASE WHEN e = 'purchase' THEN v END IGNORE NULLS) OVER (PARTITION BY s ORDER BY t, k ROWS UNBOUNDED PRECEDING) AS filled FROM ev")
def _(t):
    return tm.forward_fill(events(t), "s", ["t", "k"], F.when(F.col("e") == "purchase", F.col("v"))).select("s", "k", "filled")


@query("w15_cubic_spline")
def _(t):
    return scans.spline(events(t).withColumn("t", F.col("t") / 3.6e9), "s", "t", "v", 3)


@query("w18_first_appearance", "WITH f AS (SELECT l_partkey, min({'f': l_orderkey, 'p': l_linenumber}) AS x FROM lineitem WHERE l_quantity > 40 GROUP BY 1) SELECT x.f AS l_orderkey, p_partkey AS l_partkey, x.p AS l_linenumber FROM part LEFT JOIN f ON p_partkey = l_partkey")
def _(t):
    seen = t.lineitem.where("l_quantity > 40")
    return tm.first_appearance(seen, "l_partkey", "l_orderkey", "l_linenumber", t.part.select(F.col("p_partkey").alias("l_partkey")))


@query("w19_motion_ratio", f"""WITH {EV}, d AS (SELECT s, abs(v - lag(v) OVER (PARTITION BY s ORDER BY t, k)) AS d FROM ev), q AS (SELECT s, quantile_cont(d, 0.9) / median(d) FILTER (d > 0) AS r FROM d WHERE d IS NOT NULL GROUP BY s)
SELECT s, round(r, 6) AS ratio, (CASE WHEN r <= 0.02 THEN 0 ELSE least(10, greatest(0, ceil(round(r, 6) * 2))) END)::INT AS frames FROM q""")
def _(t):
    from pyspark.sql import Window

    d = events(t).select("s", F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("s").orderBy("t", "k"))).alias("d")).where("d is not null")
    q = d.groupBy("s").agg((F.percentile("d", F.lit(0.9)) / F.median(F.when(F.col("d") > 0, F.col("d")))).alias("r"))
    frames = F.when(F.col("r") <= 0.02, 0).otherwise(F.least(F.lit(10), F.greatest(F.lit(0), F.ceil(F.round("r", 6) * 2)))).cast("int")
    return q.select("s", F.round("r", 6).alias("ratio"), frames.alias("frames"))


@query("w20_unit_inference", f"WITH {EV}, d AS (SELECT s, t - lag(t) OVER (PARTITION BY s ORDER BY t, k) AS d FROM ev), m AS (SELECT s, median(d) AS m FROM d WHERE d IS NOT NULL GROUP BY s), c AS (SELECT s, list_filter([1000000, 60000000, 3600000000], lambda u: m / u BETWEEN 0.5 AND 100.0) AS f FROM m) SELECT s, CASE WHEN len(f) = 1 THEN f[1] END AS unit FROM c")
def _(t):
    return tm.unit_of_times(events(t), "s", "t", "k", (1_000_000, 60_000_000, 3_600_000_000), 0.5, 100.0)


@query("w21_even_subsample", """WITH p AS (SELECT l_suppkey * 100000 + l_partkey AS pair, l_suppkey % 20 AS camera FROM lineitem GROUP BY ALL HAVING sum(l_quantity) > 20), q AS (SELECT * FROM p WHERE camera <> 7 AND pair NOT IN (SELECT l_suppkey * 100000 + l_partkey FROM lineitem WHERE l_returnflag = 'A')),
n AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY pair) - 1 AS n, count(*) OVER (PARTITION BY camera) AS m FROM q), i AS (SELECT unnest(range(25)) AS i), c AS (SELECT camera, pair FROM n WHERE m <= 25 OR EXISTS (SELECT 1 FROM i WHERE i * (m - 1) // 24 = n)),
r AS (SELECT camera, pair, l_orderkey * 10 + l_linenumber AS match, row_number() OVER (PARTITION BY pair ORDER BY l_orderkey * 10 + l_linenumber) - 1 AS n, count(*) OVER (PARTITION BY pair) AS m FROM c JOIN lineitem ON pair = l_suppkey * 100000 + l_partkey), k AS (SELECT unnest(range(3)) AS i)
SELECT camera, pair, match FROM r WHERE m <= 3 OR EXISTS (SELECT 1 FROM k WHERE i * (m - 1) // 2 = n)""")
def _(t):
    from sparkloom.operators.capture import even_calibration_matches

    rows = t.lineitem.withColumn("pair", F.col("l_suppkey") * 100000 + F.col("l_partkey"))
    camera = (F.col("l_suppkey") % 20).alias("camera1")
    pairs = rows.groupBy("pair", camera).agg((F.sum("l_quantity") > 20).alias("valid")).withColumn("camera2", F.when(F.col("camera1") == 7, 8).otherwise(F.col("camera1")))
    matches = rows.select("pair", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("match"))
    return even_calibration_matches(pairs, matches, rows.where("l_returnflag = 'A'"), "pair", "match", 25, 3)


@query("w22_multi_length_chunks", """WITH n AS (SELECT s, k, row_number() OVER (PARTITION BY s ORDER BY t, k) AS n FROM (SELECT user_id AS s, epoch_us(ts) AS t, event_id AS k FROM events)), l AS (SELECT *, (n - 1) // l AS chunk FROM n, (SELECT unnest([5, 10, 25]) AS l)), c AS (SELECT *, count(*) OVER (PARTITION BY s, l, chunk) AS m FROM l WHERE chunk < 50)
SELECT s, l AS length, chunk::INT AS chunk, min(k) AS least, max(k) AS greatest FROM c WHERE m = l GROUP BY 1, 2, 3""")
def _(t):
    rows = tm.fixed_chunks(events(t), "s", ["t", "k"], 5, 50, (5, 10, 25))
    return rows.groupBy("s", "length", "chunk").agg(F.min("k").alias("least"), F.max("k").alias("greatest"))


@query("w23_keyframe_plan", f"""WITH {EV}, c AS (SELECT s, e, k AS first, lead(k) OVER (PARTITION BY s, e ORDER BY t, k) AS second FROM ev), d AS (SELECT s, e, t // 86400000000 AS d, min(k) AS k FROM ev GROUP BY ALL)
SELECT s, first, second, false AS same_frame FROM c WHERE second IS NOT NULL UNION ALL SELECT a.s, a.k, b.k, true FROM d a JOIN d b ON a.s = b.s AND a.d = b.d AND a.e < b.e""")
def _(t):
    ev = events(t)
    step = tm.consecutive_pairs(ev.withColumn("c", F.concat_ws("/", "s", "e")), "c", ["t", "k"], "k").select(F.split("c", "/")[0].cast("bigint").alias("s"), "first", "second", F.lit(False).alias("same_frame"))
    day = ev.groupBy("s", "e", F.floor(F.col("t") / 86_400_000_000).alias("d")).agg(F.min("k").alias("k"))
    a, b = day.select("s", "d", F.col("e").alias("ea"), F.col("k").alias("first")), day.select("s", "d", F.col("e").alias("eb"), F.col("k").alias("second"))
    return step.unionByName(a.join(b, ["s", "d"]).where("ea < eb").select("s", "first", "second", F.lit(True).alias("same_frame")))


@query("f10_chained_gauges", f"""WITH RECURSIVE {EV}, n AS (SELECT s, k, 1 + (v % 7 - 3) / 100 AS c, v / 100 AS a, v % 5 AS x, row_number() OVER (PARTITION BY s ORDER BY t DESC, k DESC) AS i FROM ev),
g AS (SELECT s, k, i, c, a, x * 1.0 AS x, 0.5::DOUBLE AS y FROM n WHERE i = 1 UNION ALL SELECT n.s, n.k, n.i, g.c * n.c, g.a + n.a, g.x + g.c * (cos(g.a) * n.x - sin(g.a) * 0.5), g.y + g.c * (sin(g.a) * n.x + cos(g.a) * 0.5) FROM g JOIN n ON n.s = g.s AND n.i = g.i + 1)
SELECT s, k, round(c, 6) AS scale, round(cos(a), 5) AS c, round(sin(a), 5) AS i, round(x, 4) AS x, round(y, 4) AS y FROM g""")
def _(t):
    v, zero = F.col("v"), F.lit(0.0)
    parts = {"scale": 1 + (v % 7 - 3) / 100, "qx": zero, "qy": zero, "qz": F.sin(v / 200), "qw": F.cos(v / 200), "tx": v % 5, "ty": F.lit(0.5), "tz": zero}
    found = scans.chained_gauges(events(t).select("s", "t", "k", *[c.alias(n) for n, c in parts.items()]), "s", ["t", "k"])
    c, i = F.col("world_qw") * F.col("world_qw") - F.col("world_qz") * F.col("world_qz"), 2 * F.col("world_qz") * F.col("world_qw")
    return found.select("s", "k", F.round("world_scale", 6).alias("scale"), F.round(c, 5).alias("c"), F.round(i, 5).alias("i"), F.round("world_tx", 4).alias("x"), F.round("world_ty", 4).alias("y"))
