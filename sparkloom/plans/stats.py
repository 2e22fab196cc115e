"""Queries of error curves, group statistics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.scalars import set_digest
from sparkloom.operators import capture as cp
from sparkloom.operators import stats as st
from sparkloom.plans.registry import digest_sql, query


def auc_sql(source: str, by: str, thresholds: str) -> str:
    """SQL of the curve over ``source`` with columns ``by`` and e."""
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}," if by else ""
    return f"""ranked AS (SELECT {cols} e, row_number() OVER ({part} ORDER BY e) AS i, count(*) OVER ({part}) AS n, coalesce(lag(e) OVER ({part} ORDER BY e), 0) AS pe FROM ({source})),
auc AS (SELECT {cols} t AS threshold, round_even((coalesce(sum(CASE WHEN e < t THEN (e - pe) * (i / n + (i - 1) / n) / 2 END), 0) + (t - coalesce(max(CASE WHEN e < t THEN e END), 0)) * coalesce(max(CASE WHEN e < t THEN i / n END), 0)) / t, 4) AS auc,
round_even(avg((e <= t)::INT), 4) AS recall FROM ranked, (SELECT unnest({thresholds}) AS t) GROUP BY {cols} t)"""


@query("a1_a2_auc_recall", f"WITH {auc_sql('SELECT event_type, value AS e FROM events', 'event_type', '[1.0::DOUBLE, 5.0, 20.0, 100.0]')} SELECT * FROM auc")
def _(t):
    return st.error_auc(t.events, ["event_type"], "value", [1.0, 5.0, 20.0, 100.0])


@query("a3_finite_auc", f"WITH {auc_sql('SELECT user_id, value AS e FROM events WHERE value < 60', 'user_id', '[5.0::DOUBLE, 25.0]')} SELECT user_id, threshold, auc FROM auc")
def _(t):
    rows = t.events.withColumn("e", F.when(F.col("value") < 60, F.col("value")).otherwise(float("inf")))
    return st.error_auc(st.finite(rows, "e"), ["user_id"], "e", [5.0, 25.0]).drop("recall")


@query("a4_error_summary", "SELECT event_type, round(avg(value) FILTER (value < 100), 6) AS mean, round(median(value) FILTER (value < 100), 6) AS median, count(*) AS n FROM events GROUP BY 1")
def _(t):
    rows = t.events.withColumn("e", F.when(F.col("value") < 100, F.col("value")).otherwise(st.MISSING))
    return st.error_summary(rows, ["event_type"], "e").select("event_type", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "n")


@query("a5_missing_imputed", "SELECT p_partkey, coalesce(min(l_extendedprice), 1e6) AS e FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 49 GROUP BY 1")
def _(t):
    found = t.lineitem.where("l_quantity > 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_extendedprice").alias("e"))
    return st.imputed(t.part.select("p_partkey"), found, ["p_partkey"], "e")


@query("a5_auc_errors", """WITH f AS (SELECT l_suppkey AS s, l_orderkey * 10 + l_linenumber AS n, min(abs(l_extendedprice - 30000)) AS e, bool_or(l_returnflag <> 'A') AS have FROM lineitem GROUP BY 1, 2), g AS (SELECT s, n, e, have, s % 7 * 2.5::DOUBLE AS length FROM f),
w AS (SELECT s, w.w, n, e / w.w AS e FROM g JOIN (SELECT unnest([10.0::DOUBLE, 50.0::DOUBLE]) AS w) w ON (s + w.w) % 3 <> 0 WHERE n % 4 <> 0)
SELECT s, NULL::DOUBLE AS "window", n, round(CASE WHEN have THEN e ELSE 1e6 END / length, 4) AS error FROM g WHERE length > 0 UNION ALL SELECT s, w, n, round(e, 4) FROM w
UNION ALL SELECT g.s, d.w, g.n, 1e6 FROM g JOIN (SELECT DISTINCT s, w FROM w) d USING (s) WHERE (g.s, d.w, g.n) NOT IN (SELECT (s, w, n) FROM w)""")
def _(t):
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    full = t.lineitem.groupBy(F.col("l_suppkey").alias("s"), n.alias("n")).agg(F.min(F.abs(F.col("l_extendedprice") - 30000)).alias("error"), F.bool_or(F.col("l_returnflag") != "A").alias("have")).withColumn("path_length", F.col("s") % 7 * 2.5)
    windows = full.where("n % 4 <> 0").withColumn("window", F.explode(F.array(F.lit(10.0), F.lit(50.0)))).where((F.col("s") + F.col("window")) % 3 != 0)
    found = st.auc_errors(full, windows.select("s", "window", "n", (F.col("error") / F.col("window")).alias("error")), "s", "n")
    return found.select("s", "window", "n", F.round("error", 4).alias("error"))


@query("a6_ate_statistics", "SELECT event_type, round(sqrt(avg(value * value)), 6) AS rmse, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(sum(value * value), 3) AS sse FROM events GROUP BY 1")
def _(t):
    s = st.ate_statistics(t.events, ["event_type"], "value")
    return s.select("event_type", *[F.round(c, 6).alias(c) for c in ("rmse", "mean", "median", "std")], "min", "max", F.round("sse", 3).alias("sse"))


REPORT = "SELECT o_orderpriority, o_orderstatus, abs(o_totalprice - 200000) / 10000 AS e FROM orders"


@query("a7_a8_scene_report", f"""WITH {auc_sql(REPORT, 'o_orderpriority, o_orderstatus', '[2.0::DOUBLE, 10.0]')}, {auc_sql(REPORT, 'o_orderpriority', '[2.0::DOUBLE, 10.0]').replace('ranked', 'ranked2').replace('auc AS', 'auc2 AS')}
SELECT o_orderpriority, threshold, round(avg(a.auc), 6) AS mean_auc, count(*) AS targets, max(b.auc) AS pooled_auc FROM auc a JOIN auc2 b USING (o_orderpriority, threshold) GROUP BY ALL""")
def _(t):
    rows = t.orders.withColumn("e", F.abs(F.col("o_totalprice") - 200000) / 10000)
    return st.scene_report(rows, "o_orderpriority", "o_orderstatus", "e", [2.0, 10.0]).withColumn("mean_auc", F.round("mean_auc", 6))


@query("a7_report_lines", f"""WITH {auc_sql(REPORT, 'o_orderpriority, o_orderstatus', '[2.0::DOUBLE, 10.0]')}, d AS (SELECT o_orderpriority, count_if(o_totalprice > 100000) AS completed, count_if(o_totalprice <= 100000) AS failed FROM orders GROUP BY 1)
SELECT o_orderpriority, threshold, round(avg(auc) * 100, 4) AS percent, any_value(completed)::BIGINT AS completed, any_value(failed)::BIGINT AS failed FROM auc JOIN d USING (o_orderpriority) WHERE threshold < 10 GROUP BY 1, 2""")
def _(t):
    rows = t.orders.withColumn("e", F.abs(F.col("o_totalprice") - 200000) / 10000)
    cases = t.orders.select("o_orderpriority", (F.col("o_totalprice") > 100000).alias("completed"))
    return st.report_lines(rows, cases, "o_orderpriority", "o_orderstatus", "e", [2.0, 10.0]).withColumn("percent", F.round("percent", 4))


@query("a8_summed_counts", "SELECT l_shipmode AS scene, l_returnflag AS key, sum(l_linenumber)::BIGINT AS total, count(*) AS trajectories FROM (SELECT l_linestatus AS l_shipmode, l_returnflag, CASE WHEN l_tax > 0.01 THEN l_linenumber END AS l_linenumber FROM lineitem) WHERE l_linenumber IS NOT NULL GROUP BY 1, 2")
def _(t):
    counts = t.lineitem.select(F.col("l_linestatus").alias("scene"), F.col("l_returnflag").alias("key"), F.when(F.col("l_tax") > 0.01, F.col("l_linenumber")).alias("n"))
    return st.summed_counts(counts, "scene", "key", "n")


@query("a9_grand_average", f"""WITH {auc_sql(REPORT, 'o_orderpriority', '[2.0::DOUBLE, 10.0]')}, m AS (SELECT o_orderpriority, avg(abs(o_totalprice - 200000)) AS ate FROM orders GROUP BY 1)
SELECT threshold, round(avg(auc), 6) AS auc, (SELECT round(avg(ate), 4) FROM m) AS ate FROM auc GROUP BY 1""")
def _(t):
    rows = t.orders.withColumn("e", F.abs(F.col("o_totalprice") - 200000) / 10000)
    grand = st.error_auc(rows, ["o_orderpriority"], "e", [2.0, 10.0]).groupBy("threshold").agg(F.round(F.avg("auc"), 6).alias("auc"))
    ate = rows.groupBy("o_orderpriority").agg(F.avg(F.col("e") * 10000).alias("m")).agg(F.round(F.avg("m"), 4).alias("ate"))
    return grand.crossJoin(F.broadcast(ate))


GROUPS = "CASE WHEN contains(lower(p_name), 'small') THEN 'easy' WHEN contains(lower(p_name), 'red') THEN 'medium' WHEN contains(lower(p_name), 'blue') THEN 'hard' ELSE 'other' END"


@query("a10_difficulty_groups", f"SELECT {GROUPS} AS difficulty, round(avg(p_retailprice), 4) AS mean, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT 'all', round(avg(p_retailprice), 4), count(*) FROM part")
def _(t):
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("p_name"), "small", "easy"), "red", "medium"), "blue", "hard")
    named = t.part.withColumn("difficulty", st.difficulty(name))
    total = [F.round(F.avg("p_retailprice"), 4).alias("mean"), F.count("*").alias("n")]
    return named.groupBy("difficulty").agg(*total).unionByName(named.agg(*total).withColumn("difficulty", F.lit("all")))


@query("a11_median_scale", "SELECT l_suppkey, round(coalesce(median(l_extendedprice / l_quantity) FILTER (l_quantity > 25), 1.0), 6) AS scale FROM lineitem GROUP BY 1")
def _(t):
    ratio = F.when(F.col("l_quantity") > 25, F.col("l_extendedprice") / F.col("l_quantity"))
    return st.median_scale(t.lineitem, ["l_suppkey"], ratio).select("l_suppkey", F.round("scale", 6).alias("scale"))


@query("a12_median_log_scale", "SELECT l_suppkey, round(median(ln(greatest(l_extendedprice, 1e-6) / greatest(l_discount, 1e-6))) FILTER (l_extendedprice > 0 AND l_discount > 0), 6) AS log_scale FROM lineitem GROUP BY 1")
def _(t):
    return st.median_log_scale(t.lineitem, ["l_suppkey"], F.col("l_extendedprice"), F.col("l_discount")).select("l_suppkey", F.round("log_scale", 6).alias("log_scale"))


@query("a13_mad_sigma", "SELECT l_suppkey, round(greatest(1.4826 * mad(l_extendedprice), 1e-3), 4) AS sigma FROM lineitem GROUP BY 1")
def _(t):
    return st.mad_sigma(t.lineitem, ["l_suppkey"], "l_extendedprice").select("l_suppkey", F.round("sigma", 4).alias("sigma"))


LOOP = "l_returnflag = 'R'"


@query("a14_observation_counts", f"""WITH r AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE NOT {LOOP} GROUP BY 1), l AS (SELECT l_suppkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey FROM lineitem WHERE {LOOP}) GROUP BY 1)
SELECT l_suppkey, coalesce(r.n, 0) AS regular, coalesce(l.n, 0) AS loop FROM r FULL JOIN l USING (l_suppkey)""")
def _(t):
    return st.observation_counts(t.lineitem, "l_orderkey", "l_suppkey", "l_partkey", F.expr(LOOP))


@query("a15_selection_counts", f"SELECT count_if(NOT {LOOP})::BIGINT AS regular, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey FROM lineitem WHERE {LOOP})) AS loop, count(DISTINCT l_orderkey) AS points, count(*) > 0 AS any_support FROM lineitem")
def _(t):
    return st.selection_counts(t.lineitem, "l_orderkey", "l_suppkey", "l_partkey", F.expr(LOOP))


@query("a16_edge_support", "SELECT least(l_suppkey, l_partkey % 100) AS first, greatest(l_suppkey, l_partkey % 100) AS second, count(DISTINCT (l_orderkey, l_linenumber)) AS matches, round(coalesce(sum(l_discount / nullif(l_tax, 0)), 0), 4) AS score FROM lineitem GROUP BY 1, 2")
def _(t):
    rows = t.lineitem.withColumn("b", F.col("l_partkey") % 100).withColumn("q", F.coalesce(F.try_divide("l_discount", "l_tax"), F.lit(float("inf"))))
    return st.edge_support(rows, "l_suppkey", "b", ["l_orderkey", "l_linenumber"], "q").withColumn("score", F.round("score", 4))


@query("a17_point_table", "SELECT l_partkey, round(avg(l_quantity), 6) AS x, round(avg(l_discount), 6) AS y, count(*) AS n_obs FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 6).alias("x"), F.round(F.avg("l_discount"), 6).alias("y"), F.count("*").alias("n_obs"))


@query("a18_preceding_support", """WITH d AS (SELECT DISTINCT l_suppkey AS f, l_partkey AS p FROM lineitem), s AS (SELECT a.f, b.f AS before, count(DISTINCT CASE WHEN a.p = b.p THEN a.p END) AS shared FROM d a JOIN d b ON b.f BETWEEN a.f - 4 AND a.f - 1 AND a.p = b.p GROUP BY 1, 2),
g AS (SELECT a.f, b.f AS before FROM (SELECT DISTINCT f FROM d) a JOIN (SELECT DISTINCT f FROM d) b ON b.f BETWEEN a.f - 4 AND a.f - 1), j AS (SELECT g.f, g.before, coalesce(shared, 0) AS shared FROM g LEFT JOIN s ON s.f = g.f AND s.before = g.before)
SELECT f AS l_suppkey, before, shared, round(coalesce(shared / nullif(max(shared) OVER (PARTITION BY f), 0), 0), 6) AS share FROM j""")
def _(t):
    return st.preceding_support(t.lineitem, "l_suppkey", "l_partkey", 4).withColumn("share", F.round("share", 6))


@query("a19_path_unit", "WITH d AS (SELECT user_id, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS s FROM events) SELECT user_id, round(coalesce(median(s) FILTER (s > 1e-9), CASE WHEN max(value) > min(value) THEN (max(value) - min(value)) / (count(*) - 1) END, 1.0), 6) AS unit FROM d GROUP BY 1")
def _(t):
    return st.path_unit(t.events, "user_id", ["ts", "event_id"], "value").withColumn("unit", F.round("unit", 6))


QUALITY = """r AS (SELECT l_partkey AS p, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 + 1 AS z FROM lineitem), u AS (SELECT p, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM r)),
s AS (SELECT p, sum(1 - x * x) AS a, sum(1 - y * y) AS d, sum(1 - z * z) AS f, sum(-x * y) AS b, sum(-x * z) AS c, sum(-y * z) AS e FROM u GROUP BY p),
q AS (SELECT p, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det, (d * f - e * e) + (a * f - c * c) + (a * d - b * b) AS tr FROM s), k AS (SELECT p, CASE WHEN det > 1e-9 THEN tr / det ELSE 'inf'::DOUBLE END AS score FROM q)"""


def quality(t):
    rays = t.lineitem.select(F.col("l_partkey").alias("p"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100 + 1).alias("z"))
    return st.point_quality(rays, "p", "x", "y", "z")


@query("a20_v12_point_quality", f"WITH {QUALITY} SELECT p, round(score, 6) AS score, row_number() OVER (ORDER BY score, p) <= (SELECT count(*) FROM k) * 30 // 100 AS kept FROM k")
def _(t):
    q = quality(t)
    kept = st.lowest_share(q, "p", "score", 30.0).select("p", F.lit(True).alias("kept"))
    return q.join(kept, "p", "left").select("p", F.round("score", 6).alias("score"), F.coalesce("kept", F.lit(False)).alias("kept"))


@query("a21_kernel_density", """WITH p AS (SELECT l_suppkey AS g, l_orderkey * 8 + l_linenumber AS k, l_quantity AS x, l_discount * 100 AS y FROM lineitem), d AS (SELECT a.g, a.k, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.g = b.g)
SELECT g, k, round(sum(exp(-d * d / 2)), 6) AS density FROM d WHERE d <= 6 AND (d >= 1.5 OR d <= 1e-7) GROUP BY g, k""")
def _(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("g"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return st.kernel_density(rows, "g", "k", "x", "y", 1.0, 1.5).withColumn("density", F.round("density", 6))


@query("a22_match_summary", f"SELECT l_suppkey, count(*) AS matches, count(DISTINCT l_partkey) AS parts, {digest_sql("(l_partkey || ':' || l_orderkey)")} AS digest FROM lineitem WHERE l_quantity > 45 GROUP BY 1")
def _(t):
    rows = t.lineitem.where("l_quantity > 45").groupBy("l_suppkey")
    text = F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_orderkey").cast("string"))
    return rows.agg(F.count("*").alias("matches"), F.count_distinct("l_partkey").alias("parts"), set_digest(text).alias("digest"))


@query("a23_track_summary", f"WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT n AS track_length, count(*) AS tracks, {digest_sql('l_orderkey::VARCHAR')} AS digest FROM n GROUP BY 1")
def _(t):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("track_length"))
    return n.groupBy("track_length").agg(F.count("*").alias("tracks"), set_digest(F.col("l_orderkey").cast("string")).alias("digest"))


@query("a24_scale_stats", "SELECT count(*) AS n, round(min(r), 6) AS min, round(max(r), 6) AS max, round(avg(r), 6) AS mean, round(median(r), 6) AS median FROM (SELECT l_extendedprice / l_quantity AS r FROM lineitem WHERE l_quantity > 0)")
def _(t):
    r = t.lineitem.where("l_quantity > 0").select((F.col("l_extendedprice") / F.col("l_quantity")).alias("r"))
    rest = r.agg(F.count("*").alias("n"), *[F.round(f("r"), 6).alias(c) for c, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    return rest.crossJoin(st.whole_median(r, "r").select(F.round("median", 6).alias("median")))


@query("a25_distinct_undirected", "SELECT DISTINCT least(l_suppkey, l_partkey) AS first, greatest(l_suppkey, l_partkey) AS second FROM lineitem")
def _(t):
    return t.lineitem.select(F.least("l_suppkey", "l_partkey").alias("first"), F.greatest("l_suppkey", "l_partkey").alias("second")).distinct()


@query("a26_argmax_per_target", "SELECT l_partkey, l_orderkey, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_orderkey) AS r FROM lineitem) WHERE r = 1")
def _(t):
    return st.best_source(t.lineitem, "l_partkey", "l_orderkey", "l_discount")


@query("a27_uniform_median", "SELECT p_type, round(median((p_retailprice + p_size) / 2), 6) AS focal, count(*) AS n, substr(p_type, 1, 3) AS model, length(p_type)::INT AS size FROM part GROUP BY 1")
def _(t):
    rows = t.part.withColumn("model", F.substring("p_type", 1, 3)).withColumn("size", F.length("p_type"))
    return cp.initial_focals(rows, "p_type", "p_retailprice", "p_size", ["model", "size"]).withColumn("focal", F.round("focal", 6))


@query("a28_prior_rows", """WITH o AS (SELECT s_nationkey AS camera, s_suppkey AS position, 1000 + s_nationkey + s_suppkey / 2.0 AS focal, (3.0 + s_suppkey % 4) AS std FROM supplier)
SELECT camera, string_agg(round(focal, 2)::DECIMAL(12, 2) || ':' || round(std / focal, 6)::DECIMAL(12, 6), ',' ORDER BY position) AS priors FROM o GROUP BY 1""")
def _(t):
    s = t.supplier
    cameras = s.select(F.col("s_nationkey").alias("camera")).distinct().withColumns({"width": F.lit(640), "height": F.lit(480)})
    images = s.select(F.col("s_name").alias("image"), F.col("s_nationkey").alias("camera"), F.col("s_suppkey").alias("position"))
    std = F.array((F.col("s_suppkey") % 4 + 5).cast("double"), (F.col("s_suppkey") % 4 + 3).cast("double"))
    seen = s.select(F.col("s_name").alias("image"), F.col("s_nationkey").alias("camera"), (F.lit(1000.0) + F.col("s_nationkey")).alias("fx"), (F.lit(1000.0) + F.col("s_nationkey") + F.col("s_suppkey")).alias("fy"), std.alias("std"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    text = lambda r: F.concat(F.round(r["focal"], 2).cast("decimal(12,2)").cast("string"), F.lit(":"), F.round(r["sigma"], 6).cast("decimal(12,6)").cast("string"))
    return cp.focal_priors(seen, cameras, images).select("camera", F.array_join(F.transform("rows", text), ",").alias("priors"))


@query("a29_totals", "SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS pairs, count_if(l_linestatus = 'O')::BIGINT AS valid, count_if(l_quantity > 25)::BIGINT AS inliers, count_if(l_returnflag = 'R')::BIGINT AS loops FROM lineitem")
def _(t):
    return t.lineitem.agg(F.count("*").alias("rows"), F.count_distinct("l_orderkey").alias("pairs"), F.count_if(F.col("l_linestatus") == "O").alias("valid"), F.count_if(F.col("l_quantity") > 25).alias("inliers"), F.count_if(F.expr(LOOP)).alias("loops"))


@query("a30_extents", "SELECT l_returnflag, round(max(l_quantity * 0.6 + l_tax * 80) - min(l_quantity * 0.6 + l_tax * 80), 6) AS right, round(max(l_discount) - min(l_discount), 6) AS up FROM lineitem GROUP BY 1")
def _(t):
    found = cp.extents(t.lineitem, "l_returnflag", ["l_quantity", "l_tax", "l_discount"], {"right": (0.6, 80.0, 0.0), "up": (0.0, 0.0, 1.0)})
    return found.select("l_returnflag", F.round("right", 6).alias("right"), F.round("up", 6).alias("up"))


#: The points lie in the plane of (1, 2, 3) and (0, 1, -1), whose normal is (5, -1, -1).
@query("a30_path_up", "SELECT l_suppkey AS g, round(5 / sqrt(27.0), 4) AS ux, round(-1 / sqrt(27.0), 4) AS uy, round(-1 / sqrt(27.0), 4) AS uz FROM lineitem GROUP BY 1")
def _(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_quantity") * 2 + F.col("l_linenumber")).alias("y"), (F.col("l_quantity") * 3 - F.col("l_linenumber")).alias("z"))
    return cp.path_up(rows, "g", "x", "y", "z").select("g", *[F.round(c, 4).alias(c) for c in ("ux", "uy", "uz")])
