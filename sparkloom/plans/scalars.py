"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import cameras
from sparkloom.functions import scalars as sc
from sparkloom.operators import alignment, capture, content, inliers, rasters
from sparkloom.operators import pairs as pr
from sparkloom.plans.registry import digest_sql, query


@query("f1_name_timestamps", "SELECT event_id, user_id + event_id % 1000 / 1000.0::DOUBLE AS seconds, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id::BIGINT * 1000000000 + event_id % 1000 * 1000000 END AS ns FROM events WHERE event_type <> 'view' UNION ALL SELECT event_id, 0.0, NULL FROM events WHERE event_type = 'view'")
def _(t):
    text = F.concat_ws(".", F.col("user_id").cast("string"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))
    name = F.when(F.col("event_type") == "view", "cam/view.jpg").when(F.col("event_id") % 3 == 0, F.concat(F.lit("cam/"), text, F.lit("0000000001-x.jpg"))).otherwise(F.concat(F.lit("cam/"), text, F.lit(".jpg")))
    return t.events.select("event_id", F.bround(sc.seconds_of_name(name), 6).alias("seconds"), sc.nanoseconds_of_name(name).alias("ns"))


@query("f3_pair_names", "WITH p AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem) SELECT a, b, replace('s/' || a, '/', '-') || '/' || replace('p/' || b, '/', '-') AS name, least(a, b) * 2147483647 + greatest(a, b) AS pair_id, least(a, b) AS first, greatest(a, b) AS second FROM p")
def _(t):
    p = t.lineitem.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b")).distinct()
    text = lambda c, x: F.concat(F.lit(x), F.col(c).cast("string"))
    named = p.select("a", "b", pr.pair_name(text("a", "s/"), text("b", "p/")).alias("name"), pr.pair_id(F.col("a"), F.col("b")).alias("pair_id"))
    first, second = pr.pair_ends(F.col("pair_id"))
    return named.select("*", first.alias("first"), second.alias("second"))


@query("f6_fingerprint_groups", f"SELECT lang, count(*) AS n, {digest_sql("coalesce(text, '')")} AS digest FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), sc.set_digest(F.coalesce("text", F.lit(""))).alias("digest"))


@query("f7_table_hash")
def _(t):
    return sc.table_hash(t.lineitem, ["l_suppkey"], ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"])


_SIZED = "coalesce(strlen({0}) || ':' || {0}, '-')"
_ORDER = {"o_orderkey": "o_orderkey::VARCHAR", "o_custkey": "o_custkey::VARCHAR", "o_orderstatus": "o_orderstatus", "o_totalprice": "round_even(o_totalprice, 9)::DECIMAL(38, 9)::VARCHAR"}
_HEAD = '["o_orderkey","o_custkey","o_orderstatus","o_totalprice"]'
_FOLD = """t AS (SELECT field, 0 AS level, row_number() OVER (PARTITION BY field ORDER BY k) - 1 AS place, hash, count(*) OVER (PARTITION BY field) AS size FROM h
  UNION ALL SELECT field, level + 1, place // 3, sha256(string_agg(hash, '' ORDER BY place)), (any_value(size) + 2) // 3 FROM t WHERE size > 1 GROUP BY field, level, place // 3)"""


@query("f7_table_summary", f"""WITH RECURSIVE h AS (SELECT '' AS field, o_orderkey AS k, sha256({" || ".join(_SIZED.format(x) for x in _ORDER.values())}) AS hash FROM orders), {_FOLD}
SELECT (SELECT count(*) FROM orders) AS rows, '{_HEAD}' AS columns, sha256('{_HEAD}' || hash) AS sha256 FROM t WHERE size = 1""")
def _(t):
    return content.table_summary(t.orders.select(*_ORDER).withColumn("o_note", F.lit(None).cast("string")), ["o_orderkey"], optional=("o_note",))


@query("a29_field_digests", "WITH RECURSIVE h AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, o_orderkey AS k, sha256({_SIZED.format(x)}) AS hash FROM orders" for c, x in list(_ORDER.items())[1:]) + f"""), {_FOLD}
SELECT field, (SELECT count(*) FROM orders) AS rows, hash AS sha256 FROM t WHERE size = 1""")
def _(t):
    return content.field_digests(t.orders, ["o_orderkey"], list(_ORDER)[1:])


@query("f7_changed_rows", "SELECT o_orderkey, 'removed' AS state FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT o_orderkey, 'changed' FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 = 0 UNION ALL SELECT -1 - o_orderkey, 'added' FROM orders WHERE o_orderkey % 83 = 0")
def _(t):
    k = F.col("o_orderkey")
    now = t.orders.where(k % 97 != 0).withColumn("o_totalprice", F.when(k % 89 == 0, F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice") + 1e-12))
    return content.changed_rows(t.orders, now.unionByName(t.orders.where(k % 83 == 0).withColumn("o_orderkey", -1 - k)), ["o_orderkey"])


@query("f20_tree_digests")
def _(t):
    named = F.create_map(F.lit("name"), F.col("n"))
    group = lambda path: [path.alias("path"), F.lit("group").alias("kind"), named.alias("attrs"), F.lit(None).cast("binary").alias("data"), F.lit(None).cast("string").alias("storage")]
    region = t.region.select(F.col("r_regionkey").cast("string").alias("r"), F.col("r_name").alias("n"))
    nation = t.nation.select(F.col("n_regionkey").cast("string").alias("r"), F.col("n_nationkey").cast("string").alias("c"), F.col("n_name").alias("n"))
    part = t.supplier.join(nation.select("r", "c"), F.col("s_nationkey").cast("string") == F.col("c")).withColumn("n", F.col("s_name"))
    path = F.concat_ws("/", "r", "c", F.col("s_suppkey").cast("string"))
    data = part.select(path.alias("path"), F.lit("dataset").alias("kind"), named.alias("attrs"), F.round("s_acctbal", 2).cast("decimal(20,2)").cast("string").cast("binary").alias("data"), F.lit("contiguous").alias("storage"))
    root = t.spark.range(1).select(F.lit("").alias("path"), F.lit("group").alias("kind"), F.create_map(F.lit("name"), F.lit("root")).alias("attrs"), F.lit(None).cast("binary").alias("data"), F.lit(None).cast("string").alias("storage"))
    return content.tree_digests(root.unionByName(region.select(*group(F.col("r")))).unionByName(nation.select(*group(F.concat_ws("/", "r", "c")))).unionByName(data))


Q = "q AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, sin(l_quantity) AS x, cos(l_quantity) AS y, l_discount AS z, l_tax + 1 AS w, l_discount + 0.1 AS a, l_tax AS b, 0.2 AS c, 0.9 AS d FROM lineitem)"


@query("f8_rotation_errors", f"WITH {Q} SELECT o, n, p, round(degrees(2 * acos(least(1.0, abs(x * a + y * b + z * c + w * d) / (sqrt(x * x + y * y + z * z + w * w) * sqrt(a * a + b * b + c * c + d * d))))), 5) AS degrees FROM q")
def _(t):
    a = [F.sin("l_quantity"), F.cos("l_quantity"), F.col("l_discount"), F.col("l_tax") + 1]
    b = [F.col("l_discount") + 0.1, F.col("l_tax"), F.lit(0.2), F.lit(0.9)]
    return t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.round(sc.rotation_error_degrees(a, b), 5).alias("degrees"))


@query("f9_alignments")
def _(t):
    e = {"ex": F.col("l_quantity"), "ey": F.col("l_discount") * 100, "ez": F.col("l_tax") * 100}
    g = {"gx": 2 * F.col("ex") + 1, "gy": -2 * F.col("ez") + 3, "gz": 2 * F.col("ey") + 0.01 * F.col("l_linenumber")}
    rows = t.lineitem.withColumns(e).withColumns(g)
    return alignment.alignments(rows, "l_suppkey").select("l_suppkey", *[F.round(c, 4).alias(c) for c in ("scale", "tx", "ty", "tz", "rmse")])


@query("f10_f11_project", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax + 1 > 0 THEN round(500 * (2 * l_discount + 1) / (2 * (l_tax + 1) + 3) + 320, 5) END AS u, CASE WHEN l_tax + 1 > 0 THEN round(500 * (2 * l_quantity + 2) / (2 * (l_tax + 1) + 3) + 240, 5) END AS v FROM lineitem")
def _(t):
    one, zero = F.lit(1.0), F.lit(0.0)
    p = sc.similarity(F.lit(2.0), [zero, zero, zero, one], [F.lit(1.0), F.lit(2.0), F.lit(3.0)], [F.col("l_discount"), F.col("l_quantity"), F.col("l_tax") + 1])
    u, v = sc.pinhole(F.lit(500.0), F.lit(500.0), F.lit(320.0), F.lit(240.0), p)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(u, 5).alias("u"), F.round(v, 5).alias("v"))


LENS = """p AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey + l_linenumber) % 4 AS m, l_discount * 8 - 0.4 AS u, l_tax * 8 - 0.3 AS v FROM lineitem), s AS (SELECT *, u * u + v * v AS s, sqrt(u * u + v * v) AS r, atan(sqrt(u * u + v * v)) AS a FROM p),
f AS (SELECT *, CASE m WHEN 0 THEN 1 + 0.1 * s - 0.03 * s * s WHEN 1 THEN 1 - 0.2 * s + 0.05 * s * s WHEN 2 THEN 2 / (1 + sqrt(1 - 4 * -0.15 * s)) ELSE CASE WHEN s < 1e-8 THEN 1 + (0.02 - 1 / 3.0) * s ELSE a * (1 + 0.02 * a * a - 0.01 * power(a, 4) + 0.003 * power(a, 6) - 0.001 * power(a, 8)) / r END END AS f FROM s)"""


@query("f11_distorted_cameras", f"""WITH {LENS} SELECT l_orderkey, l_linenumber, l_partkey, round(500 * (u * f + CASE WHEN m = 1 THEN 2 * 0.001 * u * v - 0.002 * (s + 2 * u * u) ELSE 0 END) + 320, 4) AS x, round(510 * (v * f + CASE WHEN m = 1 THEN 2 * -0.002 * u * v + 0.001 * (s + 2 * v * v) ELSE 0 END) + 240, 4) AS y, true AS same, round(500 * u + 320, 4) AS flat_x FROM f""")
def _(t):
    u, v = F.col("l_discount") * 8 - 0.4, F.col("l_tax") * 8 - 0.3
    lenses = [("OPENCV", [0.1, -0.03, 0.0, 0.0]), ("OPENCV", [-0.2, 0.05, 0.001, -0.002]), ("DIVISION", [-0.15]), ("OPENCV_FISHEYE", [0.02, -0.01, 0.003, -0.001])]
    kind = (F.col("l_partkey") + F.col("l_linenumber")) % 4

    def each(of):
        out = None
        for k, (name, extra) in enumerate(lenses):
            value = of(name, F.array(*[F.lit(float(x)) for x in (500, 510, 320, 240, *extra)]))
            out = F.when(kind == k, value) if out is None else out.when(kind == k, value)
        return out

    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", u.alias("u"), v.alias("v"), each(lambda m, p: cameras.project(m, p, F.array(2 * u, 2 * v, F.lit(2.0)))).alias("px"))
    rows = rows.withColumn("uv", each(lambda m, p: cameras.unproject(m, p, F.col("px")[0], F.col("px")[1])))
    same = F.coalesce(F.greatest(F.abs(F.col("uv")[0] - F.col("u")), F.abs(F.col("uv")[1] - F.col("v"))) < 1e-9, F.lit(False))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(F.col("px")[i], 4).alias(c) for i, c in enumerate("xy")], same.alias("same"), F.round(500 * F.col("uv")[0] + 320, 4).alias("flat_x"))


@query("f12_bearings", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount / sqrt(l_discount * l_discount + l_tax * l_tax + 1), 8) AS x, round(1 / sqrt(l_discount * l_discount + l_tax * l_tax + 1), 8) AS z FROM lineitem")
def _(t):
    x, _, z = sc.bearing(F.col("l_discount"), F.col("l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(x, 8).alias("x"), F.round(z, 8).alias("z"))


@query("f13_sampson_errors", "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS px, l_tax AS py, l_discount + 0.01 AS qx, l_tax + l_quantity / 1000 AS qy FROM lineitem), e AS (SELECT *, 0.1 * qx + 1.0 * py - 1.0 * qy AS c, 0.1 AS u FROM r) SELECT l_orderkey, l_linenumber, l_partkey, round(c * c / (0.1 * 0.1 + 1.0 + 0.0 + 1.0), 8) AS error FROM e")
def _(t):
    zero, one = F.lit(0.0), F.lit(1.0)
    m = [zero, zero, F.lit(0.1), zero, zero, F.lit(-1.0), zero, one, zero]
    p, q = [F.col("l_discount"), F.col("l_tax"), one], [F.col("l_discount") + 0.01, F.col("l_tax") + F.col("l_quantity") / 1000, one]
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(sc.sampson(m, p, q), 8).alias("error"))


def _two_views_sql() -> str:
    """The three kinds of pair written out; a calibrated one turns about z by a."""
    e = ["ty * 0 - tz * si", "-tz * co", "ty", "tz * co", "-tz * si", "-tx", "tx * si - ty * co", "tx * co + ty * si", "0"]
    ray = lambda k: [f"u{k} / n{k}", f"v{k} / n{k}", f"1 / n{k}"]
    times = lambda i, v, across: "(" + " + ".join(f"({e[3 * j + i if across else 3 * i + j]}) * {v[j]}" for j in range(3)) + ")"
    a, b = ray(1), ray(2)
    line2 = [f"{times(i, a, False)} / ({a[2]} + 1e-12)" for i in range(3)]
    line1 = [f"{times(i, b, True)} / ({b[2]} + 1e-12)" for i in range(2)]
    c = "(" + " + ".join(f"{line2[i]} * {b[i]}" for i in range(3)) + ")"
    error = f"{c} * {c} / nullif(power({line2[0]}, 2) + power({line2[1]}, 2) + power({line1[0]}, 2) + power({line1[1]}, 2), 0)"
    turned = [f"(co * {a[0]} - si * {a[1]})", f"(si * {a[0]} + co * {a[1]})", a[2]]
    dot = lambda x, y: "(" + " + ".join(f"{p} * {q}" for p, q in zip(x, y)) + ")"
    t, back = ["tx", "ty", "tz"], ["-(co * tx + si * ty)", "(si * tx - co * ty)", "(-tz)"]
    w, d1, d2 = f"(-{dot(turned, b)})", f"(-{dot(turned, t)})", dot(b, t)
    depths = [f"({d1} - {w} * {d2})", f"({d2} - {w} * {d1})"]
    range_ = " AND ".join(f"{d} > 0.01 * (1 - {w} * {w}) AND {d} < 100 * (1 - {w} * {w})" for d in depths)
    near = "cos(radians(3)) + 1e-6"
    epi = lambda v, r: f"{dot(v, r)} * (CASE WHEN {v[2]} < 0 THEN -1 ELSE 1 END) / sqrt({dot(v, v)}) < {near}"
    calibrated = f"{error} < power(2 * (1 / 500.0 + 1 / 600.0), 2) AND {range_} AND {epi(back, a)} AND {epi(t, b)}"
    return f"""WITH m AS (SELECT l_suppkey AS s, l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_quantity * 12 AS x1, l_extendedprice % 480 AS y1, l_quantity * 12 - 40 + 30 * sin(l_partkey) AS x2, l_extendedprice % 480 + 4 * cos(l_partkey) AS y2 FROM lineitem),
q AS (SELECT *, (x1 - 320) / 500 AS u1, (y1 - 240) / 500 AS v1, (x2 - 320) / 500 AS u2, (y2 - 240) / 500 AS v2, cos((s % 9) / 100.0::DOUBLE) AS co, sin((s % 9) / 100.0::DOUBLE) AS si, (s % 2) * 2.0::DOUBLE - 1.02 AS tx, 0.02::DOUBLE * (s % 5) AS ty, 0.3::DOUBLE * (s % 4) - 0.45 AS tz, 0.0001::DOUBLE * (s % 5) AS f1, 0.001::DOUBLE * (s % 4) AS f6 FROM m),
r AS (SELECT *, sqrt(u1 * u1 + v1 * v1 + 1) AS n1, sqrt(u2 * u2 + v2 * v2 + 1) AS n2 FROM q),
h AS (SELECT *, CASE s % 3 WHEN 0 THEN {calibrated}
    WHEN 1 THEN power(x2 * (f1 * y1 - 0.1) + y2 * (-0.0001 * x1 - 1) + f6 * x1 + y1 + 3, 2) / (power(f1 * y1 - 0.1, 2) + power(-0.0001 * x1 - 1, 2) + power(f6 - 0.0001 * y2, 2) + power(f1 * x2 + 1, 2)) < 16
    ELSE power((x1 + 0.01 * (s % 4) * y1 - 38) / (0.00001 * y1 + 1) - x2, 2) + power((y1 - 1) / (0.00001 * y1 + 1) - y2, 2) < 400 END AS ok,
  (f6 - 0.0001 * y2) * (f6 * (f1 * y1 - 0.1)) > 0 AS side FROM r),
v AS (SELECT s, sum(CASE WHEN side THEN 1 ELSE -1 END) AS lead FROM h WHERE ok AND s % 3 = 1 GROUP BY s)
SELECT o, n, p, h.s FROM h LEFT JOIN v USING (s) WHERE ok AND (s % 3 <> 1 OR (lead > 0 AND side) OR (lead < 0 AND NOT side))"""


@query("f13_two_view_inliers", _two_views_sql())
def _(t):
    s, number = F.col("s_suppkey"), lambda *xs: F.array(*[F.lit(float(x)) if isinstance(x, (int, float)) else x.cast("double") for x in xs])
    kind = F.element_at(F.array(*[F.lit(k) for k in (inliers.CALIBRATED, inliers.UNCALIBRATED, inliers.PLANAR)]), (s % 3 + 1).cast("int"))
    turn, f1, f6 = (s % 9) / 200.0, 0.0001 * (s % 5), 0.001 * (s % 4)
    matrix = F.when(s % 3 == 1, number(0, f1, -0.1, -0.0001, 0, -1, f6, 1, 3)).when(s % 3 == 2, number(1, 0.01 * (s % 4), -38, 0, 1, -1, 0, 0.00001, 1))
    pose = {"q": number(0, 0, F.sin(turn), F.cos(turn)), "t": number((s % 2) * 2.0 - 1.02, 0.02 * (s % 5), 0.3 * (s % 4) - 0.45)}
    pairs = t.supplier.select(s.alias("s"), kind.alias("kind"), *[F.when(s % 3 == 0, v).alias(k) for k, v in pose.items()], F.lit(500.0).alias("f1"), F.lit(600.0).alias("f2"), matrix.alias("matrix"))
    part, x, y = F.col("l_partkey"), F.col("l_quantity") * 12, F.col("l_extendedprice") % 480
    rows = t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), part.alias("p"), x.alias("x1"), y.alias("y1"), (x - 40 + 30 * F.sin(part)).alias("x2"), (y + 4 * F.cos(part)).alias("y2"))
    ray = lambda k: F.array(*sc.bearing((F.col(f"x{k}") - 320) / 500, (F.col(f"y{k}") - 240) / 500))
    return inliers.inlier_matches(rows.withColumns({"ray1": ray(1), "ray2": ray(2)}), pairs, "s", inliers.InlierOptions(homography=20.0)).select("o", "n", "p", "s")


@query("f14_robust_losses", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity - 5 <= 0 THEN 0.0 WHEN l_quantity - 5 <= 10 THEN (l_quantity - 5) * (l_quantity - 5) ELSE 20 * (l_quantity - 5) - 100 END AS loss, CASE WHEN l_discount > 0 AND l_tax > 0 THEN round(ln(2 * l_discount / l_tax), 8) END AS log_depth FROM lineitem")
def _(t):
    loss = sc.dead_zone_huber(F.col("l_quantity") * F.col("l_quantity"), 5.0, 10.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", loss.alias("loss"), F.round(sc.log_depth_residual(F.col("l_discount"), F.lit(2.0), F.col("l_tax")), 8).alias("log_depth"))


@query("f15_bilinear", "SELECT p_partkey, round((1 - u) * (1 - v) * p_size + u * (1 - v) * (p_size + 1) + (1 - u) * v * 7 + u * v * p_retailprice, 6) AS value FROM (SELECT *, least(greatest(p_size / 40.0::DOUBLE, 0.0), 1.0) AS u, least(greatest(p_retailprice / 1000 - 1, 0.0), 1.0) AS v FROM part)")
def _(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", F.round(sc.bilinear([s, s + 1, F.lit(7), F.col("p_retailprice")], s / 40.0, F.col("p_retailprice") / 1000 - 1), 6).alias("value"))


def _maps(t):
    """A map for each supplier, 40 cells across and 25 down, as cells and as sizes."""
    s, x, y = F.col("s_suppkey"), F.col("x"), F.col("y")
    rows = t.supplier.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(24))))
    cells = rows.select(s.alias("s"), "x", "y", (F.col("s_acctbal") / 1000 + (x * 7 + y * 3) % 11).alias("depth"), ((x + y + s) % 5 != 0).cast("int").alias("valid"))
    return cells, t.supplier.select(s.alias("s"), F.lit(40).alias("width"), F.lit(25).alias("height"), F.lit(400).alias("original_width"), F.lit(240).alias("original_height"))


def _map_sql(smooth: str, nearest: str, place: str, edge: str) -> str:
    cell = lambda i, j: f"CASE WHEN {i} BETWEEN 0 AND 39 AND {j} BETWEEN 0 AND 24 THEN s_acctbal / 1000 + (({i}) * 7 + ({j}) * 3) % 11 ELSE 0 END"
    x1, y1 = ("i + 1", "j + 1") if edge == "zero" else ("least(i + 1, 39)", "least(j + 1, 24)")
    value = f"({cell('i', 'j')}) * (1 - u) * (1 - v) + ({cell(x1, 'j')}) * u * (1 - v) + ({cell('i', y1)}) * (1 - u) * v + ({cell(x1, y1)}) * u * v"
    a, b = ("round_even(x, 0)::BIGINT", "round_even(y, 0)::BIGINT") if edge == "zero" else ("least(floor(x + 0.5), 39)::BIGINT", "least(floor(y + 0.5), 24)::BIGINT")
    return f"""WITH k AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, s_acctbal, {place} FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
f AS (SELECT *, floor(x)::BIGINT AS i, floor(y)::BIGINT AS j, x - floor(x) AS u, y - floor(y) AS v, {a} AS a, {b} AS b FROM k)
SELECT o, n, p, round({value}, 5) AS {smooth}, (a BETWEEN 0 AND 39 AND b BETWEEN 0 AND 24 AND (a + b + s) % 5 <> 0) AS {nearest} FROM f"""


def _points(t, *place):
    return t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), *place)


PLACE = "(l_quantity * 9.3 - 20.05) * CAST(40 / 400.0 AS FLOAT)::DOUBLE AS x, (l_extendedprice % 260 - 8.05) * CAST(25 / 240.0 AS FLOAT)::DOUBLE AS y"


@query("s10_depth_maps", _map_sql("depth", "valid", PLACE, "zero"))
def _(t):
    cells, sizes = _maps(t)
    at = _points(t, (F.col("l_quantity") * 9.3 - 20.05).alias("x"), (F.col("l_extendedprice") % 260 - 8.05).alias("y"))
    found = rasters.attached_depth(at, rasters.tiles(cells, sizes, "s", ["depth", "valid"]), sizes, "s", 0.1)
    return found.select("o", "n", "p", F.round("depth", 5).alias("depth"), "valid")


@query("f15_map_samples", _map_sql("depth", "valid", "least(greatest(l_quantity * 0.93 - 2.005 + 0.3 * sin(l_partkey), 0), 39) AS x, least(greatest(l_extendedprice % 29 - 2.005 + 0.3 * cos(l_partkey), 0), 24) AS y", "clamp"))
def _(t):
    cells, sizes = _maps(t)
    found = rasters.sampled(_points(t, F.col("l_quantity"), F.col("l_extendedprice")), rasters.tiles(cells, sizes, "s", ["depth", "valid"]), "s", F.col("l_quantity") * 0.93 - 2.005 + 0.3 * F.sin("p"), F.col("l_extendedprice") % 29 - 2.005 + 0.3 * F.cos("p"), {"depth": "depth"}, {"valid": "valid"})
    return found.select("o", "n", "p", F.round("depth", 5).alias("depth"), (F.col("valid") != 0).alias("valid"))


@query("f16_quarter_turns", "SELECT p_partkey, k AS turns, CASE k % 2 WHEN 0 THEN 500.0 ELSE 600.0 END AS fx, CASE k WHEN 0 THEN p_size WHEN 1 THEN 7 WHEN 2 THEN 640 - p_size ELSE 480 - 7 END::DOUBLE AS cx FROM part, (SELECT unnest([0, 1, 2, 3]) AS k)")
def _(t):
    base = [F.lit(500.0), F.lit(600.0), F.col("p_size").cast("double"), F.lit(7.0), F.lit(640.0), F.lit(480.0)]
    turned = F.array(*[F.struct(F.lit(k).alias("turns"), sc.quarter_turned(*base, k)[0].alias("fx"), sc.quarter_turned(*base, k)[2].alias("cx")) for k in range(4)])
    return t.part.select("p_partkey", F.explode(turned).alias("x")).select("p_partkey", "x.turns", "x.fx", "x.cx")


@query("j20_official_poses", "SELECT s_name AS name, (s_suppkey % 4)::INT AS turns, round(cos(s_acctbal / 1000 + pi() / 2 * (s_suppkey % 4)), 5) AS c, round(sin(s_acctbal / 1000 + pi() / 2 * (s_suppkey % 4)), 5) AS i, round(cos(pi() / 2 * (s_suppkey % 4)) * s_suppkey - sin(pi() / 2 * (s_suppkey % 4)) * s_nationkey, 5) AS x, round(sin(pi() / 2 * (s_suppkey % 4)) * s_suppkey + cos(pi() / 2 * (s_suppkey % 4)) * s_nationkey, 5) AS y FROM supplier")
def _(t):
    s, half, zero = F.col("s_suppkey"), F.col("s_acctbal") / 2000, F.lit(0.0)
    records = t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("camera"), F.array(zero, zero, F.sin(half), F.cos(half)).alias("q"), F.array(s.cast("double"), F.col("s_nationkey").cast("double"), F.lit(1.0)).alias("t"))
    intrinsics = lambda n: [500.0 + n, 600.0 + n, 300.0 + n, F.lit(200.0), F.lit(640), F.lit(480)]
    known = t.supplier.select("s_nationkey").distinct().select(F.col("s_nationkey").alias("camera"), *[c.alias(n) for c, n in zip(intrinsics(F.col("s_nationkey")), capture.INTRINSICS)])
    base = [c.cast("double") for c in intrinsics(F.col("s_nationkey"))]
    turned = [sc.quarter_turned(*base, -k % 4) for k in range(4)]
    now = [F.element_at(F.array(*[turned[k][i] for k in range(4)]), (s % 4 + 1).cast("int")).alias(n) for i, n in enumerate(capture.INTRINSICS)]
    pinned = content.table_summary(records.select("name", "q", "t"), ["name"], places=15).first()["sha256"]
    found = capture.official_poses(records, known, t.supplier.select(F.col("s_name").alias("name"), *now), pinned)
    q, p = F.col("q"), F.col("t")
    return found.select("name", "turns", F.round(q[3] * q[3] - q[2] * q[2], 5).alias("c"), F.round(2 * q[2] * q[3], 5).alias("i"), F.round(p[0], 5).alias("x"), F.round(p[1], 5).alias("y"))


@query("f17_f19_scale_inverse", "SELECT p_partkey, (p_size + 0.5::DOUBLE) * 0.25 - 0.5 AS x, round(3.0 / nullif(p_size * 3.0 - 2, 0), 9) AS a, round(-1.0 / nullif(p_size * 3.0 - 2, 0), 9) AS b FROM part")
def _(t):
    a, b, _, _ = sc.inverse_2x2(F.col("p_size").cast("double"), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    return t.part.select("p_partkey", sc.scaled(F.col("p_size").cast("double"), F.lit(0.25)).alias("x"), F.round(a, 9).alias("a"), F.round(b, 9).alias("b"))


@query("f18_metric_keys", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'wate_auc_full@' || (p_size / 4)::DECIMAL(9,2)::DOUBLE::VARCHAR ELSE 'wate_auc_' || p_size || '@' || (p_size / 4)::DECIMAL(9,2)::DOUBLE::VARCHAR END AS stem, p_size / 4.0::DOUBLE AS threshold FROM part")
def _(t):
    key = sc.metric_key(F.when(F.col("p_size") % 5 != 0, F.col("p_size")), F.col("p_size") / 4)
    window, threshold, _ = sc.parsed_metric(key)
    text = F.concat(F.lit("wate_auc_"), window, F.lit("@"), threshold.cast("string"))
    return t.part.select("p_partkey", text.alias("stem"), threshold.alias("threshold"))
