"""Queries on match graphs, over all order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import scalars as sc
from sparkloom.operators import graph as gr
from sparkloom.plans.registry import query

#: Nodes: orders are even numbers, customers are odd ones; an order's lines are its matches with its customer.
E = "e AS (SELECT l_orderkey * 2 AS a, o_custkey * 2 + 1 AS b, l_suppkey AS pair, l_linenumber AS n, l_returnflag = 'R' AS lc FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def components_sql(edges: str = "e") -> str:
    """An order has one customer, so a component is a customer's orders that are there and the customer."""
    return f"m AS (SELECT b, least(b, min(a)) AS track FROM {edges} GROUP BY b), c AS (SELECT b AS obs, track FROM m UNION SELECT a, track FROM {edges} JOIN m USING (b))"


C = f"{E}, {components_sql()}"


def matches(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select((F.col("l_orderkey") * 2).alias("a"), (F.col("o_custkey") * 2 + 1).alias("b"), F.col("l_suppkey").alias("pair"), F.col("l_linenumber").alias("n"), (F.col("l_returnflag") == "R").alias("lc"))


@query("g1_tracks", f"WITH {C} SELECT obs, track FROM c")
def _(t):
    return gr.tracks(matches(t), "a", "b")


@query("g1_tracks_hub_heavy")
def _(t):
    """All lines as matches of orders and parts: one component takes in nearly all nodes."""
    return gr.tracks(t.lineitem.select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")), "a", "b")


def placed(t):
    m = gr.tracks(matches(t), "a", "b")
    return m.select("track", "obs", (F.col("obs") % 7).alias("image"), (F.col("obs") % 13).cast("double").alias("x"), (F.col("obs") % 5).cast("double").alias("y"))


PLACED = f"{C}, p AS (SELECT track, obs, obs % 7 AS image, (obs % 13)::DOUBLE AS x, (obs % 5)::DOUBLE AS y FROM c)"


@query("g2_consistent_tracks", f"WITH {PLACED} SELECT track, obs FROM p WHERE track NOT IN (SELECT a.track FROM p a JOIN p b ON a.track = b.track AND a.image = b.image AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) > 100) AND track IN (SELECT track FROM p GROUP BY 1 HAVING count(DISTINCT image) >= 2)")
def _(t):
    return gr.consistent(placed(t), "track", "image", "x", "y", 10.0, 2).select("track", "obs")


@query("g3_loop_observations", f"""WITH {E}, o AS (SELECT * FROM e WHERE NOT lc), {components_sql("o")}, l AS (SELECT DISTINCT a, b FROM e WHERE lc),
j AS (SELECT a, b, coalesce(x.track, a) AS ta, coalesce(y.track, b) AS tb FROM l LEFT JOIN c x ON x.obs = a LEFT JOIN c y ON y.obs = b)
SELECT ta AS track, b AS obs, a AS anchor FROM j WHERE ta <> tb UNION SELECT tb, a, b FROM j WHERE ta <> tb""")
def _(t):
    m = matches(t)
    return gr.loop_observations(gr.tracks(m.where("not lc"), "a", "b"), m.where("lc"), "a", "b")


@query("g4_track_filter", f"WITH {PLACED}, n AS (SELECT track, count(*) AS n, count_if(image < 6)::BIGINT AS n_registered, count(DISTINCT image) AS v, bool_and(x > 0) AS d FROM p GROUP BY 1) SELECT track, n, n_registered FROM n WHERE n BETWEEN 2 AND 100 AND n_registered >= 2 AND (v > 2 OR d)")
def _(t):
    registered = t.spark.range(6).select(F.col("id").alias("image"))
    return gr.filtered_tracks(placed(t), "track", "image", registered, 2, 100, F.col("x") > 0)


RAY = "SELECT *, (obs % 11 - 5) / 20.0::DOUBLE AS u, (obs % 9 - 4) / 20.0::DOUBLE AS v, x > 0 AS deep, obs % 5 = 0 AS loop FROM p"


@query("g4_problem_tracks", f"""WITH {PLACED}, mm AS ({RAY}), rr AS (SELECT *, sqrt(u * u + v * v + 1) AS n FROM mm),
gg AS (SELECT track, count_if(NOT loop)::BIGINT AS n, count_if(NOT loop AND image < 6)::BIGINT AS n_registered, bool_and(deep) FILTER (image < 6) AS deep, count(DISTINCT image) FILTER (image < 6) AS views, count(DISTINCT (image, obs)) FILTER (image < 6) AS features, min(image) FILTER (image < 6) AS a, max(image) FILTER (image < 6) AS b FROM rr GROUP BY 1),
ss AS (SELECT gg.track, p.u / p.n AS ax, p.v / p.n AS ay, 1 / p.n AS az, q.u / q.n AS bx, q.v / q.n AS "by", 1 / q.n AS bz, 0.2 * (gg.b - gg.a) AS t FROM gg JOIN rr p ON p.track = gg.track AND p.image = gg.a JOIN rr q ON q.track = gg.track AND q.image = gg.b WHERE views = 2 AND features = 2 AND gg.a // 2 = gg.b // 2 AND gg.a <> 4 AND gg.b <> 4),
dd AS (SELECT *, ax * bx + ay * "by" + az * bz AS ab, t * ax AS ta, t * bx AS tb FROM ss), ll AS (SELECT *, (ab * tb - ta) / nullif(1 - ab * ab, 0) AS one, (tb - ab * ta) / nullif(1 - ab * ab, 0) AS two FROM dd WHERE 1 - ab * ab > 1e-12),
ww AS (SELECT *, (t + one * ax + two * bx) / 2 AS mx, (one * ay + two * "by") / 2 AS my, (one * az + two * bz) / 2 AS mz FROM ll)
SELECT track, n, n_registered FROM gg WHERE n BETWEEN 1 AND 100 AND n_registered >= 1 AND (views <> 2 OR deep OR track IN (SELECT track FROM ww WHERE (mx - t) * ax + my * ay + mz * az > 1e-6 AND mx * bx + my * "by" + mz * bz > 1e-6))""")
def _(t):
    obs, u, v = F.col("obs"), (F.col("obs") % 11 - 5) / 20.0, (F.col("obs") % 9 - 4) / 20.0
    members = placed(t).select("track", "image", obs.alias("feature"), (obs % 5 == 0).alias("loop"), (F.col("x") > 0).alias("depth_ok"), F.array(*sc.bearing(u, v)).alias("ray"))
    image, number = F.col("image"), lambda *xs: F.array(*[F.lit(x) if isinstance(x, float) else x for x in xs])
    images = t.spark.range(6).select(F.col("id").alias("image")).select("image", F.floor(image / 2).alias("frame"), (image % 2).alias("camera"), (image != 4).alias("prior_focal"), number(0.0, 0.0, 0.0, 1.0).alias("q"), number(image * 0.2, 0.0, 0.0).alias("t"))
    return gr.problem_tracks(members, images, "track", 1, 100)


@query("g5_transitive_pairs", f"WITH {PLACED} SELECT DISTINCT a.image AS image_a, a.obs AS feature_a, b.image AS image_b, b.obs AS feature_b FROM p a JOIN p b ON a.track = b.track AND a.image < b.image")
def _(t):
    return gr.transitive_pairs(placed(t), "track", "image", "obs")


@query("g6_largest_component", f"WITH {C}, z AS (SELECT track FROM c GROUP BY 1 ORDER BY count(*) DESC, track LIMIT 1) SELECT a, b, pair, n, track = (SELECT track FROM z) AS in_largest FROM e JOIN c ON obs = a")
def _(t):
    return gr.largest_component(matches(t).select("a", "b", "pair", "n"), "a", "b")


@query("g7_tracking_edges", "SELECT l_partkey AS pair, count_if(l_quantity > 20)::BIGINT AS inliers, count_if(l_quantity > 20 AND l_returnflag = 'R')::BIGINT AS loops, count_if(l_quantity > 20) > 0 AND 2 * count_if(l_quantity > 20 AND l_returnflag = 'R') <= count_if(l_quantity > 20) AND NOT bool_or(l_suppkey = l_partkey) AS tracking FROM lineitem GROUP BY 1")
def _(t):
    rows = t.lineitem.withColumnRenamed("l_partkey", "pair")
    return gr.tracking_edges(rows, "pair", F.col("l_quantity") > 20, F.col("l_returnflag") == "R", F.col("l_suppkey") == F.col("pair"))


@query("g8_bridges")
def _(t):
    edges = t.lineitem.select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"), F.col("l_quantity").alias("q")).groupBy("a", "b").agg(F.max("q").alias("q"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node"))
    others = edges.where("q <= 49").select("a", "b", F.abs(F.col("a") - F.col("b")).alias("gap"))
    return gr.bridges(nodes, edges.where("q > 49"), others, "node", "a", "b", ["gap", "a", "b"])


@query("g9_boundaries", f"""WITH {C}, t AS (SELECT a AS obs, min(n) AS o, max(pair) AS boundary FROM e WHERE lc GROUP BY 1), f AS (SELECT track, arg_min(boundary, (o, obs)) AS x FROM c JOIN t USING (obs) GROUP BY 1)
SELECT c.track, c.obs, x AS boundary, coalesce(c.obs % 100 > x, false) AS outlier FROM c LEFT JOIN f USING (track)""")
def _(t):
    m = matches(t)
    tainted = m.where("lc").groupBy(F.col("a").alias("obs")).agg(F.min("n").alias("o"), F.max("pair").alias("boundary"))
    members = gr.tracks(m, "a", "b").withColumn("seq", F.col("obs") % 100)
    return gr.boundaries(members, tainted, "track", "obs", "o", "boundary", "seq")


@query("g10_forward_taint", f"""WITH RECURSIVE {E}, x AS (SELECT a, b FROM e WHERE NOT lc UNION ALL SELECT b, (b - 1) // 2 % 15000 * 2 FROM e WHERE NOT lc), r(node) AS (SELECT DISTINCT a FROM e WHERE lc UNION SELECT x.b FROM r JOIN x ON x.a = r.node)
SELECT a, b, n, a IN (SELECT node FROM r) AS tainted FROM x JOIN (SELECT 0 AS n) ON true""")
def _(t):
    m = matches(t)
    live = m.where("not lc")
    hop = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), (F.floor((F.col("b") - 1) / 2) % 15000 * 2).alias("b")))
    seeds = m.where("lc").select(F.col("a").alias("node")).distinct()
    return gr.forward_taint(hop.withColumn("n", F.lit(0)), seeds, "node", "a", "b", F.lit(True), F.lit(False)).select("a", "b", "n", "tainted")


@query("g11_match_graph", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def _(t):
    m = t.lineitem.join(t.orders.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return m.join(t.part.where("p_size > 10"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_partkey", "l_linenumber")


@query("g12_observations", "SELECT l_partkey AS track, l_suppkey AS image, l_linenumber AS feature, array_to_string(list_sort(list(DISTINCT l_orderkey)), ',') AS anchors FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL")
def _(t):
    rows = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("track"), F.col("l_suppkey").alias("image"), F.col("l_linenumber").alias("feature"), F.col("l_orderkey").alias("anchor"))
    return gr.prepared_observations(rows, "track", "image", "feature", F.lit(True), "anchor").select("track", "image", "feature", F.array_join("anchors", ",").alias("anchors"))


@query("g13_exclusions", "WITH x AS (SELECT DISTINCT least(s_name, 'Supplier#000000050') AS a, greatest(s_name, 'Supplier#000000050') AS b FROM supplier WHERE s_acctbal < 0) SELECT p.s_suppkey, x.a IS NOT NULL AS excluded FROM supplier p LEFT JOIN x ON x.a = least(p.s_name, 'Supplier#000000050') AND x.b = greatest(p.s_name, 'Supplier#000000050')")
def _(t):
    hub = F.lit("Supplier#000000050")
    ends = [F.least("s_name", hub).alias("x"), F.greatest("s_name", hub).alias("y")]
    gone = t.supplier.where("s_acctbal < 0").select(*ends).distinct().withColumn("_x", F.lit(True))
    return t.supplier.select("s_suppkey", *ends).join(gone, ["x", "y"], "left").select("s_suppkey", F.col("_x").isNotNull().alias("excluded"))
