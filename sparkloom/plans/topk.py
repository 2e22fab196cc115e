"""Queries of similarity, suppression and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import kernels
from sparkloom.operators import topk as tk
from sparkloom.operators.ranks import ranked
from sparkloom.plans.registry import query
from sparkloom.plans.temporal import EV, events

DOT = "d AS (SELECT q.vec_id AS query, r.vec_id AS ref, list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS score, q.label AS ql, r.label AS rl FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)"
TOP = f"{DOT}, t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ref) AS rank FROM d WHERE score >= 0.1)"


def top(t, k=10):
    return tk.retrieve(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding", k, 0.1)


@query("t1_topk_retrieval", f"WITH {TOP} SELECT query, ref, round(score, 6) AS score, rank::INT AS rank FROM t WHERE rank <= 10")
def _(t):
    return top(t).withColumn("score", F.round("score", 6))


@query("t2_topk_capped", f"""WITH {TOP}, p AS (SELECT query, ref, score, ql, rl FROM t WHERE rank <= 10), o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY least(query, ref), greatest(query, ref) ORDER BY score DESC, query, ref) = 1)
SELECT query, ref, round(score, 6) AS score FROM o QUALIFY row_number() OVER (PARTITION BY least(ql, rl), greatest(ql, rl) ORDER BY score DESC, query, ref) <= 3""")
def _(t):
    q, r = t.embeddings.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), t.embeddings.select(F.col("vec_id").alias("ref"), F.col("label").alias("rl"))
    pairs = top(t).join(q, "query").join(r, "ref")
    return tk.capped(pairs, "query", "ref", [F.least("ql", "rl"), F.greatest("ql", "rl")], "score", 3).select("query", "ref", F.round("score", 6).alias("score"))


@query("t3_endpoint_nms")
def _(t):
    labels = t.embeddings.select(F.col("vec_id").alias("query"), F.col("label").cast("bigint").alias("g"))
    pairs = top(t).join(labels, "query").select("g", F.least("query", "ref").alias("first"), F.greatest("query", "ref").alias("second"), "score")
    return kernels.greedy_endpoint_nms(pairs, "g", 5)


@query("t4_greedy_nms")
def _(t):
    points = t.lineitem.select(F.col("l_suppkey").alias("g"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_partkey") % 10).alias("id"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.col("l_extendedprice").alias("score"))
    return kernels.greedy_spatial_nms(points, "g", 3.0)


@query("t5_one_shot_nms", """WITH p AS (SELECT l_suppkey AS g, l_orderkey * 100000 + l_partkey AS k, l_quantity AS x, l_discount * 100 AS y, l_extendedprice AS s FROM lineitem)
SELECT g, k FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.g = a.g AND (b.s > a.s OR (b.s = a.s AND b.k < a.k)) AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 9)""")
def _(t):
    p = t.lineitem.select(F.col("l_suppkey").alias("g"), (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("k"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.col("l_extendedprice").alias("s"))
    return tk.one_shot_nms(p, "g", "k", "x", "y", "s", 3.0).select("g", "k")


@query("t6_f4_hash_sample")
def _(t):
    return tk.hash_sample(t.orders.select("o_orderkey"), "o_orderkey", 500)


@query("t7_lowest_share", "SELECT l_partkey, round(s, 6) AS s FROM (SELECT l_partkey, avg(l_discount) AS s, row_number() OVER (ORDER BY round(avg(l_discount), 9), l_partkey) AS r FROM lineitem GROUP BY 1) WHERE r <= (SELECT count(DISTINCT l_partkey) FROM lineitem) * 20 // 100")
def _(t):
    from sparkloom.operators.stats import lowest_share

    s = t.lineitem.groupBy("l_partkey").agg(F.round(F.avg("l_discount"), 9).alias("s"))
    return lowest_share(s, "l_partkey", "s", 20.0).withColumn("s", F.round("s", 6))


@query("t8_f2_natural_sort", "SELECT p_partkey, row_number() OVER (ORDER BY regexp_extract(p_brand, '^[^0-9]*'), regexp_extract(p_brand, '[0-9]+')::INT, p_partkey) AS rank FROM part")
def _(t):
    return ranked(t.part.select("p_partkey", tk.natural_key(F.col("p_brand")).alias("k")), ["k", "p_partkey"]).select("p_partkey", "rank")


@query("t9_cache_plan")
def _(t):
    return tk.cache_plan(events(t), "s", "k", "e", 2)


@query("t10_overlay_edges", "WITH e AS (SELECT l_suppkey AS a, l_partkey % 50 AS b, count(*) AS n, sum(l_discount) - 0.2 AS s FROM lineitem GROUP BY 1, 2), c AS (SELECT a, b, n, least(greatest(s, 0.0), 1.0) AS s, n > 10 AS accepted FROM e) (SELECT a, b, n, round(s, 6) AS s, accepted FROM c WHERE accepted ORDER BY n DESC, a, b LIMIT 500) UNION ALL SELECT a, b, n, round(s, 6), accepted FROM c WHERE NOT accepted")
def _(t):
    e = t.lineitem.groupBy(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 50).alias("b")).agg(F.count("*").alias("n"), (F.sum("l_discount") - 0.2).alias("s"))
    return tk.overlay_edges(e, "a", "b", F.col("n") > 10, "n", "s", 500).withColumn("s", F.round("s", 6))


@query("t11_evenly_spaced", f"WITH {EV}, n AS (SELECT s, k, row_number() OVER (PARTITION BY s ORDER BY t, k) - 1 AS n, count(*) OVER (PARTITION BY s) AS m FROM ev), i AS (SELECT unnest(range(12)) AS i) SELECT s, k FROM n WHERE EXISTS (SELECT 1 FROM i WHERE round_even(i * (m - 1) / 11, 0) = n)")
def _(t):
    return tk.evenly_spaced(events(t), "s", ["t", "k"], 12).select("s", "k")
