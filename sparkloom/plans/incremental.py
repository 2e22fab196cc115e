"""Queries of the incremental operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.plans.temporal import EV, events
from sparkloom.streaming import incremental as inc


@query("i1_keyframes")
def _(t):
    ev = events(t)
    step = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.abs(F.sin(F.col("v") * i)) * 0.05)
    seen = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.col("k") + i) % 11 > 0)
    return inc.select_keyframes(ev.select("s", "t", step.alias("step"), seen.alias("seen"), (F.col("e") == "signup").alias("forced")), "s", "t", 0.1, 0.5)


@query("i2_admission")
def _(t):
    return inc.admitted(events(t), "s", "k", "v", 40.0)


@query("i3_propagation", f"""WITH {EV}, w AS (SELECT s, k, v, min(1 - v / 600) OVER o AS confidence, sum(v / 100) OVER o AS covariance, count(*) OVER o AS length FROM ev WINDOW o AS (PARTITION BY s ORDER BY k ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, bool_and(v < 400 AND confidence > 0.5 AND sqrt(covariance) <= 3) OVER (PARTITION BY s ORDER BY k ROWS UNBOUNDED PRECEDING) AS ok FROM w) SELECT s, k, round(confidence, 6) AS confidence, length FROM z WHERE ok""")
def _(t):
    rows = events(t).withColumn("conf", 1 - F.col("v") / 600).withColumn("cov", F.col("v") / 100)
    return inc.propagated(rows, "s", "k", "conf", "cov", F.col("v") < 400, 0.5, 3.0).select("s", "k", F.round("confidence", 6).alias("confidence"), "length")


@query("i4_best_hops", "WITH b AS (SELECT l_orderkey, l_partkey, min({'c': l_discount, 'h': l_linenumber, 'd': l_tax}) AS b FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_partkey, b.h AS l_linenumber, b.c AS l_discount, b.d < (sqrt(b.c) + 1) * 0.05 AS accepted FROM b")
def _(t):
    return inc.best_hops(t.lineitem, ["l_orderkey", "l_partkey"], "l_linenumber", "l_discount", "l_tax", 0.05)


@query("w17_history", f"WITH {EV} SELECT s, k, array_to_string(list(k) OVER (PARTITION BY s ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS history FROM ev")
def _(t):
    return inc.histories(events(t), "s", "k", "k", 5).select("s", "k", F.array_join("history", ",").alias("history"))


@query("x_windowed_counts", "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return inc.windowed_counts(t.events, "ts", "event_type", "6 hours", "1 day").select(F.unix_micros("start").alias("start"), "event_type", "n")
