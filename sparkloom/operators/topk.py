"""Similarity top-k, suppression, samples and natural order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.names import free_names
from sparkloom.session import stored


def retrieve(refs: DataFrame, queries: DataFrame, key: str, vector: str, k: int, least: float, block: int = 2048) -> DataFrame:
    """``(query, ref, score, rank)``: of each query the ``k`` best by dot product among other rows scoring ``least`` or more,
    ties by smaller key. Non-finite scores and null vectors take no part.

    Queries are a stated set: they are taken in blocks of ``block`` rows, each block sent to all tasks, which score it
    against their references as one matrix product and keep ``k`` per query before anything is shuffled.
    """
    asked = stored(queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("query"), F.col(vector).alias("v")).withColumn("_b", F.pmod(F.xxhash64("query"), F.lit(max(1, -(-queries.count() // block))))), "queries")
    blocks = [r["_b"] for r in asked.select("_b").distinct().collect()]
    found = None
    for b in blocks:
        part = asked.where(F.col("_b") == b).toPandas()
        sent = refs.sparkSession.sparkContext.broadcast((part["query"].to_numpy(), np.array(part["v"].tolist(), np.float64)))

        def score(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, q = sent.value
            best = pd.DataFrame({"query": [], "ref": [], "score": []})
            for batch in batches:
                if not len(batch):
                    continue
                s = q @ np.array(batch["v"].tolist(), np.float64).T
                ids = batch["ref"].to_numpy()
                s[names[:, None] == ids[None, :]] = -np.inf
                s[~(np.isfinite(s) & (s >= least))] = -np.inf
                cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(q), -np.inf)
                i, j = np.nonzero((s >= cut[:, None]) & (s > -np.inf))
                best = pd.concat([best, pd.DataFrame({"query": names[i], "ref": ids[j], "score": s[i, j]})]).sort_values(["query", "score", "ref"], ascending=[True, False, True]).groupby("query").head(k)
            yield best

        rows = refs.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("ref"), F.col(vector).alias("v")).mapInPandas(score, "query bigint, ref bigint, score double")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return refs.sparkSession.createDataFrame([], "query bigint, ref bigint, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "ref"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def capped(pairs: DataFrame, a: str, b: str, group: list[Column], score: str, most: int) -> DataFrame:
    """Of unordered pairs, first the best of each, then at most ``most`` per unordered group, by (score desc, a, b)."""
    one = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(F.desc(score), a, b)
    (r,) = free_names(pairs, "r")
    rows = pairs.withColumn(r, F.row_number().over(one)).where(F.col(r) == 1).drop(r)
    g = Window.partitionBy(*group).orderBy(F.desc(score), a, b)
    return rows.withColumn(r, F.row_number().over(g)).where(F.col(r) <= most).drop(r)


def one_shot_nms(points: DataFrame, group: str, key: str, x: str, y: str, score: str, radius: float) -> DataFrame:
    """Points without any better one (score desc, key) of their group nearer than ``radius``, suppressed or not.

    Only the best point of a small cell, all of whose points are nearer than the radius, can stay; these few meet
    the others in grid cells as wide as the radius.
    """
    small = [F.floor(F.col(c) / (radius / 1.5)) for c in (x, y)]
    best = F.min_by(F.struct(*points.columns), F.struct(-F.col(score), F.col(key)))
    few = points.groupBy(group, small[0].alias("_i"), small[1].alias("_j")).agg(best.alias("p")).select("p.*")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = few.select(group, F.col(key).alias("_k"), F.col(x).alias("_u"), F.col(y).alias("_v"), F.col(score).alias("_s"), around.alias("_o"))
    cell = lambda c: F.floor(F.col(c) / radius)
    a = a.select(group, "_k", "_u", "_v", "_s", (cell("_u") + F.col("_o.i")).alias("_cx"), (cell("_v") + F.col("_o.j")).alias("_cy"))
    b = points.select(group, F.col(key).alias("_q"), F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(score).alias("_t"), cell(x).alias("_cx"), cell(y).alias("_cy"))
    better = (F.col("_t") > F.col("_s")) | ((F.col("_t") == F.col("_s")) & (F.col("_q") < F.col("_k")))
    near = (F.col("_u") - F.col("_x")) ** 2 + (F.col("_v") - F.col("_y")) ** 2 < radius * radius
    gone = a.join(b, [group, "_cx", "_cy"]).where(better & near).select(group, F.col("_k").alias(key)).distinct()
    return few.join(gone, [group, key], "left_anti").select(*points.columns)


def splitmix64(x: Column) -> Column:
    """The splitmix64 step of a whole number, as unsigned decimal text of its 64 bits in a DECIMAL(20, 0)."""

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            z = v.fillna(0).to_numpy(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
        return pd.Series(z.astype(str)).where(v.notna().to_numpy(), None)

    return run(x.cast("bigint")).cast("decimal(20,0)")


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows whose keys hash lowest (unsigned), ties by key."""
    return rows.withColumn("_h", splitmix64(F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def natural_key(name: Column, width: int = 20) -> Column:
    """A text that sorts as the name with its runs of digits compared as numbers."""
    tokens = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^\d"), F.lpad(F.regexp_replace(t, r"^0+(?=\d)", ""), width, "0")).otherwise(t)), "")


def cache_plan(uses: DataFrame, stream: str, order: str, name: str, capacity: int) -> DataFrame:
    """``(stream, order, name, hit, held)``: a cache that drops the name used again last; ``held`` names stay after each use."""
    schema = f"{stream} {uses.schema[stream].dataType.simpleString()}, {order} {uses.schema[order].dataType.simpleString()}, {name} {uses.schema[name].dataType.simpleString()}, hit boolean, held int"
    nxt = F.lead(order).over(Window.partitionBy(stream, name).orderBy(order))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        held: dict = {}
        hits, sizes = [], []
        for n, following in zip(g[name], g["_next"]):
            hits.append(n in held)
            held.pop(n, None)
            if not pd.isna(following):
                held[n] = following
                if len(held) > capacity:
                    held.pop(max(held, key=lambda x: (held[x], str(x))))
            sizes.append(len(held))
        return pd.DataFrame({stream: g[stream], order: g[order], name: g[name], "hit": hits, "held": sizes})

    return uses.select(stream, order, name, nxt.alias("_next")).groupBy(stream).applyInPandas(run, schema)


def overlay_edges(edges: DataFrame, a: str, b: str, accepted: Column, support: str, score: str, most: int) -> DataFrame:
    """The ``most`` accepted edges by (support desc, pair), then all others by pair; scores are clipped to 0..1."""
    rows = edges.withColumn("accepted", accepted).withColumn(score, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
    top = rows.where("accepted").orderBy(F.desc(support), a, b).limit(most)
    return top.unionByName(rows.where("not accepted"))


def evenly_spaced(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """Rows at positions round(i * (m - 1) / (n - 1)), halves to even, each once."""
    w = Window.partitionBy(by).orderBy(*order)
    numbered = rows.withColumn("_n", F.row_number().over(w) - 1).withColumn("_m", F.count("*").over(Window.partitionBy(by)))
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_m") - 1) / (n - 1)).cast("int"))
    return numbered.where(F.array_contains(at, F.col("_n"))).drop("_n", "_m")
