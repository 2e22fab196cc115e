"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Vectors are extended by one component to a common length, so that the largest inner product is the least
distance. Centroids come from a size-penalised k-means over a bounded sample; every vector is entered in
the list of its nearest centroid and, near a boundary, in those of further centroids almost as near. An
in-memory graph over the centroids is searched best first, for vectors and queries alike; a query probes
the lists whose centroid's distance is within a ratio of the nearest one's. Lists longer than others are
cut into blocks, and blocks are packed into shards of even size; a task holds one shard and scores the
queries that probe it, exactly and in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import stored


@dataclass(frozen=True)
class AnnOptions:
    """``sample``: rows that centroids are fitted on, at most. ``list_rows``: rows of a list on average.
    ``max_lists`` bounds the centroids, which every task holds. ``replicas`` and ``closure``: a vector is in
    at most so many lists, with centroids at most ``1 + closure`` times as far as the nearest. ``ratio``: a
    query probes lists up to ``1 + ratio`` times as far as the nearest. ``shard_rows``: rows of a task."""

    sample: int = 20_000
    list_rows: int = 256
    max_lists: int = 16_384
    replicas: int = 4
    closure: float = 0.05
    ratio: float = 0.15
    block_rows: int = 4_096
    shard_rows: int = 40_000
    degree: int = 24
    rounds: int = 12


class CentroidGraph:
    """Centroids linked to near ones; edges are pruned so that they lead in different directions."""

    def __init__(self, centroids: np.ndarray, degree: int):
        self.centroids = centroids.astype(np.float64)
        k = len(centroids)
        self.near = np.full((k, 2 * degree), -1, np.int64)
        links: list[set[int]] = [set() for _ in range(k)]
        for at in range(0, k, 512):
            d = distances(self.centroids[at : at + 512], self.centroids)
            order = np.argsort(d, axis=1, kind="stable")[:, 1 : 4 * degree + 1]
            for i, own in enumerate(order, at):
                kept: list[int] = []
                for j in own.tolist():  # a link is left out if a kept one is nearer to its end than this centroid is
                    if len(kept) < degree and all(((self.centroids[j] - self.centroids[m]) ** 2).sum() > d[i - at, j] ** 2 for m in kept):
                        kept.append(j)
                links[i].update(kept or own[:1].tolist())
        for i in range(k):
            for j in list(links[i]):
                if len(links[j]) < 2 * degree:
                    links[j].add(i)
        for i in range(1, k):  # one chain through all, so that every centroid can be reached
            if not links[i] or i % degree == 0:
                links[i].add(i - 1)
        for i, own in enumerate(links):
            own = sorted(own)[: 2 * degree]
            self.near[i, : len(own)] = own
        self.entries = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(int))

    def within(self, x: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x`` the centroids found, nearest first, padded with -1, and their distances: those
        within ``1 + ratio`` of the nearest, and ``least`` in any case. Expands all rows together, each its best."""
        n, k = len(x), len(self.centroids)
        least = min(least, k)
        dist = np.full((n, k), np.inf)
        dist[:, self.entries] = distances(x, self.centroids[self.entries])
        done = np.zeros((n, k), bool)
        rows = np.arange(n)
        while len(rows):
            waiting = np.where(done[rows], np.inf, dist[rows])
            best = waiting.argmin(1)
            bound = np.maximum(dist[rows].min(1) * (1 + ratio) * 1.1, np.partition(dist[rows], least - 1, axis=1)[:, least - 1])
            go = waiting[np.arange(len(rows)), best] <= bound
            go &= np.isfinite(waiting[np.arange(len(rows)), best])
            rows, best = rows[go], best[go]
            done[rows, best] = True
            near = self.near[best]
            r, c = np.repeat(rows, near.shape[1]), near.ravel()
            new = (c >= 0) & ~np.isfinite(dist[r, c])
            r, c = r[new], c[new]
            dist[r, c] = np.sqrt(((x[r] - self.centroids[c]) ** 2).sum(1))
        order = np.argsort(dist, axis=1, kind="stable")
        d = np.take_along_axis(dist, order, 1)
        keep = np.isfinite(d) & ((d <= d[:, :1] * (1 + ratio)) | (np.arange(k) < least))
        width = max(1, int(keep.sum(1).max(initial=1)))
        return np.where(keep, order, -1)[:, :width], d[:, :width]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1), 0))


def balanced_centroids(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k-means in which a cluster's distance grows with its share of the rows beyond the even one."""
    rng = np.random.default_rng(7)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    load = np.ones(k)
    for _ in range(rounds):
        owner = np.empty(len(x), np.int64)
        spread = 0.0
        for at in range(0, len(x), 2048):
            d = distances(x[at : at + 2048], c) ** 2
            spread = max(spread, float(d.min(1).mean()))
            owner[at : at + 2048] = (d + 0.1 * spread * np.maximum(load - 1, 0)).argmin(1)
        counts = np.bincount(owner, minlength=k)
        load = counts * k / len(x)
        sums = np.zeros_like(c)
        np.add.at(sums, owner, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, not zero, and all components finite."""
    fine = F.forall(embedding, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return embedding.isNotNull() & fine & F.exists(embedding, lambda v: v != 0)


def _extended(flat: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(top * top - (flat**2).sum(1), 0))
    return np.hstack([flat, rest[:, None]])


def _matrix(column, d: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d) if isinstance(column, pa.Array) else np.array(column.tolist(), np.float64).reshape(-1, d)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", options: AnnOptions = AnnOptions()) -> DataFrame:
    """``(query_id, rank, id_col, score)``: the ``k`` nearest found of each query, ties to smaller ids.

    Candidates are all rows of ``vectors`` but those with the query's own id; with at most ``k`` of them all
    are found. Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    with a null id; all others must have one length, else the job fails. Rows that repeat an id count once,
    with the best of their scores; so does a query id asked with several vectors. Equal vectors are entered once with their ``k + 1`` smallest ids, which
    is all of them that a result can hold. Other columns are ignored; empty tables give no rows.
    """
    spark, o = vectors.sparkSession, options
    as_doubles = lambda df: df.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).alias("id"), F.transform(vec_col, lambda v: v.cast("double") + 0.0).alias("v"))
    kind = vectors.schema[id_col].dataType.simpleString()
    number = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    base = stored(as_doubles(vectors).distinct().withColumn("n", number).where(F.col("n") <= k + 1).drop("n"), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, v: s + v * v))
    rows, top, d, d_least = base.agg(F.count("*"), F.max(norm), F.max(F.size("v")), F.min(F.size("v"))).first()
    asked = stored(as_doubles(queries).distinct(), "queries")
    out = f"query_id {kind}, `{id_col}` {kind}, score double"
    if not rows:
        return spark.createDataFrame([], f"query_id {kind}, rank int, `{id_col}` {kind}, score double")
    if d != d_least or asked.where(F.size("v") != d).limit(1).count():
        raise ValueError("vectors differ in length")
    sample = base.orderBy(F.xxhash64("v"), "id").limit(o.sample).select("v").toPandas()
    lists = max(1, min(o.max_lists, round(rows / o.list_rows)))
    graph = CentroidGraph(balanced_centroids(_extended(_matrix(sample["v"], d), top), lists, o.rounds), o.degree)
    sent = spark.sparkContext.broadcast(graph)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                found, _ = sent.value.within(_extended(_matrix(part.column(1), d), top), o.closure, 1)
                found = found[:, : o.replicas]
                row, col = np.nonzero(found >= 0)
                take = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([take.column(0), take.column(1), pa.array(found[row, col].astype(np.int32)), pa.array(col == 0)], ["id", "v", "list", "first"])

    entered = stored(base.mapInArrow(enter, f"id {kind}, v array<double>, list int, first boolean"), "entered")
    sizes = {r.list: (r.n, r.own) for r in entered.groupBy("list").agg(F.count("*").alias("n"), F.count_if("first").alias("own")).collect()}
    shards = max(1, -(-sum(n for n, _ in sizes.values()) // o.shard_rows))
    blocks = {i: -(-n // o.block_rows) for i, (n, _) in sizes.items()}
    heap = [(0, s) for s in range(shards)]  # the next largest block goes to the least filled shard
    shard_of: dict[int, list[int]] = {}
    for i in sorted(blocks, key=lambda i: (-sizes[i][0] / blocks[i], i)):
        for _ in range(blocks[i]):
            fill, s = heapq.heappop(heap)
            shard_of.setdefault(i, []).append(s)
            heapq.heappush(heap, (fill + sizes[i][0] // blocks[i], s))
    plan = spark.sparkContext.broadcast((shard_of, {i: own for i, (_, own) in sizes.items()}))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard_of, _ = plan.value
        for batch in batches:
            own = [shard_of[i][h % len(shard_of[i])] for i, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *batch.columns[:3]], ["shard", "id", "v", "list"])

    postings = entered.select("id", "v", "list", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("h")).mapInArrow(place, f"shard int, id {kind}, v array<double>, list int")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, (shard_of, own) = sent.value, plan.value
        have = np.array([own.get(i, 0) for i in range(len(graph.centroids))])
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                x = _matrix(part.column(1), d)
                x = np.hstack([x * (top / np.sqrt((x**2).sum(1)))[:, None], np.zeros((len(x), 1))])
                found, _ = graph.within(x, o.ratio, 1)
                short = np.flatnonzero(np.where(found >= 0, have[found], 0).sum(1) <= k)
                lists = [f[f >= 0] for f in found]
                for i in short.tolist():  # too few rows there: all lists
                    lists[i] = np.arange(len(have))
                row, shard, probed = [], [], []
                for i, own_lists in enumerate(lists):
                    by: dict[int, list[int]] = {}
                    for j in own_lists.tolist():
                        for s in set(shard_of.get(j, ())):
                            by.setdefault(s, []).append(j)
                    for s, js in by.items():
                        row.append(i), shard.append(s), probed.append(js)
                take = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), take.column(0), take.column(1), pa.array(probed, pa.list_(pa.int32()))], ["shard", "id", "v", "lists"])

    probes = asked.mapInArrow(probe, f"shard int, id {kind}, v array<double>, lists array<int>")

    def search(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asking):
            return pd.DataFrame({"query_id": [], id_col: [], "score": []})
        v, q = _matrix(own["v"], d), _matrix(asking["v"], d)
        ids, qids = own["id"].to_numpy(), asking["id"].to_numpy()
        members = {i: at.to_numpy() for i, at in own.reset_index(drop=True).groupby("list").groups.items()}
        who: dict[int, list[int]] = {}
        for i, probed in enumerate(asking["lists"]):
            for j in probed:
                who.setdefault(int(j), []).append(i)
        found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        for j, qs in who.items():
            at = members.get(j)
            if at is None:
                continue
            for lo in range(0, len(qs), 1024):
                part = np.array(qs[lo : lo + 1024])
                s = q[part] @ v[at].T
                s[qids[part][:, None] == ids[at][None, :]] = -np.inf
                worst = np.partition(s, len(at) - k, axis=1)[:, len(at) - k] if len(at) > k else np.full(len(part), -np.inf)
                slack = 1e-12 * top * np.sqrt((q[part] ** 2).sum(1))  # products by blocks are rounded differently; those kept are scored anew
                r, c = np.nonzero((s >= (worst - slack)[:, None]) & (s > -np.inf))  # with all ties of the last place
                found.append((part[r], at[c], s[r, c]))
        r, c, s = (np.concatenate(x) for x in zip(*found))
        s = np.einsum("ij,ij->i", q[r], v[c]) if len(r) else s
        order = np.lexsort((ids[c], -s, r))
        r, c, s = r[order], c[order], s[order]
        first = ~pd.DataFrame({"r": r, "id": ids[c]}).duplicated().to_numpy()  # a vector in several lists
        r, c, s = r[first], c[first], s[first]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        keep = rank < k
        return pd.DataFrame({"query_id": qids[r[keep]], id_col: ids[c[keep]], "score": s[keep]})

    found = postings.groupBy("shard").cogroup(probes.groupBy("shard")).applyInPandas(search, out)
    best = found.groupBy("query_id", id_col).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), id_col, "score")


def op2_ann_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0)).select(F.col("query_id").cast("bigint").alias("query_id"), "rank", F.col("vec_id").cast("bigint").alias("vec_id"), "score")
