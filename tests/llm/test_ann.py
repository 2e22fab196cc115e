import numpy as np
import pytest

from sparkloom.llm.ann import AnnOptions, CentroidGraph, balanced_centroids, distances, nearest


def plain(rows, queries, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    all_best = {}
    for q, v in queries:
        if q is None or v is None or None in v or not np.isfinite(v).all() or not any(v):
            continue
        best = all_best.setdefault(q, {})  # an id that is asked with several vectors gets the best of all
        for i, x in fine:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float(np.dot(np.array(v, float), x)))
    return {q: sorted(best.items(), key=lambda r: (-r[1], r[0]))[:k] for q, best in all_best.items() if best}


def found(spark, rows, queries, k, **kw):
    make = lambda x: spark.createDataFrame([(*r, "x") for r in x], "vec_id bigint, embedding array<float>, rank string")
    out = {}
    for r in nearest(make(rows), make(queries), k, **kw).orderBy("query_id", "rank").collect():
        own = out.setdefault(r.query_id, [])
        assert r.rank == len(own) + 1
        own.append((r.vec_id, r.score))
    return out


def as32(x):
    return [float(v) for v in np.asarray(x, np.float32)]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    rows = [(i, as32(centres[i % 12] + 0.7 * rng.normal(size=24) * (1 + i % 3))) for i in range(1500)]
    queries = rows[::20]
    want = plain(rows, queries, 10)
    got = found(spark, rows, queries, 10, options=AnnOptions(list_rows=40, shard_rows=800, block_rows=60, sample=600))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in own}) for q, own in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {i: np.array(v) for i, v in rows}
    assert all(s == pytest.approx(float(exact[q] @ exact[i]), abs=1e-9) for q, own in got.items() for i, s in own)


def test_few_rows_ties_and_unusable(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [float("inf"), 0.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.5]), (2, [1.0, 0.0]), (2, [0.5, 0.0]), (9, [-0.0, 2.0])]
    rows += [(100 + i, [3.0, 3.0]) for i in range(60)]
    for k in (1, 3, 100):
        assert found(spark, rows, rows, k, options=AnnOptions(list_rows=10)) == plain(rows, rows, k)


def test_empty_and_different_lengths(spark):
    assert found(spark, [], [(1, [1.0])], 3) == {}
    assert found(spark, [(1, [1.0])], [(1, [1.0])], 3) == {}
    with pytest.raises(ValueError):
        found(spark, [(1, [1.0]), (2, [1.0, 2.0])], [], 3)


def test_graph_finds_the_centroids_within_the_ratio():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 16))
    c = balanced_centroids(x, 200, 10)
    sizes = np.bincount(distances(x, c).argmin(1), minlength=len(c))
    assert sizes.max() < 5 * sizes.mean()
    got, dist = CentroidGraph(c, 12).within(x[:200], 0.15, 3)
    full = distances(x[:200], c)
    want = full <= full.min(1, keepdims=True) * 1.15
    hit = sum(len(set(np.flatnonzero(w)) & set(g[g >= 0].tolist())) for w, g in zip(want, got))
    assert hit >= 0.95 * want.sum() and (np.diff(np.where(np.isfinite(dist), dist, 99)) >= 0).all()
