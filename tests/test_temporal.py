import random
from bisect import bisect_left, bisect_right

import pytest

from sparkloom.operators import temporal as tm


def asof(spark, source, target, bucket=None):
    s = spark.createDataFrame(source, "s bigint, t bigint")
    d = spark.createDataFrame(target, "s bigint, t bigint")
    return tm.bracket(s, d, "s", "t", bucket)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


TARGET = [(1, 10), (1, 20), (1, 20), (1, 40)]


@pytest.mark.parametrize("bucket", [None, 7, 1000])
def test_bracket_boundaries(spark, bucket):
    got = {r.t: (r.prev, r.next, r.fraction) for r in asof(spark, [(1, t) for t in (5, 10, 15, 20, 30, 40, 41)], TARGET, bucket).collect()}
    assert got == {5: (None, 10, 0.0), 10: (10, 10, 0.0), 15: (10, 20, 0.5), 20: (20, 20, 0.0), 30: (20, 40, 0.5), 40: (40, 40, 0.0), 41: (40, None, None)}
    assert asof(spark, [], TARGET, bucket).count() == 0
    assert [(r.prev, r.next) for r in asof(spark, [(2, 3), (None, 3), (1, None)], TARGET, bucket).collect()] == [(None, None)] * 3


def test_bracket_against_bisect(spark):
    rng = random.Random(1)
    target = [(rng.randrange(3), rng.randrange(200)) for _ in range(60)]
    source = [(rng.randrange(4), rng.randrange(-10, 220)) for _ in range(200)]
    want = []
    for s, t in source:
        own = sorted(x for g, x in target if g == s)
        i, j = bisect_right(own, t), bisect_left(own, t)
        want.append((s, t, own[i - 1] if i else None, own[j] if j < len(own) else None))
    for bucket in (None, 13):
        got = [(r.s, r.t, r.prev, r.next) for r in asof(spark, source, target, bucket).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_nearest_ties_and_tolerance(spark):
    b = asof(spark, [(1, t) for t in (5, 15, 16, 30, 45, 46)], [(1, 10), (1, 20), (1, 40)])
    assert rows(tm.nearest(b, "t"), "t", "nearest") == [(5, 10), (15, 10), (16, 20), (30, 20), (45, 40), (46, 40)]
    got = {r.t: r.nearest for r in tm.nearest(b, "t", 5).collect()}
    assert got == {5: 10, 15: 10, 16: 20, 30: None, 45: 40, 46: None}


@pytest.mark.parametrize("first,last,widest,want", [(False, True, None, {10: None, 15: 1.5, 40: 4.0, 30: 3.0, 5: None}), (True, False, 10, {10: 1.0, 15: 1.5, 40: None, 30: None, 5: None})])
def test_interpolation_ends(spark, first, last, widest, want):
    target = spark.createDataFrame([(1, 10, 1.0), (1, 20, 2.0), (1, 40, 4.0)], "s bigint, t bigint, v double")
    b = asof(spark, [(1, t) for t in want], [(1, 10), (1, 20), (1, 40)])
    got = tm.interpolated(b, target, "s", "t", "v", first, last, widest)
    assert {r.t: r.interpolated for r in got.collect()} == want


def test_path_windows(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 1, 1, 3, 6, 10])], "s bigint, k bigint, v double")
    walked = tm.path_lengths(df, "s", ["k"], "v")
    assert rows(walked, "k", "cum_len") == [(0, 0.0), (1, 1.0), (2, 1.0), (3, 3.0), (4, 6.0), (5, 10.0)]
    got = {(r.k, r.w): (r.lo, r.hi, r.n) for r in tm.path_windows(walked, "s", "k", [4.0, 11.0]).collect()}
    assert all(w == 4.0 for _, w in got)
    assert got[(0, 4.0)] == (0.0, 4.0, 4) and got[(3, 4.0)] == (1.0, 5.0, 3) and (5, 4.0) not in got and (4, 4.0) not in got


def test_context_window_and_chunks(spark):
    df = spark.createDataFrame([(1, i) for i in range(7)] + [(2, 0), (2, 1)], "s bigint, k bigint")
    got = {(r.s, r.k): (list(r.members), r.centre) for r in tm.context_window(df, "s", ["k"], "k", 3).collect()}
    assert got[(1, 0)] == ([0, 1, 2], 0) and got[(1, 3)] == ([2, 3, 4], 1) and got[(1, 6)] == ([4, 5, 6], 2) and got[(2, 1)] == ([0, 1], 1)
    chunks = tm.fixed_chunks(df, "s", ["k"], 3, 20)
    assert rows(chunks, "s", "chunk", "k") == [(1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 1, 3), (1, 1, 4), (1, 1, 5)]


def test_hops_and_first_direction(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 5), (1, 3, 7)], "s bigint, t bigint, k bigint")
    got = rows(tm.hop_pairs(df, "s", ["t"], "k", [1, 2]), "first", "second", "hop")
    assert got == [(5, 6, 1), (5, 7, 1), (6, 7, 2)]


def test_triplets_reject_standing_time(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 2, 2)], "s bigint, t bigint, k bigint")
    with pytest.raises(Exception, match="times do not increase"):
        tm.triplets(df, "s", "t", "k", F.lit(True)).collect()
