import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scalars as sc
from sparkloom.operators import scans
from sparkloom.operators import components, graph, kernels, pairs, stats, topk
from sparkloom.plans import catalog
from sparkloom.sources import readers
from sparkloom.streaming import incremental as inc


def curve(errors, t):
    e = sorted(errors)
    n = len(e)
    xs, ys = [0.0], [0.0]
    for i, x in enumerate(e):
        if x < t:
            xs.append(x)
            ys.append((i + 1) / n)
    xs.append(t)
    ys.append(ys[-1])
    return sum((xs[i + 1] - xs[i]) * (ys[i + 1] + ys[i]) / 2 for i in range(len(xs) - 1)) / t


def test_error_auc(spark):
    rng = random.Random(1)
    groups = {1: [1.0], 2: [5.0, 5.0, 9.0], 3: [1e6, 1e6], 4: [rng.random() * 10 for _ in range(30)] + [1e6, 2.0, 2.0]}
    df = spark.createDataFrame([(g, e) for g, own in groups.items() for e in own] + [(1, float("nan")), (1, None)], "g bigint, e double")
    for r in stats.error_auc(df, ["g"], "e", [2.0, 5.0]).collect():
        assert r.auc == pytest.approx(curve(groups[r.g], r.threshold), abs=6e-5)
        assert r.recall == pytest.approx(sum(e <= r.threshold for e in groups[r.g]) / len(groups[r.g]), abs=6e-5)


def test_medians_and_mad(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0), (1, 8.0), (2, 3.0), (2, 3.0), (3, None)], "g bigint, v double")
    got = {r.g: r.sigma for r in stats.mad_sigma(df, ["g"], "v", 0.01).collect()}
    assert got == {1: pytest.approx(1.4826 * 1.5), 2: 0.01, 3: 1.0}
    assert {r.g: r.scale for r in stats.median_scale(df, ["g"], F.col("v")).collect()} == {1: 3.0, 2: 3.0, 3: 1.0}


def test_inlier_filters(spark):
    p = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "pair bigint, valid boolean")
    m = spark.createDataFrame([(1, False), (2, True), (2, True), (2, False)], "pair bigint, inlier boolean")
    by_ratio = {r.pair: (r.valid, r.newly_invalid) for r in pairs.filter_by_inliers(p, m, "pair", F.col("inlier"), ratio=0.5).collect()}
    assert by_ratio == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, False)}
    by_count = {r.pair: r.newly_invalid for r in pairs.filter_by_inliers(p, m, "pair", F.col("inlier"), least=1).collect()}
    assert by_count == {1: True, 2: False, 3: True, 4: False}


def test_pair_names_and_ids(spark):
    df = spark.createDataFrame([("a/b", "c"), ("a-b", "c"), ("x", "y")], "a string, b string")
    assert [(r.name, r.pairs) for r in pairs.name_collisions(df, "a", "b").collect()] == [("a-b/c", 2)]
    one = spark.createDataFrame([(9, 4)], "a bigint, b bigint").select(pairs.pair_id(F.col("a"), F.col("b")).alias("p"))
    assert one.select(*[c.alias(n) for n, c in zip("ij", pairs.pair_ends(F.col("p")))]).first() == (4, 9)


def test_merge_keeps_ordinals(spark):
    base = spark.createDataFrame([(1, 10, 20, 0), (1, 11, 21, 1)], "pair bigint, a bigint, b bigint, row bigint")
    ext = spark.createDataFrame([(1, 10, 99, 0), (1, 12, 21, 1), (1, 13, 23, 2), (2, 1, 1, 0)], base.schema)
    got = sorted(tuple(r) for r in pairs.merged_matches(base, ext, "pair", "a", "b", "row").collect())
    assert got == [(1, 10, 20, 0, False), (1, 11, 21, 1, False), (1, 13, 23, 2, True), (2, 1, 1, 0, True)]


def test_loop_without_score_is_an_error(spark):
    m = spark.createDataFrame([(1, True), (2, False)], "k bigint, lc boolean")
    s = spark.createDataFrame([(2, 0.5)], "k bigint, sc double")
    with pytest.raises(Exception, match="no score"):
        pairs.loops_by_score(m, s, ["k"], F.col("lc"), "sc", 0.1).collect()


def plain_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 180)] + [(500, 501), (501, 502), (502, 500), (7, 7)] + [(1000, 1000 + i) for i in range(50)]
    edges += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    df = spark.createDataFrame(edges + [(None, 1), (2, None)], "src bigint, dst bigint")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == plain_components([e for e in edges if e[0] != e[1]])
    assert components.connected_components(df.where("false")).count() == 0


def test_reachable_equals_literal_rounds(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(70)]
    seeds = {1, 2, 100}
    tainted = set(seeds)
    while new := {b for a, b in edges if a in tainted} - tainted:
        tainted |= new
    e, s = spark.createDataFrame(edges, "a bigint, b bigint"), spark.createDataFrame([(x,) for x in seeds], "n bigint")
    assert {r.n for r in graph.reachable(s, e, "n", "a", "b").collect()} == tainted


def test_consistency_boundary(spark):
    rows = [(1, 1, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 0.0, 0.0), (2, 1, 0.0, 0.0), (2, 1, 10.01, 0.0), (2, 2, 0.0, 0.0), (3, 1, 0.0, 0.0), (4, 1, 0.0, 0.0), (4, 1, 8.0, 8.0), (4, 2, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "track bigint, image bigint, x double, y double")
    got = {r.track for r in graph.consistent(df, "track", "image", "x", "y", 10.0, 2).collect()}
    assert got == {1}


def test_bridges_equal_kruskal(spark):
    rng = random.Random(4)
    tracking = [(i, i + 1) for i in range(0, 30, 3)]
    others = list({(rng.randrange(32), rng.randrange(32)) for _ in range(90)})
    others = [(a, b, rng.randrange(20), i) for i, (a, b) in enumerate(others) if a != b]
    root = {i: i for i in range(32)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in tracking:
        root[find(a)] = find(b)
    want = []
    for a, b, gap, i in sorted(others, key=lambda r: (r[2], r[3])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append((a, b, gap, i))
    n = spark.createDataFrame([(i,) for i in range(32)], "v bigint")
    got = graph.bridges(n, spark.createDataFrame(tracking, "a bigint, b bigint"), spark.createDataFrame(others, "a bigint, b bigint, gap bigint, i bigint"), "v", "a", "b", ["gap", "i"])
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_loop_observations(spark):
    t = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "obs bigint, track bigint")
    loops = spark.createDataFrame([(1, 3), (1, 2), (3, 9), (7, 8)], "a bigint, b bigint")
    got = {tuple(r) for r in graph.loop_observations(t, loops, "a", "b").collect()}
    assert got == {(1, 3, 1), (3, 1, 3), (3, 9, 3), (9, 3, 9), (7, 8, 7), (8, 7, 8)}


def test_nms_variants_differ_on_a_chain(spark):
    chain = [(1, 1, 0.0, 0.0, 0.9), (1, 2, 2.0, 0.0, 0.8), (1, 3, 4.0, 0.0, 0.7), (1, 4, 6.0, 0.0, 0.7)]
    df = spark.createDataFrame(chain, "g bigint, id bigint, x double, y double, score double")
    assert sorted(r.id for r in kernels.greedy_spatial_nms(df, "g", 2.0).collect()) == [1, 3]
    assert sorted(r.id for r in topk.one_shot_nms(df, "g", "id", "x", "y", "score", 2.5).collect()) == [1]
    assert sorted(r.id for r in topk.one_shot_nms(df, "g", "id", "x", "y", "score", 2.0).collect()) == [1, 2, 3, 4]


def test_endpoint_nms(spark):
    df = spark.createDataFrame([(1, 0, 10, 0.9), (1, 5, 15, 0.8), (1, 6, 16, 0.7), (1, 0, 10, 0.95), (2, 0, 10, 0.1)], "g bigint, first bigint, second bigint, score double")
    got = sorted(tuple(r) for r in kernels.greedy_endpoint_nms(df, "g", 5).collect())
    assert got == [(1, 0, 10, 0.95), (1, 6, 16, 0.7), (2, 0, 10, 0.1)]


def test_retrieval_ties_and_threshold(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0]), (4, [0.4, 1.0]), (5, None), (6, [float("nan"), 0.0])], "i bigint, v array<double>")
    got = sorted((r.query, r["rank"], r.ref, r.score) for r in topk.retrieve(df, df.where("i <= 2"), "i", "v", 2, 0.5, block=1).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 0.5), (2, 1, 1, 1.0), (2, 2, 3, 0.5)]


def test_splitmix_and_natural_key(spark):
    def ref(x):
        m = (1 << 64) - 1
        z = (x + 0x9E3779B97F4A7C15) & m
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
        return z ^ (z >> 31)

    ids = [0, 1, 7, 2**62]
    got = spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", topk.splitmix64(F.col("i")).alias("h")).collect()
    assert {r.i: int(r.h) for r in got} == {i: ref(i) for i in ids}
    names = ["a10b", "a2b", "a02a", "b1", "A1", "a2b10", "a2b9"]
    order = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(topk.natural_key(F.col("n")), "n").collect()]
    assert order == ["A1", "a02a", "a2b", "a2b9", "a2b10", "a10b", "b1"]


def test_scalars(spark):
    df = spark.createDataFrame([("d/12.5.jpg",), ("1700000000.123456789-x.png",), ("none.jpg",), ("3.0000000001.png",)], "n string")
    got = [(r.s, r.ns) for r in df.select(sc.seconds_of_name(F.col("n")).alias("s"), sc.nanoseconds_of_name(F.col("n")).alias("ns")).collect()]
    assert got == [(12.5, 12_500_000_000), (1700000000.123456789, 1_700_000_000_123_456_789), (0.0, None), (3.0000000001, None)]
    assert sc.fingerprint({"b": 1, "a": [2]}) == sc.fingerprint({"a": [2], "b": 1})
    one = spark.range(1).select(sc.metric_key(F.lit(25), F.lit(1.25)).alias("a"), sc.metric_key(F.lit(None).cast("int"), F.lit(5.0)).alias("b"), sc.canonical_number(F.lit(-1e-12)).alias("z")).first()
    assert (one.a, one.b, str(one.z)) == ("wate_auc_25@1.25m", "wate_auc_full@5pct", "0.0")


def test_sources_reject_what_is_unsound(spark, tmp_path):
    (tmp_path / "f.csv").write_text("frame_id,timestamp_ns,camera_id,image_name\n1,10,1,a\n2,10,1,b\n")
    with pytest.raises(Exception, match="not sound"):
        readers.read_frame_table(spark, f"file://{tmp_path}/f.csv").collect()
    (tmp_path / "p.txt").write_text("# c\n1.5 0 0 0 0 0 0 1\n2 0 0 0 0 0 0 1\n3 0 0 0 0 0 1 1\n")
    with pytest.raises(Exception, match="not sound"):
        readers.read_poses(spark, f"file://{tmp_path}/p.txt").collect()
    (tmp_path / "m.json").write_text('{"schemaVersion": 1, "pairs": [{"first": "a", "second": "b", "matchCount": 4, "loopClosureMatchIndices": [1, 3]}]}')
    masks = readers.read_masks(spark, f"file://{tmp_path}/m.json")
    assert [r.is_lc for r in readers.decode_masks(masks, "first", "second").orderBy("row").collect()] == [False, True, False, True]
    bad = masks.withColumn("loopClosureMatchIndices", F.array(F.lit(3), F.lit(1)))
    with pytest.raises(Exception, match="not sound"):
        readers.decode_masks(bad, "first", "second").collect()


def test_sqlite_source(spark, tmp_path):
    import sqlite3

    db = sqlite3.connect(tmp_path / "x.db")
    db.execute("CREATE TABLE images (image_id INTEGER, name TEXT)")
    db.executemany("INSERT INTO images VALUES (?, ?)", [(1, "a"), (2, None)])
    db.commit()
    db.close()
    got = readers.read_sqlite(spark, f"file://{tmp_path}/x.db", "images", "image_id bigint, name string")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a"), (2, None)]


def test_keyframes(spark):
    rows = [(1, i, [0.04] * 4, [True] * 4, i == 5) for i in range(9)]
    df = spark.createDataFrame(rows, "s bigint, t bigint, step array<double>, seen array<boolean>, forced boolean")
    got = [(r.t, r.reason) for r in inc.select_keyframes(df, "s", "t", 0.1, 0.5).orderBy("t").collect()]
    assert got[0] == (0, "first") and got[-1][0] == 8 and (5, "forced") in got and all(a < b for (a, _), (b, _) in zip(got, got[1:]))
    assert inc.select_keyframes(df.where("t = 0"), "s", "t", 0.1, 0.5).count() == 1


def test_admission_as_stream(spark, tmp_path):
    schema = "s bigint, t bigint, v double"
    rows = [(s, t, float((t * 7 + s) % 13)) for s in (1, 2) for t in range(20)]
    want = sorted(tuple(r) for r in inc.admitted(spark.createDataFrame(rows, schema), "s", "t", "v", 4.0).collect())
    spark.createDataFrame([r for r in rows if r[1] < 10], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/a")
    spark.createDataFrame([r for r in rows if r[1] >= 10], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/b")
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"file://{tmp_path}/in")
    q = inc.admitted_stream(source, "s", "t", "v", 4.0).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == want


def test_cache_plan_is_optimal_on_a_small_case(spark):
    uses = [(1, i, n) for i, n in enumerate("abcabcab")]
    df = spark.createDataFrame(uses, "s bigint, t bigint, n string")
    got = [r.hit for r in topk.cache_plan(df, "s", "t", "n", 2).orderBy("t").collect()]
    assert sum(got) == 4


def test_artifacts(spark, tmp_path):
    from sparkloom.sources.artifacts import read_artifact, write_artifact

    df = spark.createDataFrame([(1, "a"), (2, None)], "k bigint, v string")
    at = f"file://{tmp_path}/a"
    write_artifact(df, at, {"x": 1, "threads": 2}, ("threads",))
    assert read_artifact(spark, at, "k bigint, v string", {"x": 1, "threads": 9}, ("threads",)).count() == 2
    with pytest.raises(ValueError, match="configuration"):
        read_artifact(spark, at, "k bigint, v string", {"x": 2}, ("threads",))
    df.limit(1).write.mode("append").parquet(f"{at}/data")
    with pytest.raises(ValueError, match="content"):
        read_artifact(spark, at, "k bigint, v string", {"x": 1}, ("threads",))
    write_artifact(df.where("false"), at, {"x": 1})
    assert read_artifact(spark, at, "k bigint, v string", {"x": 1}).count() == 0


def test_image_listing(spark, tmp_path):
    for name in ("a.jpg", "b.PNG", "c.txt"):
        (tmp_path / name).write_bytes(b"xy")
    got = readers.list_images(spark, f"file://{tmp_path}").collect()
    assert sorted(r.path.rpartition("/")[2] for r in got) == ["a.jpg", "b.PNG"] and {r.length for r in got} == {2}


def test_smoothing_spline_and_table_hash(spark):
    df = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate([0, 4, 1, 3])], "s bigint, t bigint, v double")
    a = 1 - math.exp(-1 / 2.0)
    ahead = [0.0]
    for v in (4, 1, 3):
        ahead.append(ahead[-1] + a * (v - ahead[-1]))
    back = [3.0]
    for v in (1, 4, 0):
        back.append(back[-1] + a * (v - back[-1]))
    got = [r.smoothed for r in scans.smoothed(df, "s", "t", "v", 2.0).orderBy("t").collect()]
    assert got == pytest.approx([(x + y) / 2 for x, y in zip(ahead, back[::-1])])
    curve_rows = {round(r.t, 6): r.v for r in scans.spline(df, "s", "t", "v", 2).collect()}
    assert [curve_rows[t] for t in (0.0, 1.0, 2.0, 3.0)] == pytest.approx([0, 4, 1, 3]) and len(curve_rows) == 7
    one = sc.table_hash(df, ["s"], ["t", "v"]).first().digest
    assert one == sc.table_hash(df.orderBy(F.desc("t")).repartition(3), ["s"], ["t", "v"]).first().digest
    assert one != sc.table_hash(df.withColumn("v", F.col("v") + (F.col("t") == 2).cast("int")), ["s"], ["t", "v"]).first().digest


def test_columns_named_like_helpers_stay(spark):
    from sparkloom.operators import pairs as pr
    from sparkloom.operators.ranks import ranked

    df = spark.createDataFrame([(1, 2, 0.5, "a", 7, 8, 9), (2, 1, 0.7, "b", 7, 8, 9), (3, 4, 0.1, "c", 7, 8, 9)], "a int, b int, s double, _r string, _v int, _k0 int, _part int")
    for got in (pr.first_direction(df, "a", "b", ["a"]), topk.capped(df, "a", "b", [F.lit(1)], "s", 9), pr.union_first([df, df], "a", "b", "s")):
        assert got.columns == df.columns and got.count() == 2 and {r._v for r in got.collect()} == {7}
    assert [(r._r, r._v, r.n, r.t) for r in ranked(df, ["s"], "n", "t", "_v").orderBy("n").collect()] == [("c", 7, 1, 7), ("a", 7, 2, 14), ("b", 7, 3, 21)]


def test_auc_errors_and_report(spark):
    full = spark.createDataFrame([(1, "a", 4.0, True, 2.0), (1, "b", 1e6, False, 2.0), (1, "c", float("nan"), True, 2.0), (2, "a", 1.0, True, 0.0), (3, "a", None, None, 5.0)], "s int, n string, error double, have boolean, path_length double")
    windows = spark.createDataFrame([(1, 10, "a", 0.5), (1, 50, "c", 0.25)], "s int, window int, n string, error double")
    got = sorted((r.s, r.window or 0, r.n, r.error) for r in stats.auc_errors(full, windows, "s", "n").collect())
    assert got == [(1, 0, "a", 2.0), (1, 0, "b", 5e5), (1, 10, "a", 0.5), (1, 10, "b", 1e6), (1, 10, "c", 1e6), (1, 50, "a", 1e6), (1, 50, "b", 1e6), (1, 50, "c", 0.25), (3, 0, "a", 2e5)]
    got = sorted((r.s, r.window or 0, r.n, r.error) for r in stats.auc_errors(full, windows, "s", "n", penalty=None).collect())
    assert got == [(1, 0, "a", 2.0), (1, 0, "b", 5e5), (1, 10, "a", 0.5), (1, 50, "c", 0.25)]
    rows = spark.createDataFrame([("x", "p", 0.5), ("x", "q", 3.0), ("y", "p", None)], "scene string, target string, e double")
    cases = spark.createDataFrame([("x", True), ("x", False), ("x", None), ("y", True)], "scene string, completed boolean")
    lines = stats.report_lines(rows, cases, "scene", "target", "e", [1.0, 2.0, 4.0]).orderBy("threshold").collect()
    assert [(r.scene, r.threshold, r.completed, r.failed) for r in lines] == [("x", 1.0, 1, 2), ("x", 2.0, 1, 2)] and lines[0].percent == pytest.approx(37.5)
    counts = stats.summed_counts(spark.createDataFrame([("x", "k", 2), ("x", "k", 5), ("x", "k", None)], "scene string, key string, n int"), "scene", "key", "n").collect()
    assert [tuple(r) for r in counts] == [("x", "k", 7, 2)]


def test_median_of_a_whole_table(spark):
    rng = random.Random(9)
    cases = [[], [None], [5.0], [1.0, 2.0], [None, 3.0, 3.0, 3.0, -1.0], [rng.choice([0.0, 1e9]) for _ in range(101)], [rng.gauss(0, 1) ** 9 for _ in range(3000)], [1.0] * 500 + [2.0] * 500, [float("inf")] * 4 + [7.0] * 4]
    for values in cases:
        frame = spark.createDataFrame([(v,) for v in values], "x double")
        held = sorted(v for v in values if v is not None)
        want = (held[(len(held) - 1) // 2] + held[len(held) // 2]) / 2 if held else None
        found = stats.whole_median(frame.repartition(3), "x")
        assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString() and [r.median for r in found.collect()] == [want]


def test_scale_stats_keep_no_task_with_all_values(spark):
    plan = catalog.QUERIES["a24_scale_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "median(" not in plan
