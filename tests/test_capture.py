import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from sparkloom.operators import capture as cp
from sparkloom.operators import graph as gr
from sparkloom.operators import stats as st
from sparkloom.operators.ranks import ranked


def fails(df):
    with pytest.raises(PySparkException):
        df.collect()


def test_ranks_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(50), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k bigint, o bigint, v bigint").repartition(7)
    got = sorted((r.r, r.k, r.t) for r in ranked(df, ["o", "k"], "r", "t", "v").collect())
    want, total = [], 0
    for i, (k, _, v) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])), 1):
        total += v
        want.append((i, k, total))
    assert got == want
    assert ranked(df.where("false"), ["o", "k"]).collect() == []
    plan = ranked(df, ["o", "k"])._jdf.queryExecution().toString()
    assert plan.count("SinglePartition") <= 1  # the parts' counts alone


def test_one_large_component(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), 1000 + rng.randrange(300)) for _ in range(900)] + [(5, 1000 + i) for i in range(250)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {n: find(n) for n in root}
    assert {r.obs: r.track for r in gr.tracks(df, "a", "b").collect()} == want
    assert max(list(want.values()).count(c) for c in set(want.values())) > 500
    seeds = spark.createDataFrame([(5,), (7,)], "node bigint")
    seen, front = {5, 7}, {5, 7}
    while front:
        front = {b for a, b in edges if a in front} - seen
        seen |= front
    assert {r.node for r in gr.reachable(seeds, df, "node", "a", "b").collect()} == seen


def test_kernel_density_is_the_whole_sum(spark):
    rng = random.Random(3)
    pts = [(i, rng.randrange(12) / 2, rng.randrange(40) / 4) for i in range(150)]
    got = {r.k: r.density for r in st.kernel_density(spark.createDataFrame([(1, *p) for p in pts], "g bigint, k bigint, x double, y double"), "g", "k", "x", "y", 1.0, 0.6).collect()}
    for k, x, y in pts:
        d = [math.hypot(x - u, y - v) for _, u, v in pts]
        assert got[k] == pytest.approx(sum(math.exp(-e * e / 2) for e in d if e >= 0.6 or e <= 1e-7), abs=150 * 1.6e-8)


def test_public_poses(spark):
    rows = [(1, 0.0, -1.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, -1.0, 1e-9), (4, None, -1.0, 0.0)]
    df = spark.createDataFrame(rows, "i int, x double, w double, t double")
    c = df.x, df.x, df.x, df.w
    assert [r.i for r in df.where(cp.has_public_pose(list(c), [df.t, df.t, df.t])).collect()] == [2, 3]


def test_image_selection(spark):
    there = spark.createDataFrame([(n,) for n in ("c/a10.png", "c/a9.PNG", "c/b.jpg")], "n string")
    pick = lambda *names: cp.selected_images(spark.createDataFrame([(n,) for n in names], "n string"), "n", there, "c")
    assert [r.n for r in pick("c/a10.png", "c/b.jpg", "c/a9.PNG").orderBy("rank").collect()] == ["c/a9.PNG", "c/a10.png", "c/b.jpg"]
    for bad in (("c/a10.png", "c/a10.png"), ("c/../a10.png",), ("/c/a10.png",), ("c//a10.png",), ("d/a.png",), ("c/x.gif",), ("c/none.png",), (None,), ("c\\\\a10.png",), ("c/.png",), ()):
        fails(pick(*bad))


def test_checked_selections(spark):
    images = spark.createDataFrame([(1, 1, 7, 0.5), (2, 1, 8, 0.5), (3, 2, 7, 0.5)], "image int, frame int, camera_id int, pose double")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "image int")
    got = cp.whole_frames(images, ids(1, 2), "image", "frame")
    assert got.columns == ["image", "frame", "camera_id"] and got.count() == 2
    fails(cp.whole_frames(images, ids(1), "image", "frame"))
    fails(cp.whole_frames(images, ids(3, 9), "image", "frame"))
    frames = lambda *x: spark.createDataFrame(list(x), "f int, t int")
    seq = cp.frame_sequence(frames((5, 3), (6, 1), (7, 2)), frames((5, 0), (7, 0)), "f", ["t"])
    assert sorted((r.ordinal, r.f) for r in seq.collect()) == [(0, 7), (1, 5)]
    fails(cp.frame_sequence(frames((5, 3)), frames((5, 0), (7, 0)), "f", ["t"]))
    fails(cp.frame_sequence(frames((5, 3), (5, 4)), frames((5, 0)), "f", ["t"]))
    files = lambda *x: spark.createDataFrame([(i,) for i in x], "p string")
    assert [r.basename for r in cp.existing_files(files("a/x", "b/y", "c/x"), files("a/x", "b/y"), "p").orderBy("p").collect()] == ["x", "y"]
    fails(cp.existing_files(files("a/x", "c/x"), files("a/x", "c/x"), "p"))
    cameras = spark.createDataFrame([(1, 4.0, 6.0, "P"), (1, 6.0, 8.0, "P"), (2, 1.0, 1.0, "Q")], "g int, fx double, fy double, model string")
    assert sorted((r.g, r.focal) for r in cp.initial_focals(cameras, "g", "fx", "fy", ["model"]).collect()) == [(1, 6.0), (2, 1.0)]
    fails(cp.initial_focals(cameras.withColumn("g", cameras.g * 0), "g", "fx", "fy", ["model"]))


def test_focal_priors(spark):
    cameras = spark.createDataFrame([(1, 640, 480)], "camera int, width int, height int")
    images = spark.createDataFrame([("b", 1, 2), ("a", 1, 1)], "image string, camera int, position int")
    obs = lambda *x: spark.createDataFrame(list(x), "image string, camera int, fx double, fy double, std array<double>, width int, height int")
    a, b = ("a", 1, 10.0, 30.0, [4.0, 2.0], 640, 480), ("b", 1, 5.0, 5.0, [1.0], 640, 480)
    assert [(x.focal, x.sigma) for x in cp.focal_priors(obs(b, a), cameras, images).first().rows] == [(20.0, 0.1), (5.0, 0.2)]
    for bad in ([a], [a, b, b], [a, ("b", 2, *b[2:])], [a, (*b[:5], 480, 640)]):
        fails(cp.focal_priors(obs(*bad), cameras, images))


def test_fixed_stereo_poses(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "first int, second int")
    images = spark.createDataFrame([(1, 1, 0, 10), (2, 1, 0, 11), (3, 2, 0, 10)], "image int, frame int, rig int, camera int")
    h = math.sqrt(0.5)

    def run(q=(0.0, 0.0, h, h), prior=True, t=(1.0, 2.0, 3.0), ref=True, second=11):
        sensors = spark.createDataFrame([(0, 10, True, ref, None, None), (0, 11, prior, False, list(q), list(t))], "rig int, camera int, has_prior boolean, is_ref boolean, q array<double>, t array<double>")
        return cp.fixed_stereo_poses(pairs, images.replace(11, second, "camera"), sensors)

    rows = run().collect()
    assert len(rows) == 1 and tuple(rows[0])[2:] == pytest.approx((0, 0, h, h, 1, 2, 3))
    for kw in ({"q": (0.0, 0.0, 1.0, 1.0)}, {"prior": False}, {"t": (1.0, float("nan"), 0.0)}, {"ref": False}, {"second": 10}):
        fails(run(**kw))


def test_path_up_equals_svd(spark):
    rng = np.random.default_rng(4)
    rows = [(g, *map(float, rng.normal(size=3) * (3, 1, 0.2) @ np.linalg.qr(rng.normal(size=(3, 3)))[0])) for g in range(4) for _ in range((2, 3, 30, 50)[g])]
    got = {r.g: (r.ux, r.uy, r.uz) for r in cp.path_up(spark.createDataFrame(rows, "g int, x double, y double, z double"), "g", "x", "y", "z").collect()}
    assert got[0] == (0, 0, 1)
    for g in (1, 2, 3):
        v = np.array([r[1:] for r in rows if r[0] == g])
        up = np.linalg.svd(v - v.mean(0))[2][-1]
        up = -up if up[np.abs(up).argmax()] < 0 else up
        assert got[g] == pytest.approx(tuple(up), abs=1e-6)


def test_timelines_by_name(spark):
    def run(*names):
        df = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "s int, i int, n string")
        return [(r.i, None if r.seconds is None else round(r.seconds, 6)) for r in cp.image_timelines(df, "s", "i", "n").orderBy("position").collect()]

    assert run("b/2.5.jpg", "a/1.5_x.jpg") == [(1, 0.0), (0, 1.0)]
    assert run("1700000002.jpg", "1700000001.jpg") == [(1, 0.0), (0, 1.0)]
    assert run("1700000000000.png", "1700000000500.png") == [(0, 0.0), (1, 0.5)]
    assert run("1700000000.png") == [(0, 0.0)]
    assert run("3.jpg", "x.jpg") == run("4.jpg", "4.jpg") == [(0, None), (1, None)]
    assert run("12.jpg", "7.jpg") == [(0, None), (1, None)]  # a step of 5 s, or of 0.005 s


def test_hash_sample(spark):
    from sparkloom.operators.topk import hash_sample

    def mix(x):
        m = (1 << 64) - 1
        z = (x + 0x9E3779B97F4A7C15) & m
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
        return z ^ (z >> 31)

    ids = list(range(-20, 300))
    got = {r.id for r in hash_sample(spark.createDataFrame([(i,) for i in ids], "id bigint"), "id", 40).collect()}
    assert got == set(sorted(ids, key=lambda i: (mix(i & ((1 << 64) - 1)), i))[:40])


def test_mapping_timeline_and_what_breaks_it(spark):
    from sparkloom.operators.capture import mapping_timeline

    order = [(1, 0, 10, 5), (1, 1, 11, 6), (1, 2, 12, 9), (2, 0, 1, None), (2, 1, 2, None)]
    frames = [(1, 10, 1), (1, 11, 1), (1, 12, 1), (2, 1, 7), (2, 2, 8)]
    rigs = [(1, 1, 0), (1, 1, 1), (2, 7, 0), (2, 8, 0)]
    images = [(1, f, c, f * 10 + c, c) for f in (10, 11, 12) for c in (1, 0)] + [(2, 1, 0, 1, 5), (2, 2, 0, 2, 6)]

    def run(o=order, f=frames, r=rigs, i=images):
        tables = ((o, "s int, ordinal int, frame bigint, time bigint"), (f, "s int, frame bigint, rig int"), (r, "s int, rig int, sensor int"), (i, "s int, frame bigint, sensor int, image int, camera int"))
        return sorted(map(tuple, mapping_timeline(*[spark.createDataFrame(*x) for x in tables], "s").collect()))

    assert run() == [(1, 1, 100, 110), (1, 1, 101, 111), (1, 2, 110, 120), (1, 2, 111, 121), (2, 1, 1, 2)]
    for broken, why in (
        ({"o": order[1:]}, "every frame once"),
        ({"o": [*order, (1, 3, 12, 11)]}, "every frame once"),
        ({"f": frames[1:]}, "every frame once"),
        ({"o": [(1, 0, 10, 5), (1, 1, 11, 5), *order[2:]]}, "times must increase"),
        ({"o": [(1, 0, 10, None), *order[1:]]}, "times must increase"),
        ({"i": images[1:]}, "its rig's images"),
        ({"i": [*images, (1, 10, 1, 7, 1)]}, "its rig's images"),
        ({"i": [(1, 10, 1, 101, 9), *images[1:]]}, "same cameras"),
        ({"o": [(2, 0, -1, None), order[4], *order[:3]], "f": [(2, -1, 7), *frames[:3], frames[4]]}, "out of range"),
    ):
        with pytest.raises(Exception, match=why):
            run(**broken)


def test_blobs_masks_and_names_are_checked(spark):
    import struct

    from sparkloom.operators import pairs as pr
    from sparkloom.operators import temporal as tm

    data = struct.pack("<6I", 1, 2, 3, 4294967295, 5, 6)
    blobs = spark.createDataFrame([(3 * 2147483647 + 9, 3, 2, bytearray(data)), (7, 0, 2, bytearray()), (8, 2, 2, bytearray(data)), (10, 3, 3, bytearray(data))], "pair_id bigint, rows int, cols int, data binary")
    ask = lambda *p: spark.createDataFrame(list(p), "first bigint, second bigint")
    got = sorted((r.row, r.feature1, r.feature2) for r in pr.decoded_matches(blobs, ask((9, 3), (3, 9), (0, 7))).collect())
    assert got == [(0, 1, 2), (1, 3, 4294967295), (2, 5, 6)]
    for pair, why in (((0, 99), "no matches"), ((0, 8), "invalid shape"), ((0, 10), "invalid shape")):
        with pytest.raises(Exception, match=why):
            pr.decoded_matches(blobs, ask(pair)).collect()

    matches = spark.createDataFrame([(1, i, 1, i, 2, i) for i in range(4)], "pair_id bigint, row int, img1 int, feat1 int, img2 int, feat2 int")
    points = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (1, 2, 6), (2, 2, 7)], "image int, feature int, point int")
    mask = lambda *rows: spark.createDataFrame([(1, r) for r in rows], "pair_id bigint, row int")
    assert {r.row: r["class"] for r in pr.masked_match_classes(matches, mask(1, 2), points).collect()} == {0: 0, 1: 2, 2: 1, 3: 0}
    for bad in (mask(9), mask(1, 1)):
        with pytest.raises(Exception, match="names no match, or is there twice"):
            pr.masked_match_classes(matches, bad, points).collect()

    def seconds(*names):
        frame = spark.createDataFrame([(1, f"cam/{n}.jpg") for n in names], "s int, name string")
        return [r.seconds for r in tm.elapsed_seconds(frame, "s", "name", r"^(\d+(?:\.\d+)?)(?:-|$)").orderBy("seconds").collect()]

    assert seconds("1700000000000500", "1700000000000000", "1700000000100000-x") == pytest.approx([0.0, 0.0005, 0.1]) and seconds("3", "4") == [0.0, 1.0]
    assert seconds("1.5", "1.25") == [0.0, 0.25] and seconds("1000000000", "1100000000") == [0.0, 0.1]
    for names, why in ((("1.5", "2"), "mix"), (("x", "2"), "no time"), (("2", "02"), "not unique"), (("5",), "unit"), (("1", "4000"), "unit")):
        with pytest.raises(Exception, match=why):
            seconds(*names)
