import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import capture, content
from sparkloom.operators.graph import problem_tracks

MEMBER = "tr int, image int, feature int, loop boolean, depth_ok boolean, ray array<double>"
IMAGE = "image int, frame int, camera int, prior_focal boolean, q array<double>, t array<double>"


def ray(p):
    return (np.array(p) / np.linalg.norm(p)).tolist()


def test_two_view_tracks_with_and_without_parallax(spark):
    one, half = [0.0, 0.0, 0.0, 1.0], [0.0, math.sin(0.1), 0.0, math.cos(0.1)]
    turn = np.array([[math.cos(0.2), 0, math.sin(0.2)], [0, 1, 0], [-math.sin(0.2), 0, math.cos(0.2)]])
    images = [(1, 1, 1, True, one, [0.0, 0.0, 0.0]), (2, 1, 2, True, half, [-0.5, 0.0, 0.1]), (3, 2, 1, True, one, [0.0, 0.0, 0.0]), (4, 1, 3, False, one, [0.3, 0.0, 0.0]), (5, 1, 4, True, one, [0.0, 0.0, 0.0])]
    seen = lambda p: (ray(p), ray(turn @ p + [-0.5, 0, 0.1]))
    near, behind = seen(np.array([0.2, 0.1, 3.0])), seen(np.array([0.2, 0.1, -3.0]))
    far = seen(np.array([0.0, 0.0, 1e9]))
    up = ray([0.1, 0, 1])
    tracks = {
        1: ([(1, 0, near[0]), (2, 0, near[1])], True),
        2: ([(1, 1, behind[0]), (2, 1, behind[1])], True),  # ahead along the rays, which point back
        3: ([(1, 2, near[0]), (2, 2, behind[1])], False),
        4: ([(1, 3, far[0]), (2, 3, far[1])], False),  # parallel
        5: ([(1, 4, up), (3, 4, ray([0.0, 0, 1]))], False),  # two frames
        6: ([(1, 5, up), (4, 5, near[1])], False),  # no prior focal length
        7: ([(1, 6, up), (5, 6, ray([0.0, 0, 1]))], False),  # both at one place
        8: ([(1, 7, near[0]), (2, 7, None)], False),
        9: ([(1, 8, near[0]), (2, 8, near[1]), (2, 9, near[1])], False),  # two features in an image
        10: ([(1, 10, near[0]), (2, 10, near[1]), (3, 10, None)], True),  # three images need nothing
        11: ([(1, 11, near[0]), (9, 11, near[1])], False),  # one registered observation is too few
        12: ([(1, 12, near[0]), (2, 12, near[1]), (9, 12, None), (9, 13, None)], True),
    }
    rows = [(k, i, f, False, False, r) for k, (own, _) in tracks.items() for i, f, r in own]
    rows += [(20, 1, 1, False, True, None), (20, 2, 1, False, True, None), (21, 1, 1, False, True, None), (21, 2, 1, False, None, None)]
    rows += [(22, 1, 1, False, True, None), (22, 1, 2, False, True, None), (22, 2, 1, True, False, near[1])]  # its loop closure has no depth
    rows += [(23, 1, 1, False, False, near[0]), (23, 1, 2, False, False, near[0]), (23, 2, 1, True, False, None), (23, 3, 1, True, False, None)]
    rows += [(24, i % 3 + 1, i, False, True, None) for i in range(9)]
    frame, known = spark.createDataFrame(rows, MEMBER), spark.createDataFrame(images, IMAGE)
    want = {k for k, (_, ok) in tracks.items() if ok} | {20, 23}
    got = problem_tracks(frame, known, "tr", 2, 8).collect()
    assert {r.tr for r in got} == want and {(r.n, r.n_registered) for r in got if r.tr == 12} == {(4, 2)}
    assert {r.tr for r in problem_tracks(frame, known, "tr", 2, 8, depth_gate=False).collect()} == {*range(1, 11), 12, 20, 21, 22, 23}


CAMERA = "camera int, fx double, fy double, cx double, cy double, width int, height int"


def test_quarter_turns_and_official_poses(spark):
    raw = (500.0, 510.0, 300.0, 250.0, 640, 480)
    forms = {0: raw, 1: (510.0, 500.0, 480 - 250.0, 300.0, 480, 640), 2: (500.0, 510.0, 340.0, 230.0, 640, 480), 3: (510.0, 500.0, 250.0, 640 - 300.0, 480, 640)}
    cameras = spark.createDataFrame([(1, *raw)], CAMERA)
    poses = {f"n{k}": ([0.1 * k, 0.2, -0.3, 0.9], [1.0, 2.0, 3.0 + k]) for k in range(5)}
    records = spark.createDataFrame([(n, 1, q, t, "x") for n, (q, t) in poses.items()], "name string, camera int, q array<double>, t array<double>, fx string")
    at = lambda rows: spark.createDataFrame([(n, *f) for n, f in rows], "name string, " + CAMERA.split(", ", 1)[1])
    images = at([(f"n{k}", (*f[:2], f[2] + 0.9, *f[3:])) for k, f in forms.items()] + [("other", raw)])
    pinned = content.table_summary(records.select("name", "q", "t"), ["name"], places=15).first()["sha256"]
    got = {r.name: r for r in capture.official_poses(records.drop("fx"), cameras, images, pinned).collect()}
    assert {n: r.turns for n, r in got.items()} == {f"n{k}": k for k in range(4)}
    for n, r in got.items():
        q, t = poses[n]
        q = np.array(q) / np.linalg.norm(q)
        a = r.turns * math.pi / 2
        s, c = math.sin(a / 2), math.cos(a / 2)
        want = [c * q[0] - s * q[1], c * q[1] + s * q[0], c * q[2] + s * q[3], c * q[3] - s * q[2]]
        assert np.allclose(r.q, want) and np.allclose(r.t, [math.cos(a) * t[0] - math.sin(a) * t[1], math.sin(a) * t[0] + math.cos(a) * t[1], t[2]])
    square = (500.0, 500.0, 320.0, 320.0, 640, 640)  # looks the same however it is turned
    for rows, cams in (([("n0", (*raw[:2], 303.0, *raw[3:]))], cameras), ([("n0", square)], spark.createDataFrame([(1, *square)], CAMERA))):
        with pytest.raises(Exception, match="not exactly one quarter turn fits"):
            capture.official_poses(records.drop("fx"), cams, at(rows)).collect()
    with pytest.raises(ValueError, match="differ from the pinned"):
        capture.official_poses(records.drop("fx").withColumn("t", F.transform("t", lambda x: x + 1e-9)), cameras, images, pinned)
    with pytest.raises(ValueError, match="several poses"):
        capture.official_poses(records.unionByName(records).drop("fx"), cameras, images)
