import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import capture as cp
from sparkloom.operators import pairs as pr
from sparkloom.plans import catalog


@pytest.mark.parametrize("name", ["j10_candidate_pairs", "j19_fixed_poses"])
def test_pairs_are_made_in_tiles_and_not_shuffled(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    above = plan[: next(i for i, line in enumerate(plan) if "Join" in line) + 1]
    assert "SortMergeJoin [block" in above[-1] and not any("Exchange" in line or "Aggregate" in line for line in above)


def test_candidate_pairs_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(pr, "TILE", 3)
    rng = random.Random(4)
    rows = [(i, rng.randrange(9), rng.choice("abbb")) for i in range(40) for _ in range(rng.choice([1, 1, 3]))] + [(50, None, "b"), (51, 1, None), (None, 1, "b")]
    gone = [(rng.randrange(40), rng.randrange(40)) for _ in range(300)]
    out = {(min(p), max(p)) for p in gone}
    want = sorted({(i, k) for i, f, x in rows for k, g, y in rows if None not in (i, k, f, g, x, y) and x == y and i < k and f != g} - out)
    images = spark.createDataFrame(rows, "image int, frame int, block string")
    got = pr.candidate_pairs(images, "image", "frame", spark.createDataFrame(gone, "first int, second int"), "block")
    assert sorted(map(tuple, got.collect())) == want


def test_poses_of_frames_equal_those_of_listed_pairs(spark, monkeypatch):
    monkeypatch.setattr(pr, "TILE", 3)
    rng = random.Random(5)
    cameras = [(0, c, True, c == 0, *([None, None] if c == 0 else [[0.6, 0.0, 0.0, 0.8], [rng.random(), 2.0, 3.0]])) for c in range(8)]
    sensors = spark.createDataFrame(cameras, "rig int, camera int, has_prior boolean, is_ref boolean, q array<double>, t array<double>")
    images = spark.createDataFrame([(10 * f + c, f, 0, c) for f in range(5) for c in range(8 - f)] + [(900, None, 0, 1)], "image int, frame int, rig int, camera int")
    a, b = images.selectExpr("image first", "frame f"), images.selectExpr("image second", "frame g")
    want = cp.fixed_stereo_poses(a.join(b, F.expr("f = g and first < second")), images, sensors)
    got = cp.fixed_frame_poses(images, sensors)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() == 28 + 21 + 15 + 10 + 6
    for bad in (images.withColumn("camera", F.lit(1)), images.withColumn("camera", F.col("camera") + 1), images.withColumn("rig", F.when(F.col("image") == 3, 1).otherwise(0))):
        with pytest.raises(Exception, match="no fixed sensor poses"):
            cp.fixed_frame_poses(bad, sensors).collect()
