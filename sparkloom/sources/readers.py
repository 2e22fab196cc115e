"""Typed sources: every reader has a fixed schema and checks what it reads; nothing is inferred."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.pairs import require
from sparkloom.operators.ranks import ranked

FRAME_SCHEMA = "frame_id bigint, timestamp_ns bigint, camera_id bigint, image_name string"
POSE_SCHEMA = ("ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw")
BAD_CONFIGS = ("UNDEFINED", "DEGENERATE", "WATERMARK", "MULTIPLE")


def frame_violations(frames: DataFrame) -> DataFrame:
    """``(problem)`` rows: names or (frame, camera) that repeat, frames with several times, times that do not rise with the frame's first row."""
    name = frames.groupBy("image_name").count().where("count > 1").select(F.lit("image name repeats").alias("problem"))
    camera = frames.groupBy("frame_id", "camera_id").count().where("count > 1").select(F.lit("frame and camera repeat").alias("problem"))
    times = frames.groupBy("frame_id").agg(F.count_distinct("timestamp_ns").alias("n"), F.min("timestamp_ns").alias("t"))
    several = times.where("n > 1").select(F.lit("frame has several times").alias("problem"))
    order = ranked(times, ["frame_id"], "r").select("t", "r")
    after = order.select((F.col("r") - 1).alias("r"), F.col("t").alias("b"))
    falling = order.join(after, "r").where("t >= b").select(F.lit("times do not rise").alias("problem"))
    return name.unionByName(camera).unionByName(several).unionByName(falling)


def read_frame_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with exactly the columns of the frame table; it fails on others, on bad numbers and on violations."""
    frames = spark.read.schema(FRAME_SCHEMA).csv(path, header=True, enforceSchema=False, mode="FAILFAST")
    return require(frames, frame_violations(frames), "the frame table is not sound")


def _fields(spark: SparkSession, path: str, cut: str) -> DataFrame:
    """Lines without comments and blanks, as arrays of trimmed fields."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    return lines.select(F.transform(F.split("line", cut), lambda x: F.trim(x)).alias("f"))


def read_poses(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """Lines of time, position and quaternion (x, y, z, w): times rise strictly and exactly (DECIMAL), quaternions have
    unit length within 1e-3, and there are ``least`` rows or more; else it fails."""
    f = _fields(spark, path, r"\s+")
    rows = f.select(F.col("f")[0].cast("decimal(28,9)").alias("ts"), *[F.col("f")[i].cast("double").alias(c) for i, c in enumerate(POSE_SCHEMA) if i], F.size("f").alias("_n"))
    norm = F.sqrt(sum((F.col(c) ** 2 for c in ("qy", "qz", "qw")), F.col("qx") ** 2))
    bad = rows.where((F.col("_n") != 8) | (F.abs(norm - 1) > 1e-3)).select(F.lit("bad row").alias("problem"))
    twice = rows.groupBy("ts").count().where("count > 1").select(F.lit("time repeats").alias("problem"))
    few = rows.agg(F.count("*").alias("n")).where(F.col("n") < least).select(F.lit("too few rows").alias("problem"))
    return require(rows.drop("_n"), bad.unionByName(twice).unionByName(few), "the poses are not sound")


def read_sensors(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated sensors; only cameras stay: ``(sensor_id, model, width, height, params)``."""
    f = _fields(spark, path, ",")
    return f.where("f[2] = 'camera'").select(F.col("f")[0].alias("sensor_id"), F.col("f")[3].alias("model"), F.col("f")[4].cast("int").alias("width"), F.col("f")[5].cast("int").alias("height"), F.transform(F.slice("f", 7, 99), lambda x: x.cast("double")).alias("params"))


def read_trajectories(spark: SparkSession, path: str, aligned_path: str | None = None) -> DataFrame:
    """Comma-separated ``(ts, device, qw, qx, qy, qz, tx, ty, tz)``; an aligned file, if it has rows, stands for the whole table."""
    def one(p: str) -> DataFrame:
        f = _fields(spark, p, ",")
        return f.select(F.col("f")[0].cast("bigint").alias("ts"), F.col("f")[1].alias("device"), *[F.col("f")[i].cast("double").alias(c) for i, c in enumerate(("qw", "qx", "qy", "qz", "tx", "ty", "tz"), 2)])

    rows = one(path)
    if aligned_path is not None and not (aligned := one(aligned_path)).isEmpty():
        rows = aligned
    return require(rows, rows.groupBy("ts", "device").count().where("count > 1"), "a time repeats")


def read_numeric(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """White-space separated rows of ``columns`` numbers, as an array."""
    f = _fields(spark, path, r"\s+")
    return require(f.select(F.transform("f", lambda x: x.cast("double")).alias("v")), f.where(F.size("f") != columns), "a row has another length")


def read_image_list(spark: SparkSession, path: str) -> DataFrame:
    """Names of a list file, and the numbers that may follow them; comments and blanks go."""
    f = _fields(spark, path, r"\s+")
    return f.select(F.col("f")[0].alias("image_name"), F.slice("f", 2, 999).alias("params"))


def read_inventory(spark: SparkSession, path: str, name: str, rows: int | None = None) -> DataFrame:
    """Tab-separated ``(name, size, sha256)`` with checked digests, names and, if given, row count."""
    inv = spark.read.schema("name string, size bigint, sha256 string").csv(path, sep="\t", header=True, mode="FAILFAST")
    bad = inv.where(~F.col("sha256").rlike("^[0-9a-f]{64}$") | ~F.col("name").rlike(name) | (F.col("size") < 0)).select(F.lit("bad row").alias("problem"))
    if rows is not None:
        bad = bad.unionByName(inv.agg(F.count("*").alias("n")).where(F.col("n") != rows).select(F.lit("row count").alias("problem")))
    return require(inv, bad, "the inventory is not sound")


def list_images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """``(path, length)`` of the image files below a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table of SQLite files, a task per file; file bytes come through Spark's reader, so any store will do."""
    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(schema).fieldNames()
    sql = f'SELECT {", ".join(chr(34) + n + chr(34) for n in names)} FROM "{table}"'

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                yield pd.DataFrame(db.execute(sql).fetchall(), columns=names)
                db.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def finalized_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs but for those of unusable configuration; a pair of an image with itself is an error."""
    kept = pairs.where(~F.col("config").isin(*BAD_CONFIGS))
    return require(kept, pairs.where("img1 = img2"), "a pair joins an image to itself")


def tracking_features(features: DataFrame, counts: DataFrame) -> DataFrame:
    """Features before each image's number of tracking keypoints (``image_id, n_tracking``)."""
    return features.join(counts, "image_id").where("feature_id < n_tracking").drop("n_tracking")


def sparse_matches(stored_matches: DataFrame, first: str, second: str) -> DataFrame:
    """``(img1, img2, feat1, feat2, score)`` from rows with arrays ``matches0`` (-1: none) and ``scores0``; ``reversed`` rows are turned."""
    each = stored_matches.select(first, second, "reversed", F.posexplode(F.arrays_zip("matches0", "scores0")).alias("i", "m")).where("m.matches0 >= 0")
    turn = lambda a, b: F.when(F.col("reversed"), b).otherwise(a)
    i, j = F.col("i").cast("bigint"), F.col("m.matches0").cast("bigint")
    return each.select(turn(F.col(first), F.col(second)).alias("img1"), turn(F.col(second), F.col(first)).alias("img2"), turn(i, j).alias("feat1"), turn(j, i).alias("feat2"), F.col("m.scores0").alias("score"))


MASK_SCHEMA = "struct<schemaVersion:int,pairs:array<struct<first:string,second:string,matchCount:int,loopClosureMatchIndices:array<int>>>>"


def encode_masks(masks: DataFrame, first: str, second: str, row: str, loop: Column) -> DataFrame:
    """``(first, second, matchCount, loopClosureMatchIndices)`` of dense masks: sorted numbers of the rows that are loop closures."""
    return masks.groupBy(first, second).agg(F.count("*").cast("int").alias("matchCount"), F.array_sort(F.collect_list(F.when(loop, F.col(row).cast("int")))).alias("loopClosureMatchIndices"))


def decode_masks(sparse: DataFrame, first: str, second: str) -> DataFrame:
    """Dense ``(first, second, row, is_lc)`` from sparse masks; indices must rise strictly below the count, else it fails."""
    idx = F.col("loopClosureMatchIndices")
    sound = (idx == F.array_sort(F.array_distinct(idx))) & (F.coalesce(F.array_max(idx), F.lit(-1)) < F.col("matchCount")) & (F.coalesce(F.array_min(idx), F.lit(0)) >= 0)
    ok = F.when(sound, F.lit(True)).otherwise(F.raise_error(F.lit("mask indices are not sound")).cast("boolean"))
    rows = F.when(F.col("matchCount") > 0, F.sequence(F.lit(0), F.col("matchCount") - 1)).otherwise(F.array().cast("array<int>"))
    return sparse.where(ok).select(first, second, idx.alias("_i"), F.explode(rows).alias("row")).select(first, second, "row", F.array_contains("_i", F.col("row")).alias("is_lc"))


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """Sparse masks of a JSON file with exactly its fields."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", MASK_SCHEMA, {"mode": "FAILFAST"}).alias("d"))
    rows = doc.select(F.explode("d.pairs").alias("p")).select("p.*")
    return require(rows, rows.groupBy(F.least("first", "second"), F.greatest("first", "second")).count().where("count > 1"), "a pair repeats")


def attached_depth(features: DataFrame, sampled: DataFrame) -> DataFrame:
    """Features with depth and validity sampled for them; features without stay, with nulls and not valid."""
    return features.join(sampled, ["image_id", "feature_id"], "left").withColumn("depth_valid", F.coalesce("depth_valid", F.lit(False)))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Long metrics ``(scene, mode, testset, metric, value)`` as tab-separated files, a folder per scene and mode."""
    metrics.write.partitionBy("scene", "mode").csv(path, sep="\t", header=True)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("testset string, metric string, value double, scene string, mode string").csv(path, sep="\t", header=True).select("scene", "mode", "testset", "metric", "value")


def resumed(plan: DataFrame, present: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a run that goes on has to do: rows of the plan that are not there yet, and rows there that the plan no longer has."""
    keys = present.select(*on).distinct()
    return plan.join(keys, on, "left_anti"), present.join(plan.select(*on).distinct(), on, "left_anti")
