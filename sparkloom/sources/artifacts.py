"""Artifacts: a Parquet dataset with a manifest of what it was made from and what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.scalars import canonical_json, fingerprint, table_hash

MANIFEST = "identity string, config string, rows bigint, digest string"


def _content(df: DataFrame) -> DataFrame:
    """``(rows, digest)`` of a whole table, in any row order; an empty one has a digest too."""
    found = table_hash(df.select(F.lit(1).alias("_one"), *df.columns), ["_one"], df.columns)
    return found.agg(F.coalesce(F.max("rows"), F.lit(0)).cast("bigint").alias("rows"), F.coalesce(F.max("digest"), F.lit("empty")).alias("digest"))


def identity(config: dict, not_semantic: tuple[str, ...] = ()) -> str:
    """Fingerprint of the parts of a configuration that change results."""
    return fingerprint({k: v for k, v in config.items() if k not in not_semantic})


def write_artifact(df: DataFrame, path: str, config: dict, not_semantic: tuple[str, ...] = ()) -> None:
    """Write ``df`` and, only after it is complete, its manifest; without a manifest an artifact does not count as there."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/data")
    kept = spark.read.schema(df.schema).parquet(f"{path}/data")
    row = _content(kept).select(F.lit(identity(config, not_semantic)).alias("identity"), F.lit(canonical_json(config)).alias("config"), "rows", "digest")
    row.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_artifact(spark: SparkSession, path: str, schema: str, expected: dict, not_semantic: tuple[str, ...] = (), verify: bool = True) -> DataFrame:
    """The dataset, if its manifest has the expected identity and, with ``verify``, its content the recorded digest."""
    manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    if manifest is None or manifest.identity != identity(expected, not_semantic):
        raise ValueError(f"{path} was made from another configuration")
    df = spark.read.schema(schema).parquet(f"{path}/data")
    if verify and tuple(_content(df).first()) != (manifest.rows, manifest.digest):
        raise ValueError(f"{path} does not have its recorded content")
    return df


def completed_cases(spark: SparkSession, path: str) -> DataFrame:
    """``(scene, mode, testset)`` of the cases with metrics in a folder of metric files."""
    from sparkloom.sources.readers import read_metrics

    return read_metrics(spark, path).select("scene", "mode", "testset").distinct()
