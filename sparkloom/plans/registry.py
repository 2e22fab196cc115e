"""Registration of queries over the given tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The Parquet tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of :class:`Tables` under ``name``."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return add


def digest_sql(text: str) -> str:
    """SQL of :func:`sparkloom.functions.scalars.set_digest`."""
    part = lambda at: f"sum(('0x' || substr(md5({text}), {at}, 8))::BIGINT)::BIGINT"
    return f"sha256(count(*) || ':' || {part(1)} || ':' || {part(9)})"
