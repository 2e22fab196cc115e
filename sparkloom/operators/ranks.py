"""Ranks and running sums over a whole table, without a window that takes all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.names import free_prefix
from sparkloom.session import stored


def ranked(rows: DataFrame, order: list[Column | str], name: str = "rank", total: str | None = None, value: Column | str | None = None) -> DataFrame:
    """``rows`` with ``name``, their number from 1 on in the order, which must be unique; with ``total``, also the running sum
    of ``value`` up to and with the row.

    Rows are dealt out by ranges of the order and kept in the shared folder; each part counts for itself, and the parts'
    counts, one row each, are added up and sent to all.
    """
    p = free_prefix(rows)
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    named = rows.select("*", *[k.alias(f"{p}k{i}") for i, k in enumerate(keys)], (F.lit(0) if value is None else F.col(value) if isinstance(value, str) else value).alias(f"{p}v"))
    names = [f"{p}k{i}" for i in range(len(keys))]
    parts = stored(named.repartitionByRange(*names).withColumn(f"{p}part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy(f"{p}part").agg(F.count("*").alias(f"{p}n"), F.sum(f"{p}v").alias(f"{p}s"))
    before = Window.orderBy(f"{p}part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per part
    start = sizes.select(f"{p}part", F.coalesce(F.sum(f"{p}n").over(before), F.lit(0)).alias(f"{p}from"), F.coalesce(F.sum(f"{p}s").over(before), F.lit(0)).alias(f"{p}upto"))
    own = Window.partitionBy(f"{p}part").orderBy(*names)
    found = parts.join(F.broadcast(start), f"{p}part").withColumn(name, (F.row_number().over(own) + F.col(f"{p}from")).cast("bigint"))
    if total is not None:
        found = found.withColumn(total, F.sum(f"{p}v").over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"{p}upto"))
    return found.select(*rows.columns, name, *([total] if total is not None else []))
