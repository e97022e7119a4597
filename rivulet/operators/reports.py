"""Latency percentiles and throughput summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def percentiles(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The value at 0-based place int(n * p) of the sorted values, the last at most.

    Ranks come from counts per distinct value, so equal values are combined before the
    sort and no list of values is built.
    """
    per = rows.groupBy(*by, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by).orderBy(value)
    upto = per.withColumn("upto", F.sum("k").over(w)).join(per.groupBy(*by).agg(F.sum("k").alias("n")), by)
    place = lambda p: F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    return upto.groupBy(*by).agg(*[F.min(F.when(F.col("upto") > place(p), F.col(value))).alias(n) for n, p in POINTS.items()])


def throughput(rounds: DataFrame, by: list[str]) -> DataFrame:
    """rounds: one row a round with messages, bytes and seconds -> median and range of rates (MB: 1048576)."""
    r = rounds.withColumn("rate", F.col("messages") / F.col("seconds")).withColumn("mb", F.col("bytes") / 1048576 / F.col("seconds"))
    return r.groupBy(*by).agg(F.median("rate").alias("rate_median"), F.min("rate").alias("rate_min"), F.max("rate").alias("rate_max"), F.median("mb").alias("mb_median"))


def megabytes(size: Column) -> Column:
    return size / 1048576
