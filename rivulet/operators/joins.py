"""Joins of a stream with a table kept as the latest row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions import jsonpath as J
from rivulet.operators.ranges import WIDTH


def is_tombstone(value: Column) -> Column:
    """Empty, null or the JSON text ``null``."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return (text == "") | (text == "null")


def changes(table_log: DataFrame, key_field: str | None = None) -> DataFrame:
    """(key, arrival_seq, value, deleted): the key from its field, else the record; without one, skipped."""
    record = F.coalesce(F.col("key").cast("string"), F.lit(""))
    named = J.to_key(J.get(J.parse(F.col("value")), key_field)) if key_field else F.lit("")
    key = F.when(named != "", named).otherwise(record)
    return table_log.select(key.alias("key"), "arrival_seq", F.col("value").cast("string").alias("value"), is_tombstone(F.col("value")).alias("deleted")).where("key <> ''")


def snapshot(table_log: DataFrame, key_field: str | None = None) -> DataFrame:
    """(key, value): the latest row per key that is not deleted. ``max_by`` combines map-side,
    so a key with very many updates is not gathered."""
    last = changes(table_log, key_field).groupBy("key").agg(F.max_by(F.struct("value", "deleted"), "arrival_seq").alias("r"))
    return last.where(~F.col("r.deleted")).select("key", F.col("r.value").alias("value"))


def as_json(value: Column) -> Column:
    """JSON text as it is; anything else as a JSON string; null for null."""
    text = value.cast("string")
    quoted = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2)))


def join_latest(stream: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """(arrival_seq, key, stream, table) against a snapshot; left keeps unmatched rows with a null table."""
    t = table.select("key", F.col("value").alias("table"))
    return stream.select("arrival_seq", "key", F.col("value").cast("string").alias("stream")).join(t, "key", how).select("arrival_seq", "key", "stream", "table")


def join_as_of(stream: DataFrame, table_changes: DataFrame, how: str = "inner", width: int = WIDTH) -> DataFrame:
    """As :func:`join_latest`, each row against the table as it was when the row arrived.

    Both sides in one run in order of arrival, the last change before a row carried forward. A table change
    that arrives together with a row comes first. In two levels, so that no key meets in one task: inside ranges of arrival,
    and over the last changes of the ranges, which a row takes where its own range has none before it.
    """
    t = table_changes.select("key", "arrival_seq", F.lit(0).alias("side"), F.struct("value", "deleted").alias("row"), F.lit(None).cast("string").alias("stream"))
    s = stream.select("key", "arrival_seq", F.lit(1).alias("side"), F.lit(None).cast("struct<value:string,deleted:boolean>").alias("row"), F.col("value").cast("string").alias("stream"))
    both = t.unionByName(s).withColumn("range", F.floor(F.col("arrival_seq") / width))
    ends = t.groupBy("key", F.floor(F.col("arrival_seq") / width).alias("range")).agg(F.max_by("row", "arrival_seq").alias("row"))
    seen = ends.unionByName(s.select("key", F.floor(F.col("arrival_seq") / width).alias("range")).distinct(), allowMissingColumns=True)
    seen = seen.groupBy("key", "range").agg(F.first("row", ignorenulls=True).alias("row"))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.select("key", "range", F.last("row", ignorenulls=True).over(before).alias("before"))
    w = Window.partitionBy("key", "range").orderBy("arrival_seq", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("last", F.last("row", ignorenulls=True).over(w)).where("side = 1").join(carried, ["key", "range"])
    both = both.withColumn("last", F.coalesce("last", "before"))
    out = both.select("arrival_seq", "key", "stream", F.when(~F.col("last.deleted"), F.col("last.value")).alias("table"))
    return out if how == "left" else out.where("table IS NOT NULL")


def unmatched(stream: DataFrame, table: DataFrame) -> DataFrame:
    return stream.join(table.select("key"), "key", "left_anti")


def lag(offsets: DataFrame, ends: DataFrame) -> DataFrame:
    """Consumer lag: committed offsets against high watermarks; a missing partition has watermark 0."""
    hw = F.coalesce("high_watermark", F.lit(0))
    return offsets.join(ends, ["topic", "partition"], "left").select(
        "group_id", "topic", "partition", "committed_offset", hw.alias("high_watermark"), F.greatest(hw - F.col("committed_offset"), F.lit(0)).alias("lag")
    )


def leaders(partitions: DataFrame, brokers: DataFrame) -> DataFrame:
    """Address of each partition's leader; null for a broker that is not known."""
    return partitions.join(brokers.select(F.col("broker_id").alias("leader"), "address"), "leader", "left")
