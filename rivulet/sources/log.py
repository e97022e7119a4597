"""The event log as a DataFrame: canonical rows, scans, seeks, append, retention."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.operators.ranges import numbered, running
from rivulet.session import ship

SCHEMA = (
    "topic string, partition int, offset long, timestamp_ms long, key binary, value binary, "
    "headers array<struct<key: string, value: binary>>, producer_id long, producer_epoch short, sequence int, "
    "is_transactional boolean, is_control boolean, arrival_seq long"
)
_TOPIC = re.compile(r"[A-Za-z0-9._-]{1,249}")


def valid_topic(name: str) -> bool:
    return bool(_TOPIC.fullmatch(name)) and name not in (".", "..")


def valid_topic_column(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9._-]{1,249}$") & ~name.isin(".", "..")


def events(spark: SparkSession, sf_dir: str, partitions: int = 4) -> DataFrame:
    """The ``events`` table as topic ``events``: partition user_id mod 4, dense offsets in
    order of event_id, the event as JSON in ``value``."""
    e = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    body = F.concat(
        F.lit('{"user":"'), F.col("user_id").cast("string"), F.lit('","type":"'), F.col("event_type"),
        F.lit('","amt":'), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(',"props":'), F.col("props"), F.lit("}"),
    )
    e = numbered(e.withColumn("partition", F.pmod("user_id", F.lit(partitions)).cast("int")), ["partition"], ["event_id"], "number")
    return e.select(
        F.lit("events").alias("topic"),
        "partition",
        (F.col("number") - 1).alias("offset"),
        F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("timestamp_ms"),
        F.col("user_id").cast("string").cast("binary").alias("key"),
        body.cast("binary").alias("value"),
        F.array(F.struct(F.lit("type").alias("key"), F.col("event_type").cast("binary").alias("value"))).alias("headers"),
        (F.col("user_id") % 8).cast("long").alias("producer_id"),
        F.lit(0).cast("short").alias("producer_epoch"),
        F.lit(None).cast("int").alias("sequence"),
        F.lit(True).alias("is_transactional"),
        F.lit(False).alias("is_control"),
        F.col("event_id").alias("arrival_seq"),
    )


def append(log: DataFrame | None, batch: DataFrame, order: str = "arrival_seq") -> DataFrame:
    """``batch`` with the next offsets of its (topic, partition). A row with a ``record_count`` column takes
    so many offsets (one at least), of which it holds the first."""
    count = F.greatest(F.coalesce("record_count", F.lit(1)), F.lit(1)).cast("long") if "record_count" in batch.columns else F.lit(1).cast("long")
    rows = running(batch.drop("offset"), ["topic", "partition"], [order], count, "__end").withColumn("__at", F.col("__end") - count).drop("__end")
    if log is None:
        return rows.withColumnRenamed("__at", "offset")
    ends = log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("__next"))
    return rows.join(ends, ["topic", "partition"], "left").withColumn("offset", F.coalesce("__next", F.lit(0)) + F.col("__at")).drop("__at", "__next")


def write(log: DataFrame, path: str, compression: str = "zstd") -> None:
    """Stored by topic and partition, sorted by offset, so that seeks prune files and row groups."""
    (
        log.repartitionByRange("topic", "partition", "offset")
        .sortWithinPartitions("topic", "partition", "offset")
        .write.mode("append").option("compression", compression).partitionBy("topic", "partition").parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def with_archive(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Hot log and archived segments; an offset in both is read from the hot log.

    Archived rows count only below the first hot offset of their partition, so no
    de-duplicating shuffle of the rows is needed.
    """
    first = hot.groupBy("topic", "partition").agg(F.min("offset").alias("__first"))
    old = cold.join(F.broadcast(first), ["topic", "partition"], "left").where("__first IS NULL OR offset < __first").drop("__first")
    return hot.unionByName(old)


def read_one(log: DataFrame, topic: str, partition: int, offset: int, below: int | None = None) -> DataFrame:
    """First entry at or after ``offset`` (under the high watermark if given)."""
    rows = log.where((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") >= offset))
    if below is not None:
        rows = rows.where(F.col("offset") < below)
    return rows.orderBy("offset").limit(1)


def read_range(log: DataFrame, start: int, end: int | None, max_bytes: int, segment_bytes: int | None = None) -> DataFrame:
    """Per partition, contiguous entries of [start, end) of at most ``max_bytes`` in all, one at
    least; with ``segment_bytes`` only those of the first one's segment."""
    rows = log if segment_bytes is None else with_segments(log, segment_bytes)
    rows = rows.where(F.col("offset") >= start)
    if end is not None:
        rows = rows.where(F.col("offset") < end)
    p = ["topic", "partition"]
    first = rows.groupBy(*p).agg(F.min("offset").alias("__first"), *([F.min("segment_id").alias("__seg")] if segment_bytes is not None else []))
    rows = running(rows, p, ["offset"], entry_bytes(), "__bytes").join(first, p)
    if segment_bytes is not None:
        rows = rows.where("segment_id = __seg").drop("__seg", "segment_id")
    return rows.where((F.col("__bytes") <= max_bytes) | (F.col("offset") == F.col("__first"))).drop("__bytes", "__first")


def read_to_mark(log: DataFrame, start: int, marks: DataFrame, max_bytes: int) -> DataFrame:
    """As :func:`read_range` from ``start`` on, below each partition's own mark (topic, partition, high_watermark)."""
    m = marks.select("topic", "partition", F.col("high_watermark").alias("__mark"))
    return read_range(log.join(m, ["topic", "partition"]).where("offset < __mark").drop("__mark"), start, None, max_bytes)


def replica_fetch(log: DataFrame, followers: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(entries, positions) for followers (topic, partition, broker_id, fetch_offset): each reads on from its own
    offset, whatever the high watermark; the offset it asks for is what it holds, the positions
    (topic, partition, broker_id, end_offset) that :func:`rivulet.operators.logops.high_watermark` takes."""
    f = followers.select("topic", "partition", "broker_id", "fetch_offset")
    rows = log.join(f, ["topic", "partition"]).where("offset >= fetch_offset")
    rows = running(rows, ["topic", "partition", "broker_id"], ["offset"], entry_bytes(), "__bytes")
    rows = rows.where((F.col("__bytes") <= max_bytes) | (F.col("offset") == F.col("fetch_offset"))).drop("__bytes", "fetch_offset")
    return rows, f.withColumnRenamed("fetch_offset", "end_offset")


def range_entries(log: DataFrame, start: int, end: int | None, max_bytes: int) -> DataFrame:
    return read_range(log, start, end, max_bytes).select("topic", "partition", "offset", entry_bytes().alias("length"))


def fetch(log: DataFrame, positions: DataFrame, max_bytes: int) -> DataFrame:
    """Entries from each partition's position (topic, partition, fetch_offset, [limit_offset]) under one
    byte budget over partitions in order; the first partition with data always gives one entry."""
    rows = log.join(F.broadcast(positions), ["topic", "partition"]).where("offset >= fetch_offset")
    if "limit_offset" in positions.columns:
        rows = rows.where("offset < limit_offset")
    size = entry_bytes()
    rows = running(rows, ["topic", "partition"], ["offset"], size, "__run").where((F.col("__run") <= max_bytes) | (F.col("__run") == size))
    whole = Window.orderBy("topic", "partition", "offset").rowsBetween(Window.unboundedPreceding, 0)  # at most max_bytes a partition is left
    rows = rows.withColumn("__all", F.sum(size).over(whole)).withColumn("__rn", F.row_number().over(Window.orderBy("topic", "partition", "offset")))
    return rows.where((F.col("__all") <= max_bytes) | (F.col("__rn") == 1)).select(*log.columns)


def earliest_latest(log: DataFrame) -> DataFrame:
    return log.groupBy("topic", "partition").agg(F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("latest"))


def ingest(log: DataFrame | None, spark: SparkSession, topic: str, key: str | None, value: str, timestamp_ms: int) -> DataFrame:
    """One record handed in from outside, as a row of the log; it has no partition of its own (-1) and arrives
    after all there is. ``log`` with it, or it alone."""
    last = log.agg(F.max("arrival_seq")).first()[0] if log is not None else None
    row = spark.createDataFrame([(topic, -1, None, timestamp_ms, key.encode() if key is not None else None, value.encode(), [], -1, -1, -1, False, False, (last if last is not None else -1) + 1)], SCHEMA)
    return row if log is None else log.unionByName(row)


def latest_committed(log: DataFrame, marks: DataFrame) -> DataFrame:
    """As :func:`earliest_latest` for readers of committed data: latest is the last stable offset of
    ``marks`` (topic, partition, lso)."""
    ends = earliest_latest(log).join(marks.select("topic", "partition", "lso"), ["topic", "partition"], "left")
    return ends.select("topic", "partition", "earliest", F.least("latest", "lso").alias("latest"))


def offset_for_time(log: DataFrame, ts_ms: int) -> DataFrame:
    """Smallest offset whose timestamp is at least ``ts_ms``, in every partition; (-1, -1) where none."""
    hit = F.col("timestamp_ms") >= ts_ms
    return log.groupBy("topic", "partition").agg(
        F.coalesce(F.min(F.when(hit, F.col("offset"))), F.lit(-1)).alias("offset"),
        F.coalesce(F.min_by(F.when(hit, F.col("timestamp_ms")), F.when(hit, F.col("offset"))), F.lit(-1)).alias("timestamp_ms"),
    )


def inspect(log: DataFrame, topic: str, partition: int, offset: int = 0, limit: int = 50) -> DataFrame:
    """Readable messages; a limit over 200 or under 1 becomes 50."""
    limit = limit if 0 < limit <= 200 else 50
    rows = log.where((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") >= offset)).orderBy("offset").limit(limit)
    headers = F.transform("headers", lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value")))
    return rows.select("offset", "timestamp_ms", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), headers.alias("headers"))


def entry_bytes() -> Column:
    return (F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")


#: Offsets that share a row of :func:`segment_starts`.
BLOCK = 4096


def segment_starts(log: DataFrame, segment_bytes: int) -> DataFrame:
    """(topic, partition, block, segment, starts): for each block of ``BLOCK`` offsets the segment at its
    start and the offsets in it where a new one begins.

    A segment rolls before an entry that would make it larger than ``segment_bytes``, unless it is empty: what
    fits depends on every entry before, so this is a fold over offsets and sizes alone (20 bytes
    each), streamed, one partition of the log after another in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, segment, held, block, base, starts = None, 0, 0, None, 0, []
        done: list[tuple] = []
        for batch in batches:
            topics, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            offsets, sizes = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            cuts = [i for i in range(len(topics)) if i == 0 or (topics[i], parts[i]) != (topics[i - 1], parts[i - 1])]
            for lo, hi in zip(cuts, [*cuts[1:], len(topics)], strict=True):
                if (topics[lo], parts[lo]) != who:
                    if who:
                        done.append((*who, block, base, starts))
                    who, segment, held, block, base, starts = (topics[lo], parts[lo]), 0, 0, int(offsets[lo]) // BLOCK, 0, []
                rolled, at, upto = set(), lo, np.cumsum(sizes[lo:hi])
                while at < hi:
                    before = upto[at - lo - 1] if at > lo else 0
                    end = lo + int(np.searchsorted(upto, before + segment_bytes - held, side="right"))
                    if end <= at:  # the entry does not fit
                        if held:
                            rolled.add(at)
                            held = 0
                            continue
                        end = at + 1
                    held += int(upto[end - lo - 1] - before)
                    at = end
                for at in sorted({*rolled, *(lo + np.flatnonzero(np.diff(offsets[lo:hi] // BLOCK, prepend=block))).tolist()}):
                    if offsets[at] // BLOCK != block:
                        done.append((*who, block, base, starts))
                        block, base, starts = int(offsets[at]) // BLOCK, segment, []
                    if at in rolled:
                        segment += 1
                        starts.append(int(offsets[at]))
            if len(done) > 10_000:
                yield made(done)
                done = []
        if who:
            done.append((*who, block, base, starts))
        if done:
            yield made(done)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["topic", "partition", "block", "segment", "starts"])

    ship(log.sparkSession)
    narrow = log.select("topic", "partition", "offset", entry_bytes().alias("size")).repartition("topic", "partition").sortWithinPartitions("topic", "partition", "offset")
    return narrow.mapInArrow(run, "topic string, partition int, block long, segment long, starts array<long>")


def with_segments(log: DataFrame, segment_bytes: int) -> DataFrame:
    """Adds segment_id (see :func:`segment_starts`). The rows join their block's row and stay where they are
    where those are few enough to broadcast."""
    starts = segment_starts(log, segment_bytes).select("topic", "partition", F.col("block").alias("__block"), "segment", "starts")
    rows = log.withColumn("__block", F.floor(F.col("offset") / BLOCK)).join(starts, ["topic", "partition", "__block"])
    inside = F.size(F.filter("starts", lambda x: x <= F.col("offset")))
    return rows.withColumn("segment_id", F.col("segment") + inside).select(*log.columns, "segment_id")


def offload(segmented: DataFrame, archive: str, compression: str = "zstd") -> DataFrame:
    """Copies every sealed segment (all but a partition's last) to the folder ``archive``, of any file system
    that Spark reaches, and returns (topic, partition, segment_id, entries). Segments that are
    there already are not copied again, so a run that was cut short is repeated safely."""
    spark = segmented.sparkSession
    last = segmented.groupBy("topic", "partition").agg(F.max("segment_id").alias("__last"))
    sealed = segmented.join(last, ["topic", "partition"]).where("segment_id < __last").drop("__last")
    path = spark._jvm.org.apache.hadoop.fs.Path(archive)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        there = spark.read.schema(segmented.schema).parquet(archive).select("topic", "partition", "segment_id").distinct()
        sealed = sealed.join(there, ["topic", "partition", "segment_id"], "left_anti")
    sealed.repartition("topic", "partition", "segment_id").sortWithinPartitions("offset").write.mode("append").option("compression", compression).partitionBy("topic", "partition", "segment_id").parquet(archive)
    return spark.read.schema(segmented.schema).parquet(archive).groupBy("topic", "partition", "segment_id").agg(F.count("*").alias("entries"))


def retain(segmented: DataFrame, max_bytes: int | None, max_age_ms: int | None, now_ms: int) -> DataFrame:
    """Whole oldest segments go while the partition is too large or the segment too old; the
    last segment stays. Decided on one row a segment."""
    seg = segmented.groupBy("topic", "partition", "segment_id").agg(F.sum(entry_bytes()).alias("bytes"), F.max("timestamp_ms").alias("newest"))
    w = Window.partitionBy("topic", "partition").orderBy(F.desc("segment_id"))
    seg = seg.withColumn("after", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(w))
    keep = F.lit(True)
    if max_bytes is not None:
        keep = keep & (F.col("after") <= max_bytes)
    if max_age_ms is not None:
        fresh = F.max(F.when(F.lit(now_ms) - F.col("newest") <= max_age_ms, 1).otherwise(0))
        # oldest first: a segment is reached only if all before it have gone
        old = Window.partitionBy("topic", "partition").orderBy("segment_id").rowsBetween(Window.unboundedPreceding, 0)
        keep = keep & (fresh.over(old) == 1)
    return segmented.join(seg.where(keep | (F.col("rn") == 1)).select("topic", "partition", "segment_id"), ["topic", "partition", "segment_id"], "left_semi")
