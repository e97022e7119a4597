"""Stream jobs as Structured Streaming queries.

Built-in windows drop late rows by the watermark of the previous micro-batch, so they
keep what exact lateness would drop within a batch. :func:`exact_files` is exact and spreads over
keys; :func:`exact_aggregate` is exact too, for sessions as well, at the price of one state group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rivulet.operators import joins
from rivulet.operators.windows import aggregates, changelog, sliding, stream_time
from rivulet.plans.jobs import JobConfig, prepared
from rivulet.session import ship
from rivulet.sources import log as logs


def read_log(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A log directory as a stream, bounded per micro-batch."""
    r = spark.readStream.schema(logs.SCHEMA)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)


def aggregate(stream: DataFrame, job: JobConfig) -> DataFrame:
    """Update-mode result of a tumbling, hopping or session job with watermark ``grace``."""
    job = job.validate()
    rows = prepared(stream, job).where("NOT skipped").withColumn("t", F.timestamp_millis("ts"))
    rows = rows.withWatermark("t", f"{job.grace_ms} milliseconds")
    w = job.window
    if w.type == "session":
        by = F.session_window("t", f"{w.gap_ms} milliseconds")
    elif w.type == "hopping":
        by = F.window("t", f"{w.size_ms} milliseconds", f"{w.advance_ms} milliseconds")
    elif w.type == "tumbling":
        by = F.window("t", f"{w.size_ms} milliseconds")
    else:
        raise ValueError("sliding windows stream through exact_aggregate")
    out = rows.groupBy("key", by.alias("w")).agg(*aggregates())
    end = F.unix_millis("w.end") - (w.gap_ms if w.type == "session" else 0)  # the last event, inclusive
    return out.select("key", F.unix_millis("w.start").alias("window_start"), end.alias("window_end"), "count", "sum", "min", "max", "avg", F.col(job.agg).cast("double").alias("value"))


def output_mode(job: JobConfig) -> str:
    """Session windows merge, so they come out once closed or as a whole; the others update."""
    return "complete" if job.window.type == "session" else "update"


def running_count(stream: DataFrame) -> DataFrame:
    """Unwindowed count per key, updated with every micro-batch."""
    return stream.groupBy(F.col("key").cast("string").alias("key")).count()


def join_static(stream: DataFrame, table: DataFrame, job: JobConfig) -> DataFrame:
    """Stream rows against a snapshot of the table, which every micro-batch reads anew."""
    job = job.validate()
    from rivulet.functions import jsonpath as J

    key = J.key_of(J.parse(F.col("value")), job.key_field, F.col("key").cast("string"))
    rows = stream.select("arrival_seq", key.alias("key"), joins.as_json(F.col("value")).alias("value"))
    return joins.join_latest(rows, joins.snapshot(table, job.table_key_field), job.join_type)


OUT = "arrival_seq long, key string, window_start long, window_end long, count long, sum double, min double, max double, avg double"


class Fold:
    """Record-at-a-time state of a job: stream time, windows, sessions, sliding buffers."""

    def __init__(self, job: dict, state: dict | None = None) -> None:
        self.job, self.s = job, state or {"t": None, "late": 0, "w": {}}

    def add(self, seq: int, key: str, ts: int, x: float) -> Iterator[tuple]:
        s, j, w = self.s, self.job, self.job["window"]
        s["t"] = ts if s["t"] is None else max(s["t"], ts)
        size, grace = w["size_ms"], j["grace_ms"]
        if w["type"] == "sliding":
            if ts + grace < s["t"] - size:
                s["late"] += 1
                return
            buf = s["w"].setdefault(key, [])
            buf.append((ts, x))
            buf[:] = [p for p in buf if p[0] >= s["t"] - size - grace]
            hit = [p[1] for p in buf if ts - size < p[0] <= ts]
            yield self.row(seq, key, ts - size + 1, ts, [len(hit), sum(hit), min(hit), max(hit)])
        elif w["type"] == "session":
            mine = s["w"].setdefault(key, [])
            near = [p for p in mine if p[0] - w["gap_ms"] <= ts <= p[1] + w["gap_ms"]]
            now = [min([ts, *(p[0] for p in near)]), max([ts, *(p[1] for p in near)]), 1 + sum(p[2] for p in near), x + sum(p[3] for p in near), min([x, *(p[4] for p in near)]), max([x, *(p[5] for p in near)])]
            mine[:] = [p for p in mine if p not in near] + [now]
            yield self.row(seq, key, now[0], now[1], now[2:])
        else:
            step = w["advance_ms"] if w["type"] == "hopping" else size
            start, any_open = ts // step * step, False
            while start > ts - size:
                if start + size + grace > s["t"]:
                    any_open = True
                    a = s["w"].setdefault(f"{start}\0{key}", [0, 0.0, x, x])
                    a[:] = [a[0] + 1, a[1] + x, min(a[2], x), max(a[3], x)]
                    yield self.row(seq, key, start, start + size, a)
                start -= step
            s["late"] += not any_open
            if seq % 256 == 0:
                floor = s["t"] - grace - j["retention_ms"]
                s["w"] = {k: a for k, a in s["w"].items() if int(k.split("\0", 1)[0]) + size >= floor}

    @staticmethod
    def row(seq: int, key: str, start: int, end: int, a: list) -> tuple:
        return seq, key, start, end, a[0], a[1], a[2], a[3], a[1] / a[0]


def exact_aggregate(stream: DataFrame, job: JobConfig) -> DataFrame:
    """Every running result, with lateness exact to the record: opt-in, as all keys share one
    state group, which takes the throughput of one task."""
    import pickle

    ship(stream.sparkSession)
    job = job.validate()
    doc = asdict(job)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fold = Fold(doc, pickle.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values("arrival_seq")
        out = [r for seq, k, ts, x in rows[["arrival_seq", "key", "ts", "x"]].itertuples(index=False) for r in fold.add(seq, k, ts, x)]
        state.update((pickle.dumps(fold.s),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    rows = prepared(stream, job).where("NOT skipped").withColumn("one", F.lit(0))
    return rows.groupBy("one").applyInPandasWithState(run, OUT, "state binary", "update", "NoTimeout")


def exact_files(stream: DataFrame, job: JobConfig, path: str, checkpoint: str) -> StreamingQuery:
    """Every running result of a tumbling, hopping or sliding job, with lateness exact to the record, as Parquet below
    ``path/out``: takes all that is there and ends; started again it goes on.

    State is the rows that an open window can still need (event times of the last size and grace), each with the
    stream time of its arrival, as a table of its own for every micro-batch. A micro-batch adds its rows, whose
    stream time goes on from the state's, and runs the batch operators over both, by key and
    window on all executors; what it writes for a number is overwritten if it is repeated.
    """
    job = job.validate()
    w = job.window
    if w.type == "session":
        raise ValueError("sessions are never late: use aggregate()")
    spark = stream.sparkSession
    schema = "arrival_seq long, key string, ts long, x double, stream_t long"

    def state(number: int) -> DataFrame:
        if number < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{path}/state/batch={number}")

    def step(batch: DataFrame, number: int) -> None:
        old = state(number - 1)
        before = old.agg(F.max("stream_t")).first()[0]
        new = stream_time(prepared(batch, job).where("NOT skipped").drop("skipped"))
        if before is not None:
            new = new.withColumn("stream_t", F.greatest("stream_t", F.lit(before)))
        new = new.select(*old.columns)
        rows = old.unionByName(new)
        updates = sliding(rows, w.size_ms, job.grace_ms, every_update=True) if w.type == "sliding" else changelog(rows, w, job.grace_ms)
        updates.join(new.select("arrival_seq"), "arrival_seq", "left_semi").write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        top = rows.agg(F.max("stream_t").alias("__top"))
        live = rows.join(F.broadcast(top)).where(F.col("ts") >= F.col("__top") - (w.size_ms + job.grace_ms)).drop("__top")  # one row
        live.write.mode("overwrite").parquet(f"{path}/state/batch={number}")

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return q.trigger(availableNow=True).start()


def start(result: DataFrame, name: str, checkpoint: str, mode: str = "update", *, once: bool = True) -> StreamingQuery:
    """Runs into a memory table; ``once`` takes all that is there and ends."""
    w = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="500 milliseconds")).start()


def start_files(result: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Takes all that is there into Parquet below ``path`` and ends; started again from the same checkpoint it
    goes on where it ended, with its state, stream time and offsets. A micro-batch has a folder of its own, so one that is
    repeated after a failure is overwritten, not added. State is kept in RocksDB, in bounded memory, unless
    the application names another store."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = result.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    conf = result.sparkSession.conf
    ours = STORE if conf.get(next(iter(STORE)), None) is None else {}
    before = {k: conf.get(k, None) for k in ours}
    try:
        for k, v in ours.items():
            conf.set(k, v)
        return w.trigger(availableNow=True).start()  # takes the settings of this moment
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


#: State store of :func:`start_files`: on disk, with one bound of memory for all stores of an executor.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
}


def read_files(spark: SparkSession, path: str, mode: str = "update") -> DataFrame:
    """What :func:`start_files` wrote, with the number of the micro-batch as ``batch``; in mode complete, whose
    micro-batches each hold the whole result, the last one's."""
    out = spark.read.parquet(path)
    return out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]) if mode == "complete" else out


def recent(results: DataFrame, limit: int = 50) -> DataFrame:
    """The last results, newest last, 200 at most."""
    last = results.orderBy(F.desc("arrival_seq")).limit(min(limit, 200))
    return last.orderBy("arrival_seq")
