"""Stream jobs as data: a validated configuration that becomes a batch plan."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions import jsonpath as J
from rivulet.operators import joins, windows
from rivulet.operators.ranges import numbered
from rivulet.operators.windows import WindowSpec

AGGS = ("count", "sum", "min", "max", "avg")


@dataclass(frozen=True)
class JobConfig:
    name: str
    type: str
    source_topic: str
    target_topic: str = ""
    key_field: str = ""
    value_field: str = ""
    time_field: str = ""
    agg: str = ""
    window: WindowSpec = field(default_factory=WindowSpec)
    grace_ms: int = 0
    retention_ms: int = windows.HOUR_MS
    table_topic: str = ""
    table_key_field: str = ""
    join_type: str = ""

    def validate(self) -> JobConfig:
        """The job with defaults filled in; raises ValueError where it cannot run."""
        job = replace(self, name=self.name.strip(), source_topic=self.source_topic.strip())
        if not job.name or not job.source_topic:
            raise ValueError("name and source_topic are required")
        if job.type == "AGGREGATE":
            job = replace(job, agg=job.agg.lower() or "count", window=replace(job.window, type=job.window.type or "tumbling"))
            if job.agg not in AGGS:
                raise ValueError(f"unknown agg {job.agg!r}")
            if job.agg != "count" and not job.value_field:
                raise ValueError(f"value_field required for agg {job.agg}")
            job.window.validate()
            if job.grace_ms < 0:
                raise ValueError("grace_ms must not be negative")
        elif job.type == "JOIN":
            job = replace(job, join_type=job.join_type.lower() or "inner")
            if not job.table_topic.strip():
                raise ValueError("table_topic required for JOIN")
            if job.join_type not in ("inner", "left"):
                raise ValueError("join_type must be inner or left")
        else:
            raise ValueError("type must be AGGREGATE or JOIN")
        return job

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def of(text: str) -> JobConfig:
        doc = json.loads(text)
        return JobConfig(**doc | {"window": WindowSpec(**doc.get("window", {}))})


def prepared(log: DataFrame, job: JobConfig) -> DataFrame:
    """(arrival_seq, key, ts, x, skipped) of the job's source topic; x is 1 for counts."""
    v = J.parse(F.col("value"))
    x = F.lit(1.0) if job.agg == "count" else J.to_double(J.get(v, job.value_field))
    return log.where(F.col("topic") == job.source_topic).select(
        "arrival_seq",
        J.key_of(v, job.key_field, F.col("key").cast("string")).alias("key"),
        J.event_time(v, job.time_field, F.col("timestamp_ms")).alias("ts"),
        x.alias("x"),
        x.isNull().alias("skipped"),
    )


def aggregate(log: DataFrame, job: JobConfig, *, emit: str = "final") -> DataFrame:
    """State after the whole log, or with ``emit='updates'`` every running result.

    Lateness is exact: each row against the largest event time that had arrived.
    """
    rows = prepared(log, job).where("NOT skipped").drop("skipped")
    w = job.window
    if w.type == "session":
        out = windows.session_changelog(rows, w.gap_ms) if emit == "updates" else windows.sessions(rows, w.gap_ms)
    elif w.type == "sliding":
        out = windows.sliding(rows, w.size_ms, job.grace_ms, every_update=emit == "updates")
    elif emit == "updates":
        out = windows.changelog(rows, w, job.grace_ms)
    else:
        out = windows.fixed(rows, w, job.grace_ms)
    return out.withColumn("value", windows.chosen(job.agg))


def join(log: DataFrame, job: JobConfig, *, as_of: bool = True) -> DataFrame:
    """Stream rows with the table row of their key: as it was on arrival, or the latest."""
    stream = log.where(F.col("topic") == job.source_topic)
    key = J.key_of(J.parse(F.col("value")), job.key_field, F.col("key").cast("string"))
    stream = stream.select("arrival_seq", key.alias("key"), joins.as_json(F.col("value")).alias("value"))
    table = log.where(F.col("topic") == job.table_topic)
    if as_of:
        return joins.join_as_of(stream, joins.changes(table, job.table_key_field), job.join_type)
    return joins.join_latest(stream, joins.snapshot(table, job.table_key_field), job.join_type)


def run(log: DataFrame, job: JobConfig, **kw) -> DataFrame:
    job = job.validate()
    return aggregate(log, job, **kw) if job.type == "AGGREGATE" else join(log, job, **kw)


def number(x: Column) -> Column:
    """A double as JSON has it: without a fraction of zero or an exponent."""
    return F.parse_json(J.text_of(F.parse_json(x.cast("string"))))


def as_records(results: DataFrame, job: JobConfig) -> DataFrame:
    """Results as JSON records of the target topic, partition 0, without a key: of an aggregate key, window_start,
    window_end, count, sum, min, max, avg and value, of a join key, stream and table (null if there is none)."""
    if job.type == "JOIN":
        raw = lambda c: F.coalesce(F.try_parse_json(c), F.parse_json(F.coalesce(joins.as_json(F.col(c)), F.lit("null")))).alias(c)
        doc = F.struct("key", raw("stream"), raw("table"))
    else:
        doc = F.struct("key", "window_start", "window_end", "count", *[number(F.col(c)).alias(c) for c in ("sum", "min", "max", "avg", "value")])
    return results.select(
        F.lit(job.target_topic).alias("topic"), F.lit(0).alias("partition"), F.lit(None).cast("binary").alias("key"), F.to_json(doc, {"ignoreNullFields": "false"}).cast("binary").alias("value"),
        *([F.col("arrival_seq")] if "arrival_seq" in results.columns else []),
    )


def interactive(log: DataFrame, job: JobConfig, key: str = "", from_ms: int = 0, to_ms: int = 0) -> DataFrame:
    """What a job knows after the log: without a key its keys; of a join the key's table row (key, table); of an
    aggregate the key's windows that overlap [from, to], 0 for no bound, in order of start."""
    job = job.validate()
    if job.type == "JOIN":
        table = joins.snapshot(log.where(F.col("topic") == job.table_topic), job.table_key_field)
        return table.where(F.col("key") == key).select("key", F.col("value").alias("table")) if key else table.select("key").orderBy("key")
    state = aggregate(log, job)
    return windows.query(state, key, from_ms, to_ms) if key else windows.distinct_keys(state).orderBy("key")


def metrics(log: DataFrame, job: JobConfig) -> DataFrame:
    """One row of a job's counters over the log."""
    job = job.validate()
    if job.type == "JOIN":
        stream = log.where(F.col("topic") == job.source_topic)
        table = joins.snapshot(log.where(F.col("topic") == job.table_topic), job.table_key_field)
        m = windows.join_metrics(stream, join(log, replace(job, join_type="left")), table)
        emitted = F.col("processed") if job.join_type == "left" else F.col("matched")
        return m.select("processed", emitted.alias("emitted"), "unmatched", "table_rows")
    rows = prepared(log, job)
    return windows.metrics(rows.where("NOT skipped"), rows.where("skipped"), job.window, job.grace_ms)


def poll(log: DataFrame, job: JobConfig, positions: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(rows, positions): one pass over a job's topics from the positions (topic, partition, next_offset; from 0
    where there is none), at most ``limit`` entries of each partition. The table's topic comes before the stream's:
    arrival_seq numbers the rows of the pass so. The positions returned are where the next pass begins."""
    p = ["topic", "partition"]
    rows = log.where(F.col("topic").isin(*[t for t in (job.source_topic, job.table_topic) if t])).join(positions, p, "left")
    rows = rows.where(F.col("offset") >= F.coalesce("next_offset", F.lit(0))).drop("next_offset")
    rows = numbered(rows, p, ["offset"], "__n").where(F.col("__n") <= limit).drop("__n")
    side = F.when(F.col("topic") == job.table_topic, 0).otherwise(1)
    order = Window.orderBy(side, *p, "offset")  # limit rows a partition at most
    rows = rows.drop("arrival_seq").withColumn("arrival_seq", (F.row_number().over(order) - 1).cast("long"))
    ends = rows.groupBy(*p).agg((F.max("offset") + 1).alias("next_offset"))
    kept = positions.join(ends.select(*p), p, "left_anti").select(*p, "next_offset")
    return rows, kept.unionByName(ends)


class Jobs:
    """Definitions by name: register, get, list, pause, delete, and those that a topic feeds."""

    def __init__(self) -> None:
        self._by: dict[str, JobConfig] = {}
        self.paused: set[str] = set()

    def register(self, job: JobConfig) -> JobConfig:
        job = job.validate()
        if job.name in self._by:
            raise KeyError(f"job {job.name!r} exists")
        self._by[job.name] = job
        return job

    def get(self, name: str) -> JobConfig:
        return self._by[name]

    def list(self) -> list[JobConfig]:
        return [self._by[k] for k in sorted(self._by)]

    def pause(self, name: str, paused: bool = True) -> None:
        self.get(name)
        (self.paused.add if paused else self.paused.discard)(name)

    def delete(self, name: str) -> None:
        del self._by[name]
        self.paused.discard(name)

    def fed_by(self, topic: str) -> list[JobConfig]:
        return [j for j in self.list() if topic in (j.source_topic, j.table_topic) and j.name not in self.paused]

    def run_all(self, log: DataFrame, topic: str) -> dict[str, DataFrame]:
        """Every job that a topic feeds, over one log."""
        return {j.name: run(log, j) for j in self.fed_by(topic)}

    def dump(self) -> str:
        return json.dumps([json.loads(j.to_json()) for j in self.list()])

    def load(self, text: str) -> None:
        for doc in json.loads(text):
            self.register(JobConfig.of(json.dumps(doc)))
