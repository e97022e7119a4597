"""Windowed aggregation over (arrival_seq, key, ts, x): four kinds of window, stream time, lateness.

Results carry all five aggregates; ``window_end`` of sliding and session windows is the
last event, inclusive, that of tumbling and hopping windows exclusive.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.ranges import numbered
from rivulet.session import ship

HOUR_MS = 3_600_000


@dataclass(frozen=True)
class WindowSpec:
    type: str = "tumbling"
    size_ms: int = 0
    advance_ms: int = 0
    gap_ms: int = 0

    def validate(self) -> None:
        if self.type in ("tumbling", "sliding"):
            if self.size_ms <= 0:
                raise ValueError("window.size_ms must be positive")
        elif self.type == "hopping":
            if not 0 < self.advance_ms <= self.size_ms:
                raise ValueError("hopping needs 0 < advance_ms <= size_ms")
        elif self.type == "session":
            if self.gap_ms <= 0:
                raise ValueError("session window needs gap_ms > 0")
        else:
            raise ValueError(f"unknown window type {self.type!r}")


def aggregates(x: str = "x") -> list[Column]:
    return [
        F.count(x).alias("count"),
        F.sum(x).alias("sum"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.avg(x).alias("avg"),
    ]


def chosen(agg: str) -> Column:
    return F.col(agg).cast("double").alias("value")


def stream_time(rows: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """Adds stream_t: the largest event time among all rows that have arrived, this one included.

    A running maximum over all keys. Rows are cut into ranges of arrival; the maximum of
    every range is a partial aggregate, the maxima before a range come from an ordered
    window over those few rows, and only then does a window run inside each range.
    """
    cut = F.floor(F.col("arrival_seq") / range_rows)
    top = rows.groupBy(cut.alias("__range")).agg(F.max("ts").alias("__top"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    start = top.select("__range", F.max("__top").over(before).alias("__before"))
    inside = Window.partitionBy("__range").orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("__range", cut).join(start, "__range").withColumn("stream_t", F.max("ts").over(inside))
    return out.withColumn("stream_t", F.greatest("stream_t", "__before")).drop("__range", "__before")


def timed(rows: DataFrame) -> DataFrame:
    """``rows`` with stream_t, which a caller who knows it better has added already."""
    return rows if "stream_t" in rows.columns else stream_time(rows)


def starts(ts: Column, size_ms: int, advance_ms: int) -> Column:
    """Starts of all windows that hold ``ts``, latest first; right for negative times."""
    last = F.floor(ts / advance_ms).cast("long") * advance_ms
    back = F.sequence(F.lit(0), F.lit((size_ms - 1) // advance_ms))
    return F.filter(F.transform(back, lambda i: last - i * advance_ms), lambda s: s > ts - size_ms)


def in_windows(rows: DataFrame, spec: WindowSpec) -> DataFrame:
    """One row for every fixed window of a row."""
    if spec.type == "tumbling":
        start = F.floor(F.col("ts") / spec.size_ms).cast("long") * spec.size_ms
    else:
        start = F.explode(starts(F.col("ts"), spec.size_ms, spec.advance_ms))
    return rows.withColumn("window_start", start).withColumn("window_end", F.col("window_start") + spec.size_ms)


def accepted(rows: DataFrame, spec: WindowSpec, grace_ms: int) -> DataFrame:
    """Updates of fixed windows that are not closed when the row arrives (needs stream_t)."""
    return in_windows(rows, spec).where(F.col("window_end") + grace_ms > F.col("stream_t"))


def fixed(rows: DataFrame, spec: WindowSpec, grace_ms: int | None = None) -> DataFrame:
    """Final state of tumbling or hopping windows; without grace nothing is late and no order is needed."""
    w = in_windows(rows, spec) if grace_ms is None else accepted(timed(rows), spec, grace_ms)
    return w.groupBy("key", "window_start", "window_end").agg(*aggregates())


def late_rows(rows: DataFrame, spec: WindowSpec, grace_ms: int) -> DataFrame:
    """Rows that update nothing: all their windows are closed, or too old for a sliding window."""
    t = stream_time(rows)
    if spec.type == "sliding":
        return t.where(F.col("ts") + grace_ms < F.col("stream_t") - spec.size_ms)
    if spec.type == "session":
        return t.where(F.lit(False))
    advance = spec.size_ms if spec.type == "tumbling" else spec.advance_ms
    newest = F.floor(F.col("ts") / advance).cast("long") * advance + spec.size_ms
    return t.where(newest + grace_ms <= F.col("stream_t"))


def changelog(rows: DataFrame, spec: WindowSpec, grace_ms: int) -> DataFrame:
    """The running result after every accepted update of a fixed window."""
    run = Window.partitionBy("key", "window_start").orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, 0)
    names = ("count", "sum", "min", "max", "avg")
    return accepted(timed(rows), spec, grace_ms).select(
        "arrival_seq", "key", "window_start", "window_end", *[c.over(run).alias(n) for c, n in zip((F.count("x"), F.sum("x"), F.min("x"), F.max("x"), F.avg("x")), names, strict=True)]
    )


def sessions(rows: DataFrame, gap_ms: int) -> DataFrame:
    """Sessions of events at most ``gap_ms`` apart, bounds inclusive; arrival order does not matter.

    In two levels: the events of a key are cut into spans of ``SPAN`` gaps, whose sessions are found first; only
    these, aggregated, meet by key and merge where they are close enough."""
    inside = Window.partitionBy("key", "__span").orderBy("ts")
    cut = rows.withColumn("__span", F.floor(F.col("ts") / (SPAN * gap_ms)))
    named = cut.withColumn("__new", F.when(F.col("ts") - F.lag("ts").over(inside) > gap_ms, 1).otherwise(0)).withColumn("__id", F.sum("__new").over(inside))
    part = named.groupBy("key", "__span", "__id").agg(F.min("ts").alias("s"), F.max("ts").alias("e"), F.count("x").alias("n"), F.sum("x").alias("t"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    whole = Window.partitionBy("key").orderBy("s")
    named = part.withColumn("__new", F.when(F.col("s") - F.lag("e").over(whole) > gap_ms, 1).otherwise(0)).withColumn("__id", F.sum("__new").over(whole))
    out = named.groupBy("key", "__id").agg(F.min("s").alias("window_start"), F.max("e").alias("window_end"), F.sum("n").alias("count"), F.sum("t").alias("sum"), F.min("lo").alias("min"), F.max("hi").alias("max"))
    return out.withColumn("avg", F.try_divide("sum", "count")).drop("__id")


#: Gaps, or window sizes, of a key's time that are looked at together.
SPAN = 64


def session_changelog(rows: DataFrame, gap_ms: int) -> DataFrame:
    """The running result after every row: the session that holds it, of what had arrived by then.

    Sessions merge as rows arrive, so this is a fold per key in order of arrival, over (arrival_seq, ts, x)."""
    schema = "arrival_seq long, key string, window_start long, window_end long, count long, sum double, min double, max double, avg double"

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("arrival_seq")
        live, out = [], []  # sessions that do not touch, in order: start, end, count, sum, min, max
        for seq, key, ts, x in pdf[["arrival_seq", "key", "ts", "x"]].itertuples(index=False):
            lo = bisect_left(live, ts - gap_ms, key=lambda s: s[1])
            hi = bisect_right(live, ts + gap_ms, key=lambda s: s[0])
            now = [ts, ts, 0, 0.0, x, x]
            for s in live[lo:hi]:
                now = [min(now[0], s[0]), max(now[1], s[1]), now[2] + s[2], now[3] + s[3], min(now[4], s[4]), max(now[5], s[5])]
            now[2:4] = now[2] + 1, now[3] + x
            live[lo:hi] = [now]
            out.append((seq, key, *now, now[3] / now[2]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    ship(rows.sparkSession)
    return rows.select("arrival_seq", "key", "ts", "x").groupBy("key").applyInPandas(run, schema)


def sliding_in_order(rows: DataFrame, size_ms: int) -> DataFrame:
    """Final state per (key, ts) where rows arrive in order of time: a range frame, no join.

    A key's time is cut into spans of ``SPAN`` window sizes, so a busy key is spread; what the first windows of a span
    need of the one before is copied there."""
    span = F.floor(F.col("ts") / (SPAN * size_ms))
    nearly = (F.col("ts") + size_ms - 1) >= (span + 1) * (SPAN * size_ms)
    cut = rows.select("key", "ts", "x", span.alias("__own"), F.explode(F.when(nearly, F.array(span, span + 1)).otherwise(F.array(span))).alias("__span"))
    w = Window.partitionBy("key", "__span").orderBy("ts").rangeBetween(-(size_ms - 1), 0)
    cols = (F.count("x"), F.sum("x"), F.min("x"), F.max("x"), F.avg("x"))
    names = ("count", "sum", "min", "max", "avg")
    out = cut.select("key", "ts", "__own", "__span", *[c.over(w).alias(n) for c, n in zip(cols, names, strict=True)]).where("__own = __span").dropDuplicates(["key", "ts"])
    return out.select("key", (F.col("ts") - size_ms + 1).alias("window_start"), F.col("ts").alias("window_end"), *names)


def sliding(rows: DataFrame, size_ms: int, grace_ms: int, *, every_update: bool = False) -> DataFrame:
    """Per event, the aggregate of what had arrived of (t - size, t], in any order of arrival.

    A range join cut into equal keys: an event looks at its own and the previous bucket of
    ``size`` milliseconds of its key. The last arrival per (key, t) is the final state;
    ``every_update`` returns all.
    """
    live = timed(rows).where(F.col("ts") + grace_ms >= F.col("stream_t") - size_ms)
    bucket = F.floor(F.col("ts") / size_ms)
    a = live.withColumn("b", F.explode(F.array(bucket, bucket - 1))).alias("a")
    b = live.withColumn("b", bucket).alias("b")
    seen = (
        (F.col("a.key") == F.col("b.key")) & (F.col("a.b") == F.col("b.b"))
        & (F.col("b.arrival_seq") <= F.col("a.arrival_seq"))
        & (F.col("b.ts") > F.col("a.ts") - size_ms) & (F.col("b.ts") <= F.col("a.ts"))
        & (F.col("b.ts") >= F.col("a.stream_t") - size_ms - grace_ms)
    )
    out = a.join(b, seen).groupBy(F.col("a.key").alias("key"), F.col("a.ts").alias("ts"), F.col("a.arrival_seq").alias("arrival_seq")).agg(*aggregates("b.x"))
    if not every_update:
        last = Window.partitionBy("key", "ts").orderBy(F.desc("arrival_seq"))
        out = out.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn")
    return out.select("arrival_seq", "key", (F.col("ts") - size_ms + 1).alias("window_start"), F.col("ts").alias("window_end"), "count", "sum", "min", "max", "avg")


def prune(state: DataFrame, stream_t: int, grace_ms: int, retention_ms: int = HOUR_MS, gap_ms: int = 0) -> DataFrame:
    """State without windows that ended before stream time less grace and retention."""
    return state.where(F.col("window_end") + gap_ms >= stream_t - grace_ms - retention_ms)


def query(state: DataFrame, key: str, from_ms: int = 0, to_ms: int = 0) -> DataFrame:
    """Windows of a key that overlap [from, to], 0 for no bound, in order of start."""
    hit = F.col("key") == key
    if from_ms:
        hit = hit & (F.col("window_end") >= from_ms)
    if to_ms:
        hit = hit & (F.col("window_start") <= to_ms)
    return state.where(hit).orderBy("window_start")


def running_count(rows: DataFrame) -> DataFrame:
    """Unwindowed count per key, after every row."""
    return numbered(rows, ["key"], ["arrival_seq"], "count").select("arrival_seq", "key", "count")


def distinct_keys(state: DataFrame) -> DataFrame:
    return state.select("key").distinct()


def metrics(rows: DataFrame, skipped: DataFrame, spec: WindowSpec, grace_ms: int) -> DataFrame:
    """processed, late, skipped, emitted, stream_time and live keys of an aggregating job over a batch. Every
    accepted update of a window is emitted, so a row may emit several."""
    t = stream_time(rows)
    if spec.type == "sliding":
        on_time = F.when(F.col("ts") + grace_ms >= F.col("stream_t") - spec.size_ms, 1).otherwise(0)
    elif spec.type == "session":
        on_time = F.lit(1)
    else:
        advance = spec.size_ms if spec.type == "tumbling" else spec.advance_ms
        open_ = F.filter(starts(F.col("ts"), spec.size_ms, advance), lambda s: s + spec.size_ms + grace_ms > F.col("stream_t"))
        on_time = F.size(open_)
    p = t.withColumn("__n", on_time).agg(
        F.count("*").alias("n"), F.count_if(F.col("__n") == 0).alias("late"), F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("emitted"),
        F.max("ts").alias("stream_time"), F.countDistinct("key").alias("keys"),
    )
    s = skipped.agg(F.count("*").alias("skipped"))
    one = F.lit(1).alias("one")  # two results of one row each
    return p.select("*", one).join(s.select("*", one), "one").select((F.col("n") + F.col("skipped")).alias("processed"), "late", "skipped", "emitted", "stream_time", "keys")


def join_metrics(stream: DataFrame, joined: DataFrame, table: DataFrame) -> DataFrame:
    """processed, unmatched, emitted and table_rows of a join job: ``joined`` is its left join with ``table``."""
    n = joined.agg(F.count("*").alias("processed"), F.count_if(F.col("table").isNull()).alias("unmatched"), F.count_if(F.col("table").isNotNull()).alias("matched"))
    one = F.lit(1).alias("one")
    return n.select("*", one).join(table.agg(F.count("*").alias("table_rows")).select("*", one), "one").select("processed", "unmatched", "matched", "table_rows")
