"""Windows against a record-at-a-time model and the literal cases of FIXTURES.md."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rivulet.operators import windows
from rivulet.operators.windows import WindowSpec
from rivulet.plans.jobs import JobConfig, Jobs
from rivulet.plans import jobs
from rivulet.streaming.jobs import Fold

SCHEMA = "arrival_seq long, key string, ts long, x double"


def frame(spark, rows):
    return spark.createDataFrame([(i, k, t, float(x)) for i, (k, x, t) in enumerate(rows)], SCHEMA)


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_tumbling(spark):
    rows = frame(spark, [("a", 5, 100), ("a", 7, 900), ("a", 1, 1000), ("b", 3, 1050)])
    out = windows.fixed(rows, WindowSpec("tumbling", 1000), 0)
    assert got(out, "key", "window_start", "sum", "count") == [("a", 0, 12.0, 2), ("a", 1000, 1.0, 1), ("b", 1000, 3.0, 1)]
    assert windows.distinct_keys(out).count() == 2


def test_hopping(spark):
    out = windows.fixed(frame(spark, [("a", 1, 700)]), WindowSpec("hopping", 1000, 500), 0)
    assert got(out, "window_start", "count") == [(0, 1), (500, 1)]


def test_negative_time(spark):
    out = windows.fixed(frame(spark, [("a", 1, -1)]), WindowSpec("hopping", 1000, 300))
    assert got(out, "window_start") == [(-900,), (-600,), (-300,)]


def test_late_and_grace(spark):
    rows = frame(spark, [("a", 1, t) for t in (100, 1400, 200, 2600, 300)])
    spec = WindowSpec("tumbling", 1000)
    assert windows.late_rows(rows, spec, 500).count() == 1
    out = windows.query(windows.fixed(rows, spec, 500), "a", 0, 999)
    assert got(out, "window_start", "count") == [(0, 2)]


def test_session(spark):
    rows = [("a", 10, 0), ("a", 10, 50), ("a", 10, 400), ("a", 30, 500), ("a", 20, 220)]
    out = got(windows.sessions(frame(spark, rows), 100), "window_start", "window_end", "count", "avg")
    assert out == [(0, 50, 2, 10.0), (220, 220, 1, 20.0), (400, 500, 2, 20.0)]
    out = got(windows.sessions(frame(spark, [*rows, ("a", 0, 130)]), 100), "window_start", "window_end", "count")
    assert out == [(0, 220, 4), (400, 500, 2)]


def test_sliding(spark):
    out = got(windows.sliding(frame(spark, [("a", 1, t) for t in (100, 600, 1300)]), 1000, 0), "window_end", "count")
    assert out == [(100, 1), (600, 2), (1300, 2)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 9), st.integers(-900, 900)), min_size=1, max_size=40), st.sampled_from([1, 2, 64]))
def test_spans_of_time_change_nothing(spark, rows, span):
    """Sessions and sliding windows of busy keys are found in spans of time; a model looks at all events of a key at once."""
    old, windows.SPAN = windows.SPAN, span
    try:
        df = frame(spark, rows)
        want = []
        for k in {r[0] for r in rows}:
            mine = sorted((t, x) for key, x, t in rows if key == k)
            group = [mine[0]]
            for e in [*mine[1:], (10**9, 0)]:
                if e[0] - group[-1][0] > 50:
                    want.append((k, group[0][0], group[-1][0], len(group), float(sum(x for _, x in group))))
                    group = []
                group.append(e)
        assert got(windows.sessions(df, 50), "key", "window_start", "window_end", "count", "sum") == sorted(want)
        want = {(k, t, len(m), float(sum(m)), float(min(m))) for k, _, t in rows for m in ([x for key, x, ts in rows if key == k and t - 70 < ts <= t],)}
        assert got(windows.sliding_in_order(df, 70), "key", "window_end", "count", "sum", "min") == sorted(want)
    finally:
        windows.SPAN = old


def model(rows, job):
    fold, out = Fold(job), []
    for i, (k, x, t) in enumerate(rows):
        out += fold.add(i, k, t, float(x))
    return out, fold.s["late"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 9), st.integers(-2000, 6000)), min_size=1, max_size=25))
def test_any_arrival_agrees_with_the_model(spark, rows):
    df = frame(spark, rows)
    for spec in (WindowSpec("tumbling", 700), WindowSpec("hopping", 1000, 300)):
        job = {"window": {"type": spec.type, "size_ms": spec.size_ms, "advance_ms": spec.advance_ms, "gap_ms": 0}, "grace_ms": 400, "retention_ms": 1 << 40}
        want, late = model(rows, job)
        assert got(windows.changelog(df, spec, 400), "arrival_seq", "key", "window_start", "count", "sum") == sorted((r[0], r[1], r[2], r[4], r[5]) for r in want)
        assert windows.late_rows(df, spec, 400).count() == late
    job = {"window": {"type": "session", "size_ms": 0, "advance_ms": 0, "gap_ms": 500}, "grace_ms": 0, "retention_ms": 0}
    want, _ = model(rows, job)
    assert got(windows.session_changelog(df, 500), "arrival_seq", "key", "window_start", "window_end", "count", "sum", "min", "max") == sorted(r[:8] for r in want)
    job = {"window": {"type": "sliding", "size_ms": 900, "advance_ms": 0, "gap_ms": 0}, "grace_ms": 400, "retention_ms": 0}
    want, _ = model(rows, job)
    assert got(windows.sliding(df, 900, 400, every_update=True), "arrival_seq", "key", "window_end", "count", "sum") == sorted((r[0], r[1], r[3], r[4], r[5]) for r in want)


def test_stream_time_over_ranges(spark):
    random.seed(3)
    rows = [("a", 1, random.randrange(10_000)) for _ in range(200)]
    t = {r.arrival_seq: r.stream_t for r in windows.stream_time(frame(spark, rows), range_rows=16).collect()}
    top = -1
    for i, (_, _, ts) in enumerate(rows):
        top = max(top, ts)
        assert t[i] == top


def test_a_job_goes_on_after_a_restart(spark, tmp_path):
    """State, stream time and offsets outlive the query: three records, none after a restart, then one more."""
    from rivulet.sources import log as logs
    from rivulet.streaming import jobs as stream

    job = JobConfig("j", "AGGREGATE", "s", key_field="user", window=WindowSpec("tumbling", 1000), grace_ms=100)
    path, out, state = (f"file://{tmp_path}/{x}" for x in ("log", "out", "state"))

    def send(*records):
        rows = [("s", 0, i, t, None, b'{"user":"%s"}' % u.encode(), [], -1, -1, -1, False, False, i) for i, u, t in records]
        spark.createDataFrame(rows, logs.SCHEMA).coalesce(1).write.mode("append").parquet(path)

    def run():
        rows = lambda: stream.read_log(spark, path, max_files=1)
        both = stream.start_files(stream.exact_aggregate(rows(), job), out, state), stream.exact_files(rows(), job, f"{out}2", f"{state}2")
        for q in both:
            q.awaitTermination()
            assert q.exception() is None
        a, b = (got(spark.read.parquet(x), "arrival_seq", "key", "window_start", "count") for x in (out, f"{out}2/out"))
        assert a == b
        return a

    send((0, "a", 100), (1, "a", 200), (2, "b", 900))
    first = [(0, "a", 0, 1), (1, "a", 0, 2), (2, "b", 0, 1)]
    assert run() == first
    assert run() == first  # nothing new
    send((3, "a", 1050))
    assert run() == [*first, (3, "a", 1000, 1)]
    send((4, "a", 300))  # the first window is open until 1100
    assert run() == [*first, (3, "a", 1000, 1), (4, "a", 0, 3)]
    send((5, "b", 1200))
    send((6, "a", 300))  # late against a stream time that two queries before have reached
    assert run() == [*first, (3, "a", 1000, 1), (4, "a", 0, 3), (5, "b", 1000, 1)]


def test_session_updates_of_a_job(spark):
    job = JobConfig("j", "AGGREGATE", "s", key_field="user", window=WindowSpec("session", gap_ms=100))
    log = spark.createDataFrame([("s", i, t, None, b'{"user":"a"}') for i, t in enumerate((0, 300, 90, 180, 250))], "topic string, arrival_seq long, timestamp_ms long, key binary, value binary")
    assert got(jobs.run(log, job, emit="updates"), "arrival_seq", "window_start", "window_end", "count") == [(0, 0, 0, 1), (1, 300, 300, 1), (2, 0, 90, 2), (3, 0, 180, 3), (4, 0, 300, 5)]


def test_empty_input(spark):
    none = frame(spark, [("a", 1, 1)]).limit(0)
    assert windows.fixed(none, WindowSpec("tumbling", 10), 0).count() == 0
    assert windows.sessions(none, 10).count() == 0
    assert windows.sliding(none, 10, 0).count() == 0


@pytest.mark.parametrize(
    "bad",
    [
        {"window": WindowSpec("tumbling")},
        {"agg": "sum", "window": WindowSpec("tumbling", 10)},
        {"agg": "median", "window": WindowSpec("tumbling", 10)},
        {"window": WindowSpec("hopping", 10, 20)},
        {"window": WindowSpec("session")},
        {"window": WindowSpec("odd", 10)},
        {"window": WindowSpec("tumbling", 10), "grace_ms": -1},
        {"type": "JOIN"},
        {"type": "JOIN", "table_topic": "t", "join_type": "full"},
        {"type": "OTHER"},
        {"name": " ", "window": WindowSpec("tumbling", 10)},
    ],
)
def test_invalid_jobs(bad):
    with pytest.raises(ValueError):
        JobConfig(**{"name": "j", "type": "AGGREGATE", "source_topic": "s"} | bad).validate()


def test_job_registry(spark):
    r = Jobs()
    job = r.register(JobConfig("j", "AGGREGATE", "s", window=WindowSpec("tumbling", 60_000), agg="SUM", value_field="amt", key_field="user"))
    with pytest.raises(KeyError):
        r.register(job)
    assert r.fed_by("s") == [job] and r.fed_by("t") == []
    r.pause("j")
    assert r.fed_by("s") == []
    again = Jobs()
    again.load(r.dump())
    assert again.list() == [job]
    log = spark.createDataFrame(
        [("s", 1, 61_000, None, b'{"user":"ann","amt":10}'), ("s", 2, 61_000, None, b'{"user":"ann","amt":"5.5"}'), ("s", 3, 61_000, None, b'{"user":"ann"}'), ("s", 4, 61_000, None, b"no json")],
        "topic string, arrival_seq long, timestamp_ms long, key binary, value binary",
    )
    assert got(jobs.run(log, job), "key", "window_start", "sum", "count", "value") == [("ann", 60_000, 15.5, 2, 15.5)]
    r.delete("j")
    assert r.list() == []


@pytest.mark.parametrize("name", ["stream_tumbling_update", "stream_session", "stream_join_static"])
def test_streamed_results_are_files(spark, name):
    """What a stream made is read from the sink's files, not from a table in the driver's memory."""
    from rivulet.plans import catalogue

    out = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert out.inputFiles() and out.count() > 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None


def test_a_streamed_log_is_made_once(spark, monkeypatch):
    """No pass over the log before the one that writes it."""
    from rivulet.plans import catalogue
    from rivulet.streaming import jobs as stream

    made, events = spark.sparkContext.accumulator(0), catalogue.logs.events

    def counted(*where):
        log = events(*where)

        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return log.mapInArrow(run, log.schema)

    monkeypatch.setattr(catalogue.logs, "events", counted)
    out = catalogue.streamed(spark, "/root/testdata/sf0.001", stream.running_count, "update")
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert out.groupBy().sum("count").first()[0] == n
    assert made.value == n


def test_a_whole_result_is_that_of_the_last_batch(spark, tmp_path):
    """Mode complete writes everything with each micro-batch; sessions that a later file joins come out once."""
    from rivulet.streaming import jobs as stream

    log, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    job = JobConfig("s", "AGGREGATE", "events", key_field="user", value_field="amt", agg="sum", window=WindowSpec("session", gap_ms=10))
    for seqs in ([(0, 0), (1, 15)], [(2, 7)]):
        body = spark.createDataFrame([(s, t, f'{{"user":"a","amt":{s + 1}}}') for s, t in seqs], "arrival_seq long, timestamp_ms long, v string")
        body.selectExpr("'events' AS topic", "0 AS partition", "arrival_seq AS offset", "timestamp_ms", "CAST(v AS BINARY) AS value", "arrival_seq").write.mode("append").parquet(log)
        q = stream.start_files(stream.aggregate(stream.read_log(spark, log), job), out, state, stream.output_mode(job))
        q.awaitTermination()
        assert q.exception() is None
    got = [(r.key, r.window_start, r.window_end, r["count"], r["sum"]) for r in stream.read_files(spark, out, "complete").collect()]
    assert got == [("a", 0, 15, 3, 6.0)]
