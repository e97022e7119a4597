"""Filters, transforms, joins, log maintenance, queues, groups, schemas, connectors."""

import json
import os
import random
import struct
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rivulet.functions import hashing
from rivulet.functions import jsonpath as J
from rivulet.operators import acl, connectors, filters, groups, joins, logops, queues, ranges, schemas, transforms
from rivulet.sources import avro, batches
from rivulet.sources import log as logs
from rivulet.sources.tables import SnapshotTable


def passes(spark, expr, doc, mode="fail"):
    df = spark.createDataFrame([(doc if isinstance(doc, str) else json.dumps(doc),)], "value string")
    return df.select(filters.condition(expr, F.col("value"), mode)).first()[0]


@pytest.mark.parametrize(
    ("expr", "doc", "want"),
    [
        ('level == "CRITICAL"', {"level": "critical"}, True),
        ('level == "CRITICAL"', {"level": "INFO"}, False),
        ('user.tier == "VIP"', {"user": {"tier": "VIP"}}, True),
        ('User.TIER == "VIP"', {"user": {"tier": "VIP"}}, True),
        ("amount >= 100", {"amount": 100}, True),
        ("amount >= 100", {"amount": "50"}, False),
        ('message contains "FATAL"', {"message": "a fatal error"}, True),
        ("x != 1", {"y": 1}, True),
        ("x == 1", {"y": 1}, False),
        ("x == 1.0", {"x": 1}, True),
        ("ok == T", {"ok": True}, True),
        ("ok != true", {"ok": True}, False),
        ("payload.x < 3", {"x": 2.5}, True),
        ('message contains "a>b"', {"message": "a>b"}, False),
    ],
)
def test_filter(spark, expr, doc, want):
    if expr.endswith('"a>b"'):
        with pytest.raises(ValueError):  # read as an ordering, whose right side is no number
            filters.condition(expr, F.lit("{}"))
        return
    assert passes(spark, expr, doc) is want


def test_filter_errors(spark):
    with pytest.raises(Exception, match="not numeric"):
        passes(spark, "x > 1", {"x": [1]})
    assert passes(spark, "x > 1", {"x": [1]}, "drop") is False
    assert passes(spark, "x > 1", "no json", "null") is None
    with pytest.raises(ValueError):
        filters.parse("just words")
    assert filters.expression_of({"code": "// x\nfilter: a == 1;"}) == "a == 1"


def test_long_paths_and_many_renames(spark):
    """Plans do not grow with the path or the number of renames."""
    doc = '{"A":{"b":{"C":{"d":{"e":{"f":{"g":{"H":7}}}}}}}}'
    df = spark.createDataFrame([(doc,)] * 500, "value string")
    assert df.where(filters.condition("a.B.c.D.E.F.G.h == 7", F.col("value"))).count() == 500
    assert df.where(filters.condition("a.B.c.D.E.F.G.x != 7", F.col("value"))).count() == 500
    m = transforms.JsonMap.of({"add_fields": "k0:v", "rename_fields": ",".join(f"k{i}:k{i + 1}" for i in range(12)) + ",a:k12"})
    assert json.loads(df.select(m(F.col("value"))).first()[0]) == {"k12": "v", "A": json.loads(doc)["A"]}
    swapped = transforms.JsonMap.of({"add_fields": "a:1,b:2", "rename_fields": "a:t,b:a,t:b"})
    assert json.loads(df.select(swapped(F.lit("{}"))).first()[0]) == {"a": "2", "b": "1"}


JSON = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text("ab<>&{}[]:,\"\\\n é", max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab", max_size=3), x, max_size=3), max_leaves=12)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.dictionaries(st.text("abc", min_size=1, max_size=3), JSON, max_size=4), min_size=1, max_size=6))
def test_indented_output(spark, docs):
    df = spark.createDataFrame([(json.dumps(d, sort_keys=True, separators=(",", ":"), ensure_ascii=False),) for d in docs], "v string")
    got = [r[0] for r in df.select(transforms.indent(F.col("v"))).collect()]
    want = [json.dumps(d, sort_keys=True, indent=2, ensure_ascii=False) for d in docs]
    for c in "<>&":
        want = [w.replace(c, f"\\u{ord(c):04x}") for w in want]
    assert got == want


def test_user_function_slot(spark):
    df = spark.createDataFrame([('{"a":1,"A":2,"b":{}}',), ("plain",), (None,)], "value string")
    t = transforms.Transforms()
    t.create(transforms.Transform("up", "UDF", "a", "b", {"action": "uppercase_keys"}))
    t.create(transforms.Transform("own", "UDF", "a", "b", udf=lambda v: F.reverse(v.cast("string"))))
    out = [r.output for r in t.test("up", df).collect()]
    doc = json.loads(out[0])
    assert doc.pop("_wasm_execution")["source_module"] == "up" and doc == {"A": 1, "B": {}} and out[0].startswith("{\n  ")
    assert out[1] == "// WASM Processed by up\nplain" and out[2] is None
    assert [r.output for r in t.test("own", df).collect()] == ['}}{:"b",2:"A",1:"a"{', "nialp", None]


def test_globs(spark):
    cases = [
        ("p[^u]x", "pax", True), ("p[^u]x", "pux", False), ("p[uv]x", "pux", True), ("a\\*b", "a*b", True), ("a\\*b", "axb", False), ("a*b", "a/b", False), ("a?b", "a.b", True),
        ("a.b", "axb", False), ("[a-c]z", "bz", True), ("[^a-c]z", "bz", False), ("[", "[", False), ("a\\", "a", False), ("x[\\]]y", "x]y", True), ("a+(c)", "a+(c)", True), ("", "", True), ("[[]q", "[q", True), ("a[&&]b", "a&b", True),
    ]
    df = spark.createDataFrame(cases, "p string, n string, want boolean")
    assert df.where(F.rlike("n", acl.glob(F.col("p"))) != F.col("want")).count() == 0


def test_json_rules(spark):
    docs = ['{"t":1700000000}', '{"t":1700000000123}', '{"t":"2023-11-14T22:13:20.5Z"}', '{"t":"1700000000"}', '{"t":"x"}', '{"t":null}', "{}"]
    df = spark.createDataFrame([(d,) for d in docs], "v string")
    out = [r[0] for r in df.select(J.to_millis(J.get(J.parse(F.col("v")), "t"))).collect()]
    assert out == [1700000000000, 1700000000123, 1700000000500, 1700000000000, None, None, None]
    keys = spark.createDataFrame([(x,) for x in ('{"k":1.0}', '{"k":true}', '{"k":null}', "{}", '{"k":{"b":1,"a":2}}', '{"k":"s"}', '{"k":1e3}')], "v string")
    assert [r[0] for r in keys.select(J.to_key(J.get(J.parse(F.col("v")), "k"))).collect()] == ["1", "true", "", "", '{"a":2,"b":1}', "s", "1000"]


def test_transforms(spark):
    doc = {"order_id": 1, "customer": {"name": "n", "email": "e", "password": {"x": 1}}, "list": [{"cvv": 1}]}
    df = spark.createDataFrame([(json.dumps(doc),)], "value string")
    out = json.loads(df.select(transforms.mask_nested()(F.col("value"))).first()[0])
    assert out == {"order_id": 1, "customer": {"name": "n", "email": "***", "password": "***"}, "list": [{"cvv": "***"}]}
    m = transforms.JsonMap.of({"set_region": "us-east-1", "rename_fields": "old_name:new_name", "remove_fields": "debug_info"})
    df = spark.createDataFrame([('{"old_name":"alpha","debug_info":1,"value":2}',)], "value string")
    assert json.loads(df.select(m(F.col("value"))).first()[0]) == {"region": "us-east-1", "new_name": "alpha", "value": 2}
    df = spark.createDataFrame([('{"greeting":"hi","target":"w"}',)], "value string")
    assert json.loads(df.select(transforms.uppercase_keys(F.col("value"))).first()[0]) == {"GREETING": "hi", "TARGET": "w"}
    reg = transforms.Transforms()
    reg.create(transforms.Transform("f", "FILTER", "a", "b", {"condition": "n > 1"}))
    with pytest.raises(KeyError):
        reg.create(transforms.Transform("f", "FILTER", "a", "b"))
    reg.pause("f")
    out = reg.test("f", spark.createDataFrame([('{"n":1}',), ('{"n":2}',)], "value string")).collect()
    assert [r["drop"] for r in out] == [True, False]


def test_join_with_tombstones(spark):
    table = spark.createDataFrame([(1, None, b'{"id":"c1","name":"Ann"}'), (5, b"c1", b""), (2, None, b"{}")], "arrival_seq long, key binary, value binary")
    stream = spark.createDataFrame([(0, "c1", "s0"), (3, "c1", "s3"), (4, "zz", "s4"), (6, "c1", "s6")], "arrival_seq long, key string, value string")
    out = joins.join_as_of(stream, joins.changes(table, "id"), "left").orderBy("arrival_seq").collect()
    assert [r["table"] for r in out] == [None, '{"id":"c1","name":"Ann"}', None, None]
    assert joins.join_as_of(stream, joins.changes(table, "id")).count() == 1
    assert joins.snapshot(table, "id").count() == 0
    assert joins.join_latest(stream, joins.snapshot(table.where("arrival_seq < 5"), "id")).count() == 3


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.sampled_from("ab"), st.sampled_from(["x", "y", ""])), min_size=1, max_size=40), st.integers(1, 9))
def test_as_of_join_in_ranges(spark, rows, width):
    """Against a table kept row by row, whatever the ranges."""
    table, want = {}, []
    for i, (change, k, v) in enumerate(rows):
        if change:
            table[k] = v or None
        else:
            want.append((i, table.get(k)))
    schema = "arrival_seq long, key string, value string"
    changes = spark.createDataFrame([(i, k, v) for i, (c, k, v) in enumerate(rows) if c], schema)
    stream = spark.createDataFrame([(i, k, "s") for i, (c, k, _) in enumerate(rows) if not c], schema)
    out = joins.join_as_of(stream, joins.changes(changes), "left", width=width)
    assert sorted((r.arrival_seq, r.table) for r in out.collect()) == want


def log_frame(spark, rows):
    """rows: (offset, key, value, ts)."""
    df = spark.createDataFrame([(o, k, v, t) for o, k, v, t in rows], "offset long, key binary, value binary, timestamp_ms long")
    return df.selectExpr("'t' AS topic", "0 AS partition", "*", "CAST(NULL AS ARRAY<STRUCT<key: STRING, value: BINARY>>) AS headers", "FALSE AS is_control", "offset AS arrival_seq")


def test_compaction(spark):
    rows = [(0, b"a", b"1", 0), (1, b"b", b"1", 0), (2, b"a", b"2", 0), (3, None, b"x", 0), (4, b"b", b"", 0), (5, b"a", b"3", 0)]
    seg = log_frame(spark, rows).withColumn("segment_id", F.when(F.col("offset") < 5, 0).otherwise(1).cast("long"))
    keep = lambda now: sorted(r.offset for r in logops.compact(seg, now, 1000).collect())
    assert keep(500) == [2, 3, 4, 5]  # the active segment supersedes nothing
    assert keep(5000) == [2, 3, 5]
    r = logops.dirty_ratio(seg, 5000, 1000).first()
    assert (r.dirty_bytes, r.total_bytes, r["keys"]) == (2 + 2 + 1, 2 * 3 + 1 + 1, 2)


SENT = "topic string, partition int, producer_id long, producer_epoch int, sequence int, arrival_seq long"


def test_dedup_recovers_after_a_gap(spark):
    rows = [(0, 0, 0), (1, 0, 2), (2, 0, 1), (3, 0, 2), (4, 0, 1), (5, 1, 0), (6, 0, 3), (7, 1, 5)]
    df = spark.createDataFrame([("t", 0, 1, e, s, a) for a, e, s in rows], SENT)
    for f in (logops.dedup, logops.dedup_fold):
        out = {r.arrival_seq: r.status for r in f(df).collect()}
        assert [out[i] for i in range(8)] == ["accepted", "gap", "accepted", "accepted", "duplicate", "accepted", "fenced", "gap"]


def test_dedup_of_records_that_arrive_together(spark):
    """One row for each, with its own status, in either way of deciding: producer 1 has a gap, producer 2 none."""
    sent = [(1, 0, 0), (1, 7, 1), (1, 7, 5), (2, 0, 0), (2, 0, 0), (2, 3, 2), (2, 3, 1)]
    df = spark.createDataFrame([("t", 0, p, 0, s, a, f"{i}") for i, (p, a, s) in enumerate(sent)], SENT + ", value string")
    want = sorted([(1, 0, "accepted"), (1, 1, "accepted"), (1, 5, "gap"), (2, 0, "accepted"), (2, 0, "duplicate"), (2, 1, "accepted"), (2, 2, "accepted")])
    out = logops.dedup(df).collect()
    assert sorted((r.producer_id, r.sequence, r.status) for r in out) == want
    assert sorted(int(r.value) for r in out) == list(range(len(sent)))
    assert sorted((r.producer_id, r.sequence, r.status) for r in logops.dedup_fold(df).collect()) == want


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 2), st.integers(0, 4)), min_size=1, max_size=40))
def test_dedup_is_the_fold(spark, sent):
    """The windows that decide producers without gaps agree with the fold in any order of arrival."""
    df = spark.createDataFrame([("t", 0, p, e, s, a) for a, (p, e, s) in enumerate(sent)], SENT)
    rows = lambda x: sorted((r.arrival_seq, r.status) for r in x.collect())
    assert rows(logops.dedup(df)) == rows(logops.dedup_fold(df))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 130)), min_size=1, max_size=60), st.integers(1, 40))
def test_segments_roll_one_entry_at_a_time(spark, entries, block):
    """A segment rolls before an entry that would exceed its size, unless it is empty; over gaps in offsets and block ends."""
    step, at, rows, want = random.Random(len(entries)), {}, [], {}
    held: dict[int, tuple[int, int]] = {}
    for p, size in entries:
        at[p] = at.get(p, -1) + step.choice((1, 1, 1, 9))
        segment, n = held.get(p, (0, 0))
        if n + size > 100 and n > 0:
            segment, n = segment + 1, 0
        held[p] = (segment, n + size)
        want[p, at[p]] = segment
        rows.append((p, at[p], b"x" * size))
    df = spark.createDataFrame(rows, "partition int, offset long, value binary").selectExpr("'t' AS topic", "*", "CAST(NULL AS BINARY) AS key").repartition(3)
    old, logs.BLOCK = logs.BLOCK, block
    try:
        assert {(r.partition, r.offset): r.segment_id for r in logs.with_segments(df, 100).collect()} == want
    finally:
        logs.BLOCK = old


def test_ten_entries_make_ten_segments(spark):
    df = spark.range(10).selectExpr("'t' AS topic", "0 AS partition", "id AS offset", "CAST(NULL AS BINARY) AS key", "CAST(repeat('x', 61) AS BINARY) AS value")
    assert sorted(r.segment_id for r in logs.with_segments(df, 100).collect()) == list(range(10))


def test_running_sums_in_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), i * 3 + rng.randrange(3), rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at long, n long")
    got = {r.at: r.run for r in ranges.running(df, ["k"], ["at"], F.col("n"), "run", width=17).collect()}
    sums: dict = {}
    for k, at, n in sorted(rows, key=lambda r: r[1]):
        sums[k] = sums.get(k, 0) + n
        assert got[at] == sums[k]


def legacy(magic, offset, key, value, ts=7, codec=0):
    field = lambda x: struct.pack(">i", -1) if x is None else struct.pack(">i", len(x)) + x
    tail = bytes([magic, codec]) + (struct.pack(">q", ts) if magic else b"") + field(key) + field(value)
    return struct.pack(">qiI", offset, 4 + len(tail), batches.message_crc(tail)) + tail


def test_record_batches():
    records = [batches.Record(None if i == 1 else b"k%d" % i, None if i == 2 else b"v" * i, 1_700_000_000_000 + i * 77, i, [("h", b"1"), ("é", b"")], (9, 2, 5)) for i in range(5)]
    for codec in range(5):
        got = batches.decode(batches.encode(records, codec, batches.TRANSACTIONAL, base_offset=40))
        assert [(x.key, x.value, x.timestamp, x.offset, x.headers, x.producer) for x in got] == [(x.key, x.value, x.timestamp, 40 + x.offset, x.headers, (9, 2, 5 + i)) for i, x in enumerate(records)]
        assert all(x.attributes == batches.TRANSACTIONAL for x in got)
    old = legacy(0, 3, None, b"a") + legacy(1, 4, b"k", None)
    assert [(x.key, x.value, x.timestamp, x.offset) for x in batches.decode(old + b"\0" * 9)] == [(None, b"a", 0, 3), (b"k", None, 7, 4)]
    inner = legacy(1, 0, b"a", b"1") + legacy(1, 1, b"b", b"2")
    assert [(x.key, x.offset) for x in batches.decode(legacy(1, 50, None, batches._stream("gzip", inner), codec=1))] == [(b"a", 49), (b"b", 50)]
    raw = pa.Codec("snappy").compress(b"x" * 50, asbytes=True)
    framed = b"\x82SNAPPY\x00" + struct.pack(">ii", 1, 1) + (struct.pack(">i", len(raw)) + raw) * 2
    assert batches.decompress(2, framed) == b"x" * 100
    whole = batches.encode(records)
    for bad in (whole[:-3], whole[:16] + b"\x07" + whole[17:], batches.encode(records, 4)[:61] + b"junk" * 20):
        with pytest.raises((ValueError, struct.error)):
            batches.decode(bad)
    for codec in (1, 2, 3, 4, 5):
        with pytest.raises(ValueError):
            batches.decompress(codec, b"\xff" * 9)


def test_bad_payloads_are_rows(spark):
    good = batches.encode([batches.Record(b"k", b"v", 5, producer=(1, 0, 0))], attributes=batches.CONTROL)
    df = spark.createDataFrame([("t", 0, 1, good), ("t", 0, 2, good[:40]), ("t", 0, 3, None)], "topic string, partition int, arrival_seq long, value binary")
    out = {r.arrival_seq: (r.error is None, r.is_control) for r in batches.decoded(df).collect()}
    assert out == {1: (True, True), 2: (False, False)}
    key = df.select("arrival_seq", batches.payload_key(F.col("value")).alias("k")).collect()
    assert all(r.k.key is None and not r.k.is_tombstone for r in key)


def test_share_group_bounds(spark):
    s = queues.SharePartition()
    assert s.acquire("m", 0, 9, 9, sizes={i: 10 for i in range(9)}, max_bytes=25) == [0, 1, 2]
    assert s.acquire("m", 0, 9, 9, frozenset({3, 4}), {i: 10 for i in range(9)}, 1) == [5] and s.records[3][0] == "archived"
    assert s.acknowledge("m", 0, 2, queues.GAP, 1) and s.start == 5 and s.records[0][4] is None


def test_restarts():
    reg = connectors.Connectors()
    reg.register("c", "S3ArchivalSinkConnector", {"topics": "t", "s3.bucket": "b", "tasks.max": "3"})
    states = lambda: (reg.status("c").state, [t.state[0] for t in reg.status("c").tasks])
    reg.fail("c", "lost")
    reg.fail("c", "disk full", task=1)
    reg.restart("c")
    assert states() == ("RUNNING", ["R", "F", "R"]) and reg.status("c").tasks[1].trace == "disk full"
    reg.stop("c")
    reg.fail("c", "again", task=2)
    reg.restart("c", include_tasks=True, only_failed=True)
    assert states() == ("STOPPED", ["S", "S", "R"])
    reg.restart_task("c", 0)
    assert states() == ("STOPPED", ["R", "S", "R"])
    with pytest.raises(KeyError):
        reg.restart_task("c", 3)


def test_sources_by_format(spark, tmp_path):
    spark.range(3).write.json(f"file://{tmp_path}/j")
    reg = connectors.Connectors()
    reg.register("r", "DatabaseCdcSourceConnector", {"db.host": "h", "format": "json", "path": f"file://{tmp_path}/j"})
    assert reg.read(spark, "r").count() == 3
    reg.pause("r")
    with pytest.raises(ValueError):
        reg.read(spark, "r")


def test_protobuf_fields():
    text = """syntax = "proto3"; // int32 no = 9;
    message M { /* string no = 8;
    */ string a = 1; repeated int64 b = 2 [packed = true]; map<string, Inner> c = 3; reserved 4; oneof x { bool d = 5; Inner e = 6; }
      option (o) = "string no = 7;"; enum E { ZERO = 0; } }"""
    assert schemas.proto_fields(text) == {"1": "string", "2": "int64", "3": "map<string,Inner>", "5": "bool", "6": "Inner"}


def test_transaction_states(spark):
    ev = [("a", i, e) for i, e in enumerate(["add", "offsets", "commit", "markers", "commit"])] + [("b", i, e) for i, e in enumerate(["add", "offsets", "timeout", "markers"])]
    out = {r[0]: tuple(r)[1:] for r in logops.transaction_states(spark.createDataFrame(ev, "transactional_id string, arrival_seq long, event string")).collect()}
    assert out == {"a": ("CompleteCommit", 0, 1, 1), "b": ("CompleteAbort", 1, 0, 0)}


def test_share_partition():
    s = queues.SharePartition(max_attempts=2, lock_ms=10)
    assert s.acquire("m", 0, 5, 3) == [0, 1, 2]
    assert not s.acknowledge("other", 0, 0, queues.ACCEPT, 1)
    assert not s.acknowledge("m", 0, 4, queues.ACCEPT, 1)  # all or nothing
    assert s.acknowledge("m", 0, 0, queues.ACCEPT, 1) and s.start == 1
    assert s.acknowledge("m", 1, 1, queues.RENEW, 5)
    s.expire(10)
    assert s.records[2][0] == "available" and s.records[1][0] == "acquired"
    assert s.acquire("m", 11, 5, 9) == [2, 3, 4]
    s.expire(100)
    assert s.records[2][0] == "archived" and s.records[2][4] == "delivery-limit-exceeded"
    assert s.acquire("m", 101, 7, 9, frozenset({5})) == [1, 3, 4, 6] and s.records[5][0] == "archived"


def test_sticky_assignment():
    held = {"a": {"t": [0, 1, 2, 3]}, "b": {"t": []}}
    out = groups.sticky_assignment({"t": 4}, {"a": {"t"}, "b": {"t"}}, held)
    assert out == {"a": {"t": [0, 1]}, "b": {"t": [2, 3]}}
    assert groups.sticky_assignment({"t": 5}, {"a": {"t"}, "b": {"t"}}, {}) == {"a": {"t": [0, 2, 4]}, "b": {"t": [1, 3]}}


def test_rack_placement():
    racks = {1: "x", 2: "x", 3: "y", 4: "z"}
    for got in groups.place_racks(6, racks, 3):
        assert len(set(got)) == 3 and len({racks[b] for b in got}) == 3
    assert all(len(set(r)) == 2 for r in groups.place_racks(4, {1: "x", 2: "x"}, 3))


AVRO = '{"type":"record","name":"O","fields":[{"name":"id","type":"string"},{"name":"n","type":"int"}%s]}'


def test_schema_compatibility():
    old, with_default, without = AVRO % "", AVRO % ',{"name":"s","type":"string","default":""}', AVRO % ',{"name":"s","type":"string"}'
    c = schemas.compatible
    assert c("AVRO", "BACKWARD", old, with_default) and not c("AVRO", "BACKWARD", old, without) and c("AVRO", "FORWARD", old, without)
    assert c("AVRO", "FULL", old, with_default) and c("AVRO", "NONE", old, "{}")
    wide = old.replace('"int"', '"long"')
    assert c("AVRO", "BACKWARD", old, wide) and not c("AVRO", "BACKWARD", wide, old)
    a, b = '{"properties":{"id":{"type":"integer"}}}', '{"properties":{"id":{"type":"integer"},"x":{"type":"string"}},"required":["x"]}'
    assert not c("JSON", "BACKWARD", a, b) and c("JSON", "FORWARD", a, b) and not c("JSON", "FORWARD", b, a)
    p = 'syntax = "proto3";\nmessage M {\n  string a = 1;\n  repeated int32 b = 2;\n}'
    assert c("PROTOBUF", "FULL", p, p.replace("string a = 1;", "string z = 1;\n int64 n = 3;")) and not c("PROTOBUF", "FULL", p, p.replace("int32", "int64"))


def test_registry():
    r = schemas.Registry()
    assert r.register("s", "AVRO", AVRO % "") == (1, 1) == r.register("s", "AVRO", (AVRO % "").replace(",", ", "))
    with pytest.raises(ValueError):
        r.register("s", "AVRO", AVRO % ',{"name":"s","type":"string"}')
    r.set_level("NONE", "s")
    assert r.register("s", "AVRO", AVRO % ',{"name":"s","type":"string"}') == (2, 2)
    assert r.get("s")["version"] == 2 and r.by_id(1)["type"] == "AVRO" and r.subjects() == ["s"]
    assert r.delete("s") == [1, 2] and r.level_of("s") == "BACKWARD" and r.test("s", "AVRO", AVRO % "")
    with pytest.raises(ValueError):
        schemas.canonical("AVRO", '{"name":"x"}')


def test_connectors():
    reg = connectors.Connectors()
    with pytest.raises(ValueError):
        reg.register("c", "S3ArchivalSinkConnector", {"topics": "t"})
    c = reg.register("c", "x.y.S3ArchivalSinkConnector", {"topics": "t,u", "s3.bucket": "b", "tasks.max": "2"})
    assert c.topics == {"t", "u"} and len(c.tasks) == 2
    reg.pause("c")
    assert reg.status("c").state == "PAUSED"
    assert connectors.validate("httpwebhooksinkconnector", {"tasks.max": "0"})["tasks.max"]
    assert connectors.topic_config_error({"retention.ms": "x"}) and connectors.topic_config_error({"no": "x"})
    assert connectors.topic_config_error({"retention.ms": "1_000"}) and connectors.topic_config_error({"retention.ms": " 5"})
    assert connectors.topic_config_error({"retention.ms": str(-(1 << 63)), "own.x": "y"}, own_prefix="own.") is None
    assert connectors.topic_config_error({"retention.ms": "5", "iceberg.enabled": "true", "min.cleanable.dirty.ratio": "0.5"}) is None


def test_hashes():
    assert hashing.crc32c(b"123456789") == 0xE3069283
    assert hashing.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert hashing.coordinator("g", [3, 1]) == [1, 3][hashing.fnv1a64(b"g") % 2]
    u = hashing.topic_uuid("events")
    assert u == hashing.topic_uuid("events") != hashing.topic_uuid("event") and u.variant == uuid.RFC_4122 and u.version == 8


def test_snapshot_table(spark, tmp_path):
    rows = [("events", 0, i, i, f"k{i}".encode(), b'{"user":"u%d","n":%d,"ok":true}' % (i, i)) for i in range(5)]
    rows += [("events", 0, 5, 5, None, b'{"user":"z","n":9}')]
    log = spark.createDataFrame(rows, "topic string, partition int, offset long, timestamp_ms long, key binary, value binary").withColumn("headers", F.lit(None).cast("array<struct<key:string,value:binary>>"))
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    fields = {"user": "string", "n": "long", "ok": "boolean"}
    assert t.commit(log.where("offset < 5"), fields)["added"] == 5
    assert t.commit(log, fields)["total"] == 6
    assert t.commit(log, fields) is None
    assert t.read().count() == 6 and t.read(1).count() == 5 and t.read().where("ok IS NULL").count() == 1
    capped = SnapshotTable(spark, f"file://{tmp_path}/c")
    assert [capped.commit(log, max_rows=4)["added"], capped.commit(log, max_rows=4)["added"]] == [4, 2]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.fixed_dictionaries({"a": st.integers(-(1 << 62), 1 << 62), "b": st.none() | st.text(max_size=5), "c": st.lists(st.booleans(), max_size=3), "d": st.dictionaries(st.text(max_size=3), st.floats(allow_nan=False), max_size=2), "e": st.fixed_dictionaries({"f": st.binary(max_size=4)})}), max_size=5))
def test_avro_round_trip(rows):
    inner = {"type": "record", "name": "i", "fields": [{"name": "f", "type": "bytes"}]}
    kinds = {"a": "long", "b": ["null", "string"], "c": {"type": "array", "items": "boolean"}, "d": {"type": "map", "values": "double"}, "e": inner}
    schema = {"type": "record", "name": "r", "fields": [{"name": k, "type": t} for k, t in kinds.items()]}
    got, head = avro.read(avro.write(schema, rows, {"x": "y"}))
    assert got == rows and head["x"] == b"y" and json.loads(head["avro.schema"]) == schema


def test_table_metadata(spark, tmp_path):
    """Documents of every version, manifests and lists that name each other, field ids in the files, one writer of two."""
    log = spark.range(10).selectExpr("'t' AS topic", "CAST(id % 2 AS INT) AS partition", "id div 2 AS offset", "id AS timestamp_ms", "CAST(NULL AS BINARY) AS key", "CAST(concat('{\"n\":', id, '}') AS BINARY) AS value")
    log = log.withColumn("headers", F.lit(None).cast("array<struct<key:string,value:binary>>"))
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    assert t.metadata() is None and t.snapshots().count() == 0
    for part in (log.where("offset < 2"), log.where("offset < 4"), log):
        t.commit(part, {"n": "long"})
    meta = json.loads((tmp_path / "t/metadata/v3.metadata.json").read_text())
    assert (tmp_path / "t/metadata/version-hint.text").read_text() == "3" and meta["format-version"] == 2
    assert [f["id"] for f in meta["schemas"][0]["fields"]] == [1, 2, 3, 4, 5, 6, 10]
    assert [(s["sequence-number"], s["summary"]["added-records"], s["summary"]["total-records"]) for s in meta["snapshots"]] == [(1, "4", "4"), (2, "4", "8"), (3, "2", "10")]
    assert meta["snapshots"][2]["parent-snapshot-id"] == meta["snapshots"][1]["snapshot-id"] and meta["current-snapshot-id"] == meta["snapshots"][2]["snapshot-id"]
    assert json.loads(meta["properties"][t.OFFSETS]) == {"t/0": 5, "t/1": 5}
    lists = [avro.read(t.files.read(s["manifest-list"]))[0] for s in meta["snapshots"]]
    assert [len(x) for x in lists] == [1, 2, 3] and lists[2][:2] == lists[1] and [m["added_rows_count"] for m in lists[2]] == [4, 4, 2]
    entries = [e["data_file"] for m in lists[2] for e in avro.read(t.files.read(m["manifest_path"]))[0]]
    assert sum(e["record_count"] for e in entries) == 10 and [e["file_path"] for e in entries] == t.data_files()
    for e in entries:
        local = e["file_path"].split(":", 1)[1].replace("//", "")
        schema = pq.read_schema(local)
        assert os.path.getsize(local) == e["file_size_in_bytes"] and {f.name: int(f.metadata[b"PARQUET:field_id"]) for f in schema if f.name != "topic"} == {"partition": 1, "offset": 2, "timestamp": 3, "key": 4, "value": 5, "headers": 6, "n": 10}
        assert schema.field("timestamp").type == pa.timestamp("us", "UTC")
    assert t.read(2).count() == 8 and t.snapshots().agg(F.sum("added")).first()[0] == 10
    with pytest.raises(Exception, match="exist"):  # a second writer of the same version
        t.files.write(f"{t.path}/metadata/v3.metadata.json", b"{}")


def test_written_log_in_each_codec(spark, tmp_path):
    rows = spark.range(50).selectExpr("'t' AS topic", "CAST(id % 2 AS INT) AS partition", "id AS arrival_seq", "CAST(CAST(id AS STRING) AS BINARY) AS value")
    log = logs.append(None, rows)
    for codec in ("none", "snappy", "gzip", "lz4", "zstd"):
        logs.write(log, f"file://{tmp_path}/{codec}", codec)
        assert spark.read.parquet(f"file://{tmp_path}/{codec}").agg(F.sum("offset")).first()[0] == 2 * sum(range(25))


def test_offload_is_repeated_safely(spark, tmp_path):
    log = spark.range(30).selectExpr("'t' AS topic", "0 AS partition", "id AS offset", "CAST(NULL AS BINARY) AS key", "CAST(repeat('x', 30) AS BINARY) AS value")
    seg = logs.with_segments(log, 100)
    for _ in range(2):
        assert logs.offload(seg, f"file://{tmp_path}/cold").agg(F.sum("entries"), F.count("*")).first() == (27, 9)
    back = spark.read.schema(seg.schema).parquet(f"file://{tmp_path}/cold").drop("segment_id")
    both = logs.with_archive(log.where("offset >= 20"), back)
    assert sorted(r.offset for r in both.collect()) == list(range(30))


def test_log_round_trip(spark, tmp_path):
    rows = spark.range(20).selectExpr("'t' AS topic", "CAST(id % 2 AS INT) AS partition", "id AS arrival_seq", "CAST(id AS STRING) AS v")
    log = logs.append(None, rows)
    assert sorted(r.offset for r in log.where("partition = 1").collect()) == list(range(10))
    assert logs.valid_topic("a.b-c_1") and not logs.valid_topic("..") and not logs.valid_topic("a b")
