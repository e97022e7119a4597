"""Registered queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import jsonpath as J
from rivulet.operators import acl, connectors, filters, groups, joins, logops, queues, quotas, reports, schemas, transforms, windows
from rivulet.operators.ranges import numbered, running
from rivulet.operators.windows import WindowSpec
from rivulet.plans import jobs
from rivulet.sources import batches
from rivulet.sources import log as logs
from rivulet.sources import tables
from rivulet.session import scratch_root, ship

HOUR, DAY = 3_600_000, 86_400_000
NOW = 1_710_000_000_000  # a fixed clock for ages and locks
SEGMENT = 20_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The log view in DuckDB: same partitions, offsets and JSON values as ``logs.events``.
EV = """ev AS (SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, user_id, event_type, value, props, CAST(user_id % 4 AS INTEGER) AS part,
  row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS off, CAST(user_id AS VARCHAR) AS key,
  '{"user":"' || user_id || '","type":"' || event_type || '","amt":' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ',"props":' || props || '}' AS body,
  CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS amt FROM events)"""
#: The same events as if they had arrived out of order.
LATE = EV + """, ooo AS (SELECT *, row_number() OVER (ORDER BY ts_ms + (event_id * 7919 % 11) * 3600000, event_id) AS arr FROM ev),
st AS (SELECT *, max(ts_ms) OVER (ORDER BY arr ROWS UNBOUNDED PRECEDING) AS stt FROM ooo)"""
#: Segments: from each start the next is the first entry that would exceed the size (or, after an entry that
#: exceeds it alone, the one after it); starts are followed from offset 0.
SEG = EV + f""", lg AS (SELECT part, off, ts_ms, key, CASE WHEN event_id % 10 = 0 THEN '' ELSE body END AS body FROM ev),
lb AS MATERIALIZED (SELECT *, strlen(key) + strlen(body) AS bytes, CAST(sum(strlen(key) + strlen(body)) OVER (PARTITION BY part ORDER BY off) AS BIGINT) AS upto FROM lg),
nx AS MATERIALIZED (SELECT a.part, a.off, greatest(b.off, a.off + 1) AS nxt FROM (SELECT *, upto - bytes + {SEGMENT} AS most FROM lb) a ASOF JOIN lb b ON a.part = b.part AND a.most < b.upto),
sb AS (SELECT part, 0::BIGINT AS off, 0::BIGINT AS seg FROM (SELECT DISTINCT part FROM lb) UNION ALL SELECT nx.part, nx.nxt, sb.seg + 1 FROM sb JOIN nx ON nx.part = sb.part AND nx.off = sb.off),
sg AS (SELECT lb.*, sb.seg FROM lb ASOF JOIN sb ON lb.part = sb.part AND lb.off >= sb.off)"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, d: (ship(spark), f(spark, d))[1]
        if sql:
            SQL[name] = sql
        return f

    return add


def ordered(spark: SparkSession, d: str) -> DataFrame:
    """(arrival_seq, key, ts, x) in order of time."""
    e = logs.events(spark, d)
    amt = J.to_double(J.get(J.parse(F.col("value")), "amt"))
    return e.select("arrival_seq", F.col("key").cast("string").alias("key"), F.col("timestamp_ms").alias("ts"), amt.alias("x"))


def disordered(spark: SparkSession, d: str) -> DataFrame:
    """The same rows arriving up to ten hours late; arrival is a dense rank of the delayed time, counted in ranges of it."""
    rows = ordered(spark, d)
    rows = rows.withColumn("delayed", F.col("ts") + (F.col("arrival_seq") * 7919 % 11) * HOUR)
    return numbered(rows, [], ["delayed", "arrival_seq"], "arrival", DAY).select(F.col("arrival").alias("arrival_seq"), "key", "ts", "x")


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    """Sums and averages to six places: the order of addition differs between engines."""
    return df.select(*keys, "count", F.round("sum", 6).alias("sum"), "min", "max", F.round("avg", 6).alias("avg"))


AGG = "count(*) AS count, round(sum(amt), 6) AS sum, min(amt) AS min, max(amt) AS max, round(avg(amt), 6) AS avg"

# ---- scans -------------------------------------------------------------------------------


@query("log_scan_from_offset", f"WITH {EV} SELECT part AS partition, off AS offset, key, body AS value FROM ev WHERE part = 1 AND off >= 100 ORDER BY off LIMIT 1")
def log_scan_from_offset(spark, d):
    r = logs.read_one(logs.events(spark, d), "events", 1, 100)
    return r.select("partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(
    "log_range_bytes",
    f"""WITH {EV}, r AS (SELECT part, off, strlen(key) + strlen(body) AS length, sum(strlen(key) + strlen(body)) OVER (PARTITION BY part ORDER BY off) AS run,
    row_number() OVER (PARTITION BY part ORDER BY off) AS rn FROM ev WHERE off >= 50 AND off < 500)
    SELECT part AS partition, off AS offset, CAST(length AS BIGINT) AS length FROM r WHERE run <= 4096 OR rn = 1""",
)
def log_range_bytes(spark, d):
    return logs.range_entries(logs.events(spark, d), 50, 500, 4096).select("partition", "offset", "length")


@query(
    "log_fetch_budget",
    f"""WITH {EV}, r AS (SELECT part, off, strlen(key) + strlen(body) AS n FROM ev WHERE off >= 10 * part),
    s AS (SELECT *, sum(n) OVER (ORDER BY part, off) AS run, row_number() OVER (ORDER BY part, off) AS rn FROM r) SELECT part AS partition, off AS offset FROM s WHERE run <= 10000 OR rn = 1""",
)
def log_fetch_budget(spark, d):
    positions = spark.createDataFrame([("events", p, 10 * p) for p in range(4)], "topic string, partition int, fetch_offset long")
    return logs.fetch(logs.events(spark, d), positions, 10_000).select("partition", "offset")


@query("log_earliest_latest", f"WITH {EV} SELECT part AS partition, min(off) AS earliest, max(off) + 1 AS latest FROM ev GROUP BY part")
def log_earliest_latest(spark, d):
    return logs.earliest_latest(logs.events(spark, d)).drop("topic")


@query(
    "log_offset_for_time",
    f"WITH {EV}, m AS (SELECT max(ts_ms) - {DAY} AS t FROM ev) SELECT part AS partition, coalesce(min(off) FILTER (ts_ms >= t), -1) AS offset, coalesce(arg_min(ts_ms, off) FILTER (ts_ms >= t), -1) AS timestamp_ms FROM ev, m GROUP BY part",
)
def log_offset_for_time(spark, d):
    e = logs.events(spark, d)
    last = e.agg(F.max("timestamp_ms")).first()[0]
    return logs.offset_for_time(e, last - DAY).drop("topic")


@query("log_inspect_limit", f"WITH {EV} SELECT off AS offset, ts_ms AS timestamp_ms, key, body AS value FROM ev WHERE part = 2 AND off >= 5 ORDER BY off LIMIT 50")
def log_inspect_limit(spark, d):
    return logs.inspect(logs.events(spark, d), "events", 2, 5, limit=500).drop("headers")


@query(
    "archive_union",
    f"WITH {EV} SELECT part AS partition, count(*) AS n, sum(off)::BIGINT AS offsets FROM ev GROUP BY part",
)
def archive_union(spark, d):
    e = logs.events(spark, d)
    both = logs.with_archive(e.where("offset >= 200"), e.where("offset < 300"))
    return both.groupBy("partition").agg(F.count("*").alias("n"), F.sum("offset").alias("offsets"))


@query("append_offsets", f"WITH {EV} SELECT part AS partition, count(*) AS n, max(off) AS last, count(DISTINCT off) AS offsets FROM ev GROUP BY part")
def append_offsets(spark, d):
    e = logs.events(spark, d)
    old, new = e.where("offset < 100"), e.where("offset >= 100")
    both = old.unionByName(logs.append(old, new).select(*old.columns))
    return both.groupBy("partition").agg(F.count("*").alias("n"), F.max("offset").alias("last"), F.countDistinct("offset").alias("offsets"))


@query(
    "retention_segments",
    f"""WITH RECURSIVE {SEG}, t AS (SELECT part, seg, sum(bytes) AS b FROM sg GROUP BY ALL), k AS (SELECT *, sum(b) OVER (PARTITION BY part ORDER BY seg DESC) AS after, row_number() OVER (PARTITION BY part ORDER BY seg DESC) AS rn FROM t)
    SELECT sg.part AS partition, count(*) AS n, min(off) AS first_offset FROM sg JOIN k USING (part, seg) WHERE after <= 60000 OR rn = 1 GROUP BY sg.part""",
)
def retention_segments(spark, d):
    kept = logs.retain(segmented(spark, d), 60_000, None, NOW)
    return kept.groupBy("partition").agg(F.count("*").alias("n"), F.min("offset").alias("first_offset"))


def segmented(spark, d) -> DataFrame:
    """The log with a tombstone for every tenth event, in small segments."""
    e = logs.events(spark, d)
    e = e.withColumn("value", F.when(F.col("arrival_seq") % 10 == 0, F.lit(b"")).otherwise(F.col("value")))
    return logs.with_segments(e, SEGMENT)


@query(
    "log_segment_range",
    f"""WITH RECURSIVE {SEG}, f AS (SELECT part, min(seg) AS seg, min(off) AS first FROM sg WHERE off >= 60 GROUP BY part),
    r AS (SELECT sg.part, off, sg.seg, f.first, sum(bytes) OVER (PARTITION BY sg.part ORDER BY off) AS run FROM sg JOIN f ON sg.part = f.part AND sg.off >= 60 AND off < 2000 WHERE sg.seg >= f.seg)
    SELECT r.part AS partition, off AS offset FROM r JOIN f ON r.part = f.part AND r.seg = f.seg WHERE run <= 9000 OR off = r.first""",
)
def log_segment_range(spark, d):
    """Entries from 60 on of one segment, at most 9,000 bytes."""
    e = segmented(spark, d).drop("segment_id")
    return logs.read_range(e, 60, 2000, 9000, SEGMENT).select("partition", "offset")


MARKS = EV + ", mk AS (SELECT part, (max(off) + 1) * (part + 1) // 5 AS mark FROM ev GROUP BY part)"


def marks(spark, d) -> DataFrame:
    """A high watermark that lies a part of the way into each partition."""
    return logs.earliest_latest(logs.events(spark, d)).selectExpr("topic", "partition", "latest * (partition + 1) div 5 AS high_watermark")


@query("log_to_high_watermark", f"WITH {MARKS}, r AS (SELECT ev.part, off, sum(strlen(key) + strlen(body)) OVER (PARTITION BY ev.part ORDER BY off) AS run FROM ev JOIN mk USING (part) WHERE off >= 3 AND off < mark) SELECT part AS partition, off AS offset FROM r WHERE run <= 20000 OR off = 3")
def log_to_high_watermark(spark, d):
    return logs.read_to_mark(logs.events(spark, d), 3, marks(spark, d), 20_000).select("partition", "offset")


@query("log_read_below", f"WITH {EV} SELECT part AS partition, off AS offset FROM ev WHERE part = 1 AND off = 8 AND 8 < 9")
def log_read_below(spark, d):
    """One entry below a mark; past the mark there is none."""
    e = logs.events(spark, d)
    return logs.read_one(e, "events", 1, 8, below=9).unionByName(logs.read_one(e, "events", 1, 9, below=9)).select("partition", "offset")


@query("log_replica_fetch", f"WITH {EV}, f AS (SELECT part, b AS broker_id, b * 10 + part AS fo FROM (SELECT DISTINCT part FROM ev), (VALUES (1), (2)) t(b)), r AS (SELECT f.part, broker_id, fo, off, sum(strlen(key) + strlen(body)) OVER (PARTITION BY f.part, broker_id ORDER BY off) AS run FROM f JOIN ev ON ev.part = f.part AND off >= fo) SELECT part AS partition, broker_id, off AS offset FROM r WHERE run <= 3000 OR off = fo")
def log_replica_fetch(spark, d):
    e = logs.events(spark, d)
    f = e.select("topic", "partition").distinct().withColumn("broker_id", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("fetch_offset", (F.col("broker_id") * 10 + F.col("partition")).cast("long"))
    return logs.replica_fetch(e, f, 3000)[0].select("partition", "broker_id", "offset")


@query("log_ingest", f"WITH {EV} SELECT key, count(*) AS n, max(event_id) AS last FROM (SELECT key, event_id FROM ev UNION ALL SELECT '7', (SELECT max(event_id) + 1 FROM ev)) GROUP BY key")
def log_ingest(spark, d):
    log = logs.ingest(logs.events(spark, d), spark, "events", "7", '{"user":"7","amt":1}', NOW)
    return log.groupBy(F.col("key").cast("string").alias("key")).agg(F.count("*").alias("n"), F.max("arrival_seq").alias("last"))


@query("append_record_counts", f"WITH {EV} SELECT part AS partition, off AS n, CAST(sum(greatest(event_id % 4, 1)) OVER (PARTITION BY part ORDER BY off) - greatest(event_id % 4, 1) AS BIGINT) AS offset FROM ev")
def append_record_counts(spark, d):
    """Batches of 0 to 3 records take the offsets of their records, one at least."""
    rows = logs.events(spark, d).withColumn("n", F.col("offset")).withColumn("record_count", F.col("arrival_seq") % 4)
    return logs.append(None, rows).select("partition", "n", "offset")


@query("tier_offload", f"WITH RECURSIVE {SEG}, l AS (SELECT part, max(seg) AS last FROM sg GROUP BY part) SELECT sg.part AS partition, seg AS segment_id, count(*) AS entries FROM sg JOIN l ON l.part = sg.part AND seg < last GROUP BY sg.part, seg")
def tier_offload(spark, d):
    """Sealed segments copied to an archive, the second time without effect."""
    import uuid

    archive = f"{scratch_root(spark)}/archive-{uuid.uuid4().hex}"
    seg = segmented(spark, d)
    logs.offload(seg, archive)
    return logs.offload(seg, archive, "gzip").select("partition", "segment_id", "entries")


@query(
    "decode_batches",
    f"""WITH {EV} SELECT part AS partition, off AS offset, key, body AS value, ts_ms AS timestamp_ms, 'type=' || event_type AS headers, user_id % 8 AS producer_id, CAST(off AS INTEGER) AS sequence FROM ev""",
)
def decode_batches(spark, d):
    """The log as batches of five records in each codec in turn, decoded again."""
    out = batches.decoded(payloads(spark, d)).where("error IS NULL")
    heads = F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string"))), ",")
    return out.select("partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "timestamp_ms", heads.alias("headers"), "producer_id", "sequence")


def payloads(spark, d) -> DataFrame:
    """Encoded batches of up to five entries that are next to each other and of one producer."""
    e = logs.events(spark, d)
    rows = e.groupBy("topic", "partition", F.expr("offset div 5").alias("b"), "producer_id").agg(F.sort_array(F.collect_list(F.struct("offset", "key", "value", "timestamp_ms", F.expr("headers[0].value").alias("kind")))).alias("r"))
    rows = rows.withColumn("arrival_seq", F.expr("r[0].offset"))

    @F.pandas_udf("binary")
    def pack(parts: pd.Series, first: pd.Series, producer: pd.Series) -> pd.Series:
        def one(r, at, pid) -> bytes:
            made = [batches.Record(x["key"], x["value"], int(x["timestamp_ms"]), headers=[("type", x["kind"])], producer=(int(pid), 0, int(x["offset"]))) for x in r]
            return b"".join(batches.encode([x], int(at) % 5, base_offset=x.producer[2]) for x in made) if int(at) % 2 else joined(made, int(at))

        def joined(made, at) -> bytes:
            """Runs of offsets without a gap are one batch each."""
            out, run = b"", []
            for x in made:
                if run and x.producer[2] != run[-1].producer[2] + 1:
                    out += batches.encode(run, at % 5, base_offset=run[0].producer[2])
                    run = []
                run.append(x)
            return out + batches.encode(run, at % 5, base_offset=run[0].producer[2])

        return pd.Series([one(*x) for x in zip(parts, first, producer, strict=True)])

    return rows.select("topic", "partition", "arrival_seq", pack("r", "arrival_seq", "producer_id").alias("value"))


@query(
    "payload_keys",
    f"""WITH {EV} SELECT event_id, CASE WHEN event_id % 5 < 3 THEN key END AS key, CASE WHEN event_id % 5 < 3 THEN event_id % 2 = 0 ELSE FALSE END AS is_tombstone, CASE WHEN event_id % 5 = 0 THEN ts_ms END AS timestamp_ms FROM ev""",
)
def payload_keys(spark, d):
    """Keys of raw payloads in three layouts, of text without one, and of a payload cut short."""
    e = logs.events(spark, d)
    size = lambda x: F.unhex(F.lpad(F.hex(F.octet_length(x)), 8, "0"))
    value = F.when(F.col("arrival_seq") % 2 == 0, F.lit(b"")).otherwise(F.col("value"))
    pair = F.concat(size(F.col("key")), F.col("key"), size(value), value)
    time = F.unhex(F.lpad(F.hex("timestamp_ms"), 16, "0"))
    kind = F.col("arrival_seq") % 5
    raw = F.when(kind == 0, F.concat(time, pair)).when(kind == 1, pair).when(kind == 2, F.concat(F.lit(b"AEKV"), pair)).when(kind == 3, F.col("value")).otherwise(F.substring(pair, F.lit(1), F.octet_length(pair) - 1))
    k = batches.payload_key(raw)
    return e.select(F.col("arrival_seq").alias("event_id"), k.alias("k")).select("event_id", F.col("k.key").cast("string").alias("key"), "k.is_tombstone", "k.timestamp_ms")


@query(
    "topic_names",
    """SELECT n AS name, regexp_full_match(n, '[A-Za-z0-9._-]{1,249}') AND n NOT IN ('.', '..') AS valid FROM (SELECT DISTINCT event_type AS n FROM events UNION SELECT unnest(['.', '..', 'a b', 'ok-1._', '', 'é']))""",
)
def topic_names(spark, d):
    n = logs.events(spark, d).select(F.expr("headers[0].value").cast("string").alias("name"))
    more = spark.createDataFrame([(x,) for x in (".", "..", "a b", "ok-1._", "", "é")], "name string")
    return n.union(more).distinct().select("name", logs.valid_topic_column(F.col("name")).alias("valid"))


# ---- filters -----------------------------------------------------------------------------

FILTERS = {
    "filter_eq_ci": ('type == "PURCHASE"', "lower(json_extract_string(body, '$.type')) = 'purchase'"),
    "filter_ne_missing": ("payload.no_such != 5", "coalesce(json_extract_string(body, '$.no_such') <> '5', TRUE)"),
    "filter_eq_missing": ("no_such == 5", "coalesce(json_extract_string(body, '$.no_such') = '5', FALSE)"),
    "filter_numeric": ("amt >= 25.5", "amt >= 25.5"),
    "filter_numeric_eq": ("props.k != 7", "CAST(json_extract(body, '$.props.k') AS DOUBLE) <> 7"),
    "filter_contains": ('type contains "IC"', "contains(lower(event_type), 'ic')"),
    "filter_nested_json": ("record.props.k > 50", "CAST(json_extract(body, '$.props.k') AS DOUBLE) > 50"),
    "filter_key_case": ("PROPS.K <= 10", "CAST(json_extract(body, '$.props.k') AS DOUBLE) <= 10"),
    "filter_operator_order": ('type contains "a>b" != 1', "TRUE"),
}
for _name, (_text, _sql) in FILTERS.items():
    query(_name, f"WITH {EV} SELECT event_id FROM ev WHERE {_sql}")(
        lambda spark, d, t=_text: filters.filter_log(logs.events(spark, d), t).select(F.col("arrival_seq").alias("event_id"))
    )


@query("filter_non_blank", f"WITH {EV} SELECT event_id, body FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN NULL ELSE event_type END AS body FROM ev) WHERE trim(body) <> ''")
def filter_non_blank(spark, d):
    e = logs.events(spark, d)
    kind = F.expr("headers[0].value").cast("string")
    body = F.when(F.col("arrival_seq") % 4 == 0, "").when(F.col("arrival_seq") % 4 == 1, "   ").when(F.col("arrival_seq") % 4 == 3, kind)
    return e.select(F.col("arrival_seq").alias("event_id"), body.alias("body")).where(filters.not_blank(F.col("body")))


# ---- projections -------------------------------------------------------------------------


@query(
    "project_typed_json",
    f"""WITH {EV} SELECT part AS partition, off AS offset, json_extract_string(body, '$.user') AS user, CAST(trunc(amt) AS BIGINT) AS n, amt,
    '{{"k":' || json_extract_string(body, '$.props.k') || '}}' AS props, CAST(NULL AS BOOLEAN) AS type, CAST(NULL AS BIGINT) AS missing,
    '[{{"key":"type","value":"' || event_type || '"}}]' AS headers FROM ev""",
)
def project_typed_json(spark, d):
    e = logs.events(spark, d)
    fields = {"user": "string", "n": ("amt", "long"), "amt": "double", "props": "string", "type": "boolean", "missing": "long"}
    return tables.project(e, fields).select("partition", "offset", "user", "n", "amt", "props", "type", "missing", "headers")


VALUES = ("1", "1.5", '"7"', '"x"', "true", "false", "null", '{"b":1,"a":2}', "[1,2]", "4294967297", "-3.9", "1e3")


@query(
    "project_value_types",
    """SELECT * FROM (VALUES (0, '1', 1, 1, 1.0::DOUBLE, NULL::BOOLEAN), (1, '1.5', 1, 1, 1.5, NULL), (2, '7', NULL, NULL, NULL, NULL), (3, 'x', NULL, NULL, NULL, NULL),
    (4, 'true', NULL, NULL, NULL, TRUE), (5, 'false', NULL, NULL, NULL, FALSE), (6, NULL, NULL, NULL, NULL, NULL), (7, '{"a":2,"b":1}', NULL, NULL, NULL, NULL), (8, '[1,2]', NULL, NULL, NULL, NULL),
    (9, '4294967297', 4294967297, 1, 4294967297.0, NULL), (10, '-3.9', -3, -3, -3.9, NULL), (11, '1000', 1000, 1000, 1000.0, NULL)) t(i, s, l, n, f, b)""",
)
def project_value_types(spark, d):
    rows = spark.createDataFrame([(i, f'{{"x":{v}}}') for i, v in enumerate(VALUES)], "i int, value string")
    v = J.parse(F.col("value"))
    return rows.select("i", *[J.typed(v, "x", k).alias(n) for n, k in (("s", "string"), ("l", "long"), ("n", "int"), ("f", "double"), ("b", "boolean"))])


@query("mask_pii_flat", f"""WITH {EV} SELECT event_id, '{{"amt":' || regexp_replace(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), '[.]?0+$', '') || ',"props":"***","type":"' || event_type || '","user":"***"}}' AS body FROM ev""")
def mask_pii_flat(spark, d):
    e = logs.events(spark, d)
    return e.select(F.col("arrival_seq").alias("event_id"), transforms.mask_flat(F.col("value"), "User, props").alias("body"))


@query("mask_pii_nested", f"""WITH {EV} SELECT event_id, '{{"list":[{{"Email ":"***"}},1],"props":{{"k":"***"}},"user":"' || user_id || '"}}' AS body FROM ev""")
def mask_pii_nested(spark, d):
    text = F.concat(F.lit('{"user":"'), F.col("key").cast("string"), F.lit('","props":{"k":'), (F.col("arrival_seq") % 7).cast("string"), F.lit('},"list":[{"Email ":{"a":1}},1]}'))
    return logs.events(spark, d).select(F.col("arrival_seq").alias("event_id"), transforms.mask_nested("K,email")(text).alias("body"))


@query(
    "json_map_rename_remove",
    f"""WITH {EV} SELECT event_id, '{{"_engine":"rivulet","_transformed_at":"2024-01-01T00:00:00Z","kind":"' || event_type || '","region":"us-east-1","team":"core","user":"' || user_id || '"}}' AS body FROM ev""",
)
def json_map_rename_remove(spark, d):
    config = {"add_fields": "team:core,region:nowhere", "set_region": "us-east-1", "rename_fields": "type:kind,none:gone", "remove_fields": "amt, props"}
    m = transforms.JsonMap.of(config, now="2024-01-01T00:00:00Z")
    return logs.events(spark, d).select(F.col("arrival_seq").alias("event_id"), m(F.col("value")).alias("body"))


@query(
    "json_map_indented",
    f"""WITH {EV} SELECT event_id, '{{' || chr(10) || '  "list": [' || chr(10) || '    1,' || chr(10) || '    {{' || chr(10) || '      "k": ' || event_id || chr(10) || '    }},' || chr(10) || '    []' || chr(10) || '  ],' || chr(10)
      || '  "note": "a\\u003cb\\u0026{{:,",' || chr(10) || '  "who": "' || user_id || '"' || chr(10) || '}}' AS body FROM ev""",
)
def json_map_indented(spark, d):
    """A registered transform's output over a whole topic: sorted keys, two spaces a level, marks escaped."""
    text = F.concat(F.lit('{"user":"'), F.col("key").cast("string"), F.lit('","note":"a<b&{:,","list":[1,{"k":'), F.col("arrival_seq").cast("string"), F.lit("},[]]}"))
    t = transforms.Transform("m", "JSON_MAP", "events", "out", {"rename_fields": "user:who"})
    out = t.run(logs.events(spark, d).withColumn("value", text.cast("binary")))
    return out.select(F.col("arrival_seq").alias("event_id"), F.col("value").cast("string").alias("body"))


@query(
    "run_module",
    f"""WITH {EV} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '// WASM Processed by m' || chr(10) || event_type
      ELSE '{{"TYPE":"' || event_type || '","_wasm_execution":{{"execution_us":48,"gas_used":318,"runtime":"wazero-wasm32-wasi","source_module":"m","status":"COMPLETED"}}}}' END AS body FROM ev""",
)
def run_module(spark, d):
    kind = F.expr("headers[0].value").cast("string")
    text = F.when(F.col("arrival_seq") % 3 == 0, kind).otherwise(F.concat(F.lit('{"type":"'), kind, F.lit('"}')))
    return logs.events(spark, d).select(F.col("arrival_seq").alias("event_id"), transforms.run_module(text, "m", "uppercase_keys").alias("body"))


@query("uppercase_keys", f"""WITH {EV} SELECT event_id, '{{"TYPE":"' || event_type || '","USER":"' || user_id || '"}}' AS body FROM ev""")
def uppercase_keys(spark, d):
    text = F.concat(F.lit('{"user":"'), F.col("key").cast("string"), F.lit('","type":"'), F.expr("headers[0].value").cast("string"), F.lit('"}'))
    return logs.events(spark, d).select(F.col("arrival_seq").alias("event_id"), transforms.uppercase_keys(text).alias("body"))


@query("map_upper", f"WITH {EV} SELECT event_id, upper(body) AS body FROM ev")
def map_upper(spark, d):
    return logs.events(spark, d).select(F.col("arrival_seq").alias("event_id"), transforms.map_upper(F.col("value")).alias("body"))


@query("payload_sha256", f"WITH {EV} SELECT event_id, sha256(body) AS sha256, substr(body, 1, 100) AS preview, length(body) AS length FROM ev")
def payload_sha256(spark, d):
    return logs.events(spark, d).select(F.col("arrival_seq").alias("event_id"), transforms.checksum(F.col("value")).alias("c")).select("event_id", "c.*")


@query("exactly_once_map", f"""WITH {EV} SELECT event_id, 'EOS_PROCESSED::' || body || '::TXN_' || event_id // 50 AS data, sha256('EOS_PROCESSED::' || body || '::TXN_' || event_id // 50) AS checksum, sha256(body) AS source_checksum FROM ev""")
def exactly_once_map(spark, d):
    c = transforms.exactly_once(F.col("value"), F.expr("arrival_seq div 50"))
    return logs.events(spark, d).select(F.col("arrival_seq").alias("event_id"), c.alias("c")).select("event_id", "c.*")


# ---- windows -----------------------------------------------------------------------------

TUMBLE = f"WITH {EV} SELECT key, CAST(floor(ts_ms / {DAY}.0) AS BIGINT) * {DAY} AS window_start, CAST(floor(ts_ms / {DAY}.0) AS BIGINT) * {DAY} + {DAY} AS window_end"
FIXED = {"count": "count(*)::DOUBLE", "sum": "round(sum(amt), 6)", "min": "min(amt)", "max": "max(amt)", "avg": "round(avg(amt), 6)"}


def tumbling_job(agg: str) -> jobs.JobConfig:
    return jobs.JobConfig("daily", "AGGREGATE", "events", key_field="user", value_field="amt", agg=agg, window=WindowSpec("tumbling", DAY), grace_ms=DAY * 3650)


for _agg, _sql in FIXED.items():
    query(f"agg_tumbling_{_agg}", f"{TUMBLE}, {_sql} AS value FROM ev GROUP BY ALL")(
        lambda spark, d, a=_agg: jobs.run(logs.events(spark, d), tumbling_job(a)).select("key", "window_start", "window_end", F.round("value", 6).alias("value"))
    )


@query("agg_tumbling_all", f"{TUMBLE}, {AGG} FROM ev GROUP BY ALL")
def agg_tumbling_all(spark, d):
    """The flagship: all five aggregates per user and day, one partial and one final aggregation."""
    return rounded(windows.fixed(ordered(spark, d), WindowSpec("tumbling", DAY)), "key", "window_start", "window_end")


HOP = "unnest(list_filter(list_transform(range(0, ({0} - 1) // {1} + 1), lambda i: CAST(floor({2} / {1}.0) AS BIGINT) * {1} - i * {1}), lambda s: s > {2} - {0}))"


@query("agg_hopping_sum", f"WITH {EV}, h AS (SELECT key, amt, {HOP.format(5 * HOUR, 2 * HOUR, 'ts_ms')} AS window_start FROM ev) SELECT key, window_start, window_start + {5 * HOUR} AS window_end, {AGG} FROM h GROUP BY ALL")
def agg_hopping_sum(spark, d):
    return rounded(windows.fixed(ordered(spark, d), WindowSpec("hopping", 5 * HOUR, 2 * HOUR)), "key", "window_start", "window_end")


@query(
    "agg_sliding_count",
    f"""WITH {EV}, w AS (SELECT DISTINCT key, ts_ms, count(*) OVER r AS count, round(sum(amt) OVER r, 6) AS sum, min(amt) OVER r AS min, max(amt) OVER r AS max, round(avg(amt) OVER r, 6) AS avg FROM ev
    WINDOW r AS (PARTITION BY key ORDER BY ts_ms RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW)) SELECT key, ts_ms - {DAY - 1} AS window_start, ts_ms AS window_end, count, sum, min, max, avg FROM w""",
)
def agg_sliding_count(spark, d):
    return rounded(windows.sliding_in_order(ordered(spark, d), DAY), "key", "window_start", "window_end")


@query(
    "agg_session_avg",
    f"""WITH {EV}, s AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY ts_ms, event_id) AS id FROM (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY key ORDER BY ts_ms, event_id) > {6 * HOUR} THEN 1 ELSE 0 END AS n FROM ev))
    SELECT key, min(ts_ms) AS window_start, max(ts_ms) AS window_end, {AGG} FROM s GROUP BY key, id""",
)
def agg_session_avg(spark, d):
    return rounded(windows.sessions(ordered(spark, d), 6 * HOUR), "key", "window_start", "window_end")


@query("late_tumbling_grace", f"WITH {LATE}, w AS (SELECT *, CAST(floor(ts_ms / {2 * HOUR}.0) AS BIGINT) * {2 * HOUR} AS window_start FROM st) SELECT key, window_start, window_start + {2 * HOUR} AS window_end, {AGG} FROM w WHERE window_start + {2 * HOUR} + {HOUR} > stt GROUP BY ALL")
def late_tumbling_grace(spark, d):
    return rounded(windows.fixed(disordered(spark, d), WindowSpec("tumbling", 2 * HOUR), HOUR), "key", "window_start", "window_end")


@query("late_hopping", f"WITH {LATE}, h AS (SELECT *, {HOP.format(5 * HOUR, 2 * HOUR, 'ts_ms')} AS window_start FROM st) SELECT key, window_start, window_start + {5 * HOUR} AS window_end, {AGG} FROM h WHERE window_start + {5 * HOUR} + {HOUR} > stt GROUP BY ALL")
def late_hopping(spark, d):
    return rounded(windows.fixed(disordered(spark, d), WindowSpec("hopping", 5 * HOUR, 2 * HOUR), HOUR), "key", "window_start", "window_end")


@query("late_hopping_rows", f"WITH {LATE} SELECT arr AS arrival_seq, key FROM st WHERE CAST(floor(ts_ms / {2 * HOUR}.0) AS BIGINT) * {2 * HOUR} + {5 * HOUR} + {HOUR} <= stt")
def late_hopping_rows(spark, d):
    return windows.late_rows(disordered(spark, d), WindowSpec("hopping", 5 * HOUR, 2 * HOUR), HOUR).select("arrival_seq", "key")


SLIDE = f"""WITH {LATE}, lv AS (SELECT * FROM st WHERE ts_ms + {HOUR} >= stt - {6 * HOUR}),
  p AS (SELECT a.key, a.ts_ms, a.arr, b.amt FROM lv a JOIN lv b ON a.key = b.key AND b.arr <= a.arr AND b.ts_ms > a.ts_ms - {6 * HOUR} AND b.ts_ms <= a.ts_ms AND b.ts_ms >= a.stt - {7 * HOUR}),
  g AS (SELECT key, ts_ms, arr, {AGG} FROM p GROUP BY ALL)"""


@query("late_sliding", f"{SLIDE} SELECT key, ts_ms - {6 * HOUR - 1} AS window_start, ts_ms AS window_end, count, sum, min, max, avg FROM g QUALIFY row_number() OVER (PARTITION BY key, ts_ms ORDER BY arr DESC) = 1")
def late_sliding(spark, d):
    return rounded(windows.sliding(disordered(spark, d), 6 * HOUR, HOUR), "key", "window_start", "window_end")


@query("changelog_sliding", f"{SLIDE} SELECT arr AS arrival_seq, key, ts_ms - {6 * HOUR - 1} AS window_start, ts_ms AS window_end, count, sum, min, max, avg FROM g")
def changelog_sliding(spark, d):
    return rounded(windows.sliding(disordered(spark, d), 6 * HOUR, HOUR, every_update=True), "arrival_seq", "key", "window_start", "window_end")


@query("late_metrics", f"WITH {LATE} SELECT count(*) AS processed, count(*) FILTER (CAST(floor(ts_ms / {2 * HOUR}.0) AS BIGINT) * {2 * HOUR} + {2 * HOUR} + {HOUR} <= stt) AS late, 0::BIGINT AS skipped, count(*) FILTER (CAST(floor(ts_ms / {2 * HOUR}.0) AS BIGINT) * {2 * HOUR} + {2 * HOUR} + {HOUR} > stt) AS emitted, max(ts_ms) AS stream_time, count(DISTINCT key) AS keys FROM st")
def late_metrics(spark, d):
    rows = disordered(spark, d)
    return windows.metrics(rows, rows.where("x IS NULL"), WindowSpec("tumbling", 2 * HOUR), HOUR)


@query(
    "changelog_tumbling",
    f"""WITH {LATE}, w AS (SELECT *, CAST(floor(ts_ms / {2 * HOUR}.0) AS BIGINT) * {2 * HOUR} AS window_start FROM st)
    SELECT arr AS arrival_seq, key, window_start, window_start + {2 * HOUR} AS window_end, count(*) OVER r AS count, round(sum(amt) OVER r, 6) AS sum, min(amt) OVER r AS min, max(amt) OVER r AS max, round(avg(amt) OVER r, 6) AS avg
    FROM w WHERE window_start + {2 * HOUR} + {HOUR} > stt WINDOW r AS (PARTITION BY key, window_start ORDER BY arr ROWS UNBOUNDED PRECEDING)""",
)
def changelog_tumbling(spark, d):
    return rounded(windows.changelog(disordered(spark, d), WindowSpec("tumbling", 2 * HOUR), HOUR), "arrival_seq", "key", "window_start", "window_end")


@query(
    "changelog_session",
    f"""WITH {LATE}, s AS MATERIALIZED (SELECT key, arr, ts_ms, amt FROM st),
    -- of what had arrived by a row, the rows of its key after the last gap before it and up to the first gap after it
    p AS MATERIALIZED (SELECT a.key, a.arr, a.ts_ms AS t, b.ts_ms, b.amt, b.ts_ms - lag(b.ts_ms) OVER (PARTITION BY a.arr ORDER BY b.ts_ms, b.arr) > {6 * HOUR} AS cut FROM s a JOIN s b ON a.key = b.key AND b.arr <= a.arr),
    c AS (SELECT *, max(CASE WHEN cut THEN ts_ms END) FILTER (ts_ms <= t) OVER (PARTITION BY arr) AS lo, min(CASE WHEN cut AND ts_ms > t THEN ts_ms END) OVER (PARTITION BY arr) AS hi FROM p)
    SELECT arr AS arrival_seq, key, min(ts_ms) AS window_start, max(ts_ms) AS window_end, {AGG} FROM c WHERE (lo IS NULL OR ts_ms >= lo) AND (hi IS NULL OR ts_ms < hi) GROUP BY arr, key""",
)
def changelog_session(spark, d):
    return rounded(windows.session_changelog(disordered(spark, d), 6 * HOUR), "arrival_seq", "key", "window_start", "window_end")


JOB_NUMBER = "regexp_replace(CAST(CAST({0} AS DECIMAL(28, 6)) AS VARCHAR), '[.]?0+$', '')"


@query(
    "job_window_records",
    f"""{TUMBLE}, count(*) AS n, sum(CAST(value AS DECIMAL(18, 2))) AS s, min(amt) AS lo, max(amt) AS hi FROM ev GROUP BY ALL""",
)
def job_window_records(spark, d):
    """Results as the records that a job writes to its target topic, read back from their JSON."""
    job = tumbling_job("sum")
    r = jobs.as_records(jobs.run(logs.events(spark, d), job), job)
    back = F.from_json(F.col("value").cast("string"), "key string, window_start long, window_end long, count long, sum double, min double, max double, avg double, value double")
    r = r.where("topic = '' AND partition = 0 AND key IS NULL").select(back.alias("v")).where("v.value = v.sum")
    return r.select("v.key", "v.window_start", "v.window_end", F.col("v.count").alias("n"), F.round("v.sum", 2).cast("decimal(18,2)").alias("s"), F.col("v.min").alias("lo"), F.col("v.max").alias("hi"))


@query("job_metrics", f"WITH {LATE}, sv AS (SELECT event_id, key, ts_ms, max(ts_ms) OVER (ORDER BY arr ROWS UNBOUNDED PRECEDING) AS stt FROM ooo WHERE event_id % 10 <> 3), w AS (SELECT *, CAST(floor(ts_ms / {2 * HOUR}.0) AS BIGINT) * {2 * HOUR} + {3 * HOUR} > stt AS open FROM sv) SELECT (SELECT count(*) FROM ev) AS processed, count(*) FILTER (NOT open) AS late, (SELECT count(*) FROM ev WHERE event_id % 10 = 3) AS skipped, count(*) FILTER (open) AS emitted, max(ts_ms) AS stream_time, count(DISTINCT key) AS keys FROM w")
def job_metrics(spark, d):
    """Counters of a job over the events in their late order, of which every tenth has no value to add."""
    order = disordered(spark, d).select("arrival_seq", "key", "ts", "x")
    delay = numbered(logs.events(spark, d).withColumn("delayed", F.col("timestamp_ms") + (F.col("arrival_seq") * 7919 % 11) * HOUR), [], ["delayed", "arrival_seq"], "n", DAY)
    log = delay.withColumn("value", F.when(F.col("arrival_seq") % 10 == 3, F.lit(b"{}")).otherwise(F.col("value"))).withColumn("arrival_seq", F.col("n")).drop("n", "delayed")
    job = jobs.JobConfig("m", "AGGREGATE", "events", value_field="amt", agg="sum", window=WindowSpec("tumbling", 2 * HOUR), grace_ms=HOUR)
    return jobs.metrics(log, job)


@query("recent_results", f"WITH {EV}, c AS (SELECT event_id AS arrival_seq, key, count(*) OVER (PARTITION BY key ORDER BY event_id) AS count FROM ev) SELECT * FROM c ORDER BY arrival_seq DESC LIMIT 200")
def recent_results(spark, d):
    from rivulet.streaming import jobs as stream

    return stream.recent(windows.running_count(ordered(spark, d)), 500)


@query("job_fan_out", f"WITH {EV} SELECT 'days' AS job, count(*) AS results FROM (SELECT DISTINCT key, ts_ms // {DAY} AS w FROM ev) UNION ALL SELECT 'hours', count(*) FROM (SELECT DISTINCT key, ts_ms // {HOUR} AS w FROM ev)")
def job_fan_out(spark, d):
    """Every job that the topic feeds runs; a paused one and one of another topic do not."""
    r = jobs.Jobs()
    for name, size, topic in (("days", DAY, "events"), ("hours", HOUR, "events"), ("off", HOUR, "events"), ("else", HOUR, "other")):
        r.register(jobs.JobConfig(name, "AGGREGATE", topic, key_field="user", window=WindowSpec("tumbling", size), grace_ms=DAY * 3650))
    r.pause("off")
    out = [df.agg(F.count("*").alias("results")).select(F.lit(name).alias("job"), "results") for name, df in r.run_all(logs.events(spark, d), "events").items()]
    return out[0].unionByName(out[1])


@query("changelog_count", f"WITH {EV} SELECT event_id AS arrival_seq, key, count(*) OVER (PARTITION BY key ORDER BY event_id) AS count FROM ev")
def changelog_count(spark, d):
    return windows.running_count(ordered(spark, d))


@query("state_query_key_range", f"WITH {EV}, m AS (SELECT min(ts_ms) AS t FROM ev), s AS (SELECT key, CAST(floor(ts_ms / {DAY}.0) AS BIGINT) * {DAY} AS window_start, CAST(floor(ts_ms / {DAY}.0) AS BIGINT) * {DAY} + {DAY} AS window_end, {AGG} FROM ev GROUP BY ALL) SELECT s.* FROM s, m WHERE key = '7' AND window_end >= t + {2 * DAY} AND window_start <= t + {9 * DAY}")
def state_query_key_range(spark, d):
    rows = ordered(spark, d)
    t = rows.agg(F.min("ts")).first()[0]
    return rounded(windows.query(windows.fixed(rows, WindowSpec("tumbling", DAY)), "7", t + 2 * DAY, t + 9 * DAY), "key", "window_start", "window_end")


@query("distinct_keys", f"WITH {EV} SELECT DISTINCT key FROM ev")
def distinct_keys(spark, d):
    return windows.distinct_keys(windows.fixed(ordered(spark, d), WindowSpec("tumbling", DAY)))


@query("retention_prune", f"WITH {EV}, m AS (SELECT max(ts_ms) AS t FROM ev), s AS (SELECT key, CAST(floor(ts_ms / {DAY}.0) AS BIGINT) * {DAY} AS window_start, CAST(floor(ts_ms / {DAY}.0) AS BIGINT) * {DAY} + {DAY} AS window_end, {AGG} FROM ev GROUP BY ALL) SELECT s.* FROM s, m WHERE window_end >= t - {HOUR} - {3 * DAY}")
def retention_prune(spark, d):
    rows = ordered(spark, d)
    t = rows.agg(F.max("ts")).first()[0]
    return rounded(windows.prune(windows.fixed(rows, WindowSpec("tumbling", DAY)), t, HOUR, 3 * DAY), "key", "window_start", "window_end")


# ---- joins -------------------------------------------------------------------------------

#: Customers as a changelog: two versions of each, every seventh deleted at last; those divisible by 11 are missing.
TAB = EV + """, cu AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_custkey AS k, c_mktsegment AS seg FROM customer WHERE c_custkey % 11 <> 0),
tab AS (SELECT key, k * 10 AS arr, '{"id":"' || key || '","v":1}' AS value, FALSE AS deleted FROM cu UNION ALL SELECT key, k * 10 + 3000, '{"id":"' || key || '","seg":"' || seg || '"}', FALSE FROM cu
  UNION ALL SELECT key, k * 10 + 6000, '', TRUE FROM cu WHERE k % 7 = 0),
snap AS (SELECT key, arg_max(value, arr) AS value, arg_max(deleted, arr) AS deleted FROM tab GROUP BY key)"""


def customers(spark, d) -> DataFrame:
    c = spark.read.parquet(f"{d.rstrip('/')}/customer.parquet").where("c_custkey % 11 <> 0").selectExpr("CAST(c_custkey AS STRING) AS key", "c_custkey AS k", "c_mktsegment AS seg")
    one = c.selectExpr("key", "k * 10 AS arrival_seq", """concat('{"id":"', key, '","v":1}') AS value""")
    two = c.selectExpr("key", "k * 10 + 3000", """concat('{"id":"', key, '","seg":"', seg, '"}')""")
    gone = c.where("k % 7 = 0").selectExpr("key", "k * 10 + 6000", "''")
    return one.union(two).union(gone).withColumn("key", F.col("key").cast("binary")).withColumn("value", F.col("value").cast("binary"))


def stream_side(spark, d) -> DataFrame:
    e = logs.events(spark, d)
    return e.select("arrival_seq", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("join_inner_latest", f"WITH {TAB} SELECT event_id AS arrival_seq, ev.key, body AS stream, value AS \"table\" FROM (SELECT event_id, key, body FROM ev) ev JOIN snap ON ev.key = snap.key AND NOT deleted")
def join_inner_latest(spark, d):
    return joins.join_latest(stream_side(spark, d), joins.snapshot(customers(spark, d), "id"))


@query("join_left_latest", f"WITH {TAB} SELECT event_id AS arrival_seq, ev.key, body AS stream, snap.value AS \"table\" FROM (SELECT event_id, key, body FROM ev) ev LEFT JOIN snap ON ev.key = snap.key AND NOT deleted")
def join_left_latest(spark, d):
    return joins.join_latest(stream_side(spark, d), joins.snapshot(customers(spark, d), "id"), "left")


@query("join_asof_exact", f"WITH {TAB} SELECT e.event_id AS arrival_seq, e.key, e.body AS stream, CASE WHEN NOT t.deleted THEN t.value END AS \"table\" FROM ev e ASOF LEFT JOIN tab t ON e.key = t.key AND e.event_id >= t.arr")
def join_asof_exact(spark, d):
    return joins.join_as_of(stream_side(spark, d), joins.changes(customers(spark, d), "id"), "left")


@query("join_tombstone", f"WITH {TAB} SELECT key, value FROM snap WHERE NOT deleted")
def join_tombstone(spark, d):
    return joins.snapshot(customers(spark, d), "id")


@query("join_unmatched_count", f"WITH {TAB} SELECT key, count(*) AS unmatched FROM ev WHERE key NOT IN (SELECT key FROM snap WHERE NOT deleted) GROUP BY key")
def join_unmatched_count(spark, d):
    return joins.unmatched(stream_side(spark, d), joins.snapshot(customers(spark, d), "id")).groupBy("key").agg(F.count("*").alias("unmatched"))


@query(
    "job_join_records",
    f"""WITH {TAB}, rw AS (SELECT key, CASE WHEN value LIKE '%seg%' THEN '{{"id":"' || key || '","seg":"' || json_extract_string(value, '$.seg') || '"}}' ELSE value END AS v FROM snap WHERE NOT deleted)
    SELECT event_id AS arrival_seq, '{{"key":"' || ev.key || '","stream":' || CASE WHEN event_id % 3 = 0 THEN '"text ' || event_id || '"' ELSE '{{"user":"' || ev.key || '"}}' END || ',"table":' || coalesce(v, 'null') || '}}' AS value
    FROM ev LEFT JOIN rw ON ev.key = rw.key""",
)
def job_join_records(spark, d):
    """A left join's records: the stream's JSON as it is, other text quoted, null without a table row."""
    e = logs.events(spark, d).select("topic", "arrival_seq", "key", F.when(F.col("arrival_seq") % 3 == 0, F.concat(F.lit("text "), F.col("arrival_seq").cast("string"))).otherwise(F.concat(F.lit('{"user":"'), F.col("key").cast("string"), F.lit('"}'))).cast("binary").alias("value"))
    both = e.unionByName(customers(spark, d).withColumn("topic", F.lit("customers")), allowMissingColumns=True)
    job = jobs.JobConfig("j", "JOIN", "events", target_topic="joined", table_topic="customers", table_key_field="id", join_type="left").validate()
    return jobs.as_records(jobs.run(both, job, as_of=False), job).select("arrival_seq", F.col("value").cast("string").alias("value"))


@query("job_join_metrics", f"WITH {TAB} SELECT (SELECT count(*) FROM ev) AS processed, (SELECT count(*) FROM ev) - count(*) AS unmatched, count(*) AS emitted, (SELECT count(*) FROM snap WHERE NOT deleted) AS table_rows FROM ev ASOF JOIN tab t ON ev.key = t.key AND ev.event_id >= t.arr WHERE NOT t.deleted")
def job_join_metrics(spark, d):
    both = logs.events(spark, d).select("topic", "arrival_seq", "key", "value").unionByName(customers(spark, d).withColumn("topic", F.lit("customers")).select("topic", "arrival_seq", "key", "value"))
    return jobs.metrics(both, jobs.JobConfig("j", "JOIN", "events", table_topic="customers", table_key_field="id"))


@query("state_keys_and_rows", f"WITH {TAB} SELECT 'key' AS kind, key, NULL AS value FROM (SELECT DISTINCT key FROM ev) UNION ALL SELECT 'row', key, value FROM snap WHERE key = '12' AND NOT deleted")
def state_keys_and_rows(spark, d):
    """What a job answers without a key (its keys) and, of a join, with one (the table's row)."""
    e = logs.events(spark, d).select("topic", "arrival_seq", "key", "value", "timestamp_ms")
    both = e.unionByName(customers(spark, d).withColumn("topic", F.lit("customers")), allowMissingColumns=True)
    keys = jobs.interactive(e, tumbling_job("count")).select(F.lit("key").alias("kind"), "key", F.lit(None).cast("string").alias("value"))
    row = jobs.interactive(both, jobs.JobConfig("j", "JOIN", "events", table_topic="customers", table_key_field="id"), "12")
    return keys.unionByName(row.select(F.lit("row").alias("kind"), "key", F.col("table").alias("value")))


# ---- log maintenance ---------------------------------------------------------------------

COMPACT = SEG + """, cl AS (SELECT *, seg < max(seg) OVER (PARTITION BY part) AS closed FROM sg),
lt AS (SELECT part, key, max(off) AS latest FROM cl WHERE closed GROUP BY ALL),
cc AS (SELECT cl.*, latest FROM cl LEFT JOIN lt USING (part, key))"""


@query("compact_latest", f"WITH RECURSIVE {COMPACT} SELECT part AS partition, off AS offset, key, body AS value FROM cc WHERE NOT closed OR off = latest")
def compact_latest(spark, d):
    c = logops.compact(segmented(spark, d), 0)
    return c.select("partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("compact_tombstone_expiry", f"WITH RECURSIVE {COMPACT} SELECT part AS partition, off AS offset FROM cc WHERE NOT closed OR (off = latest AND NOT (body = '' AND {NOW} - ts_ms > {DAY}))")
def compact_tombstone_expiry(spark, d):
    return logops.compact(segmented(spark, d), NOW).select("partition", "offset")


@query(
    "dirty_ratio",
    f"""WITH RECURSIVE {COMPACT} SELECT part AS partition, CAST(sum(CASE WHEN off < latest OR (body = '' AND {NOW} - ts_ms > {DAY}) THEN bytes ELSE 0 END) AS BIGINT) AS dirty_bytes, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(DISTINCT key) AS keys,
    round(sum(CASE WHEN off < latest OR (body = '' AND {NOW} - ts_ms > {DAY}) THEN bytes ELSE 0 END) / sum(bytes), 6) AS ratio FROM cc WHERE closed GROUP BY part""",
)
def dirty_ratio(spark, d):
    return logops.dirty_ratio(segmented(spark, d), NOW).drop("topic").withColumn("ratio", F.round("ratio", 6))


@query(
    "compaction_trigger",
    f"""WITH RECURSIVE {COMPACT}, dr AS (SELECT part, sum(CASE WHEN off < latest OR (body = '' AND {NOW} - ts_ms > {DAY}) THEN bytes ELSE 0 END) / sum(bytes) AS ratio FROM cc WHERE closed GROUP BY part)
    SELECT part AS partition FROM dr WHERE ratio >= 0.5""",
)
def compaction_trigger(spark, d):
    return logops.needs_compaction(logops.dirty_ratio(segmented(spark, d), NOW)).select("partition")


#: Producers' sequences with every ninth record sent twice; producer 3's twentieth arrives 400 events late, so what
#: comes between is refused until then, and what was refused never comes again.
PROD = EV + """, sq AS (SELECT event_id, part, user_id % 8 AS pid, row_number() OVER (PARTITION BY part, user_id % 8 ORDER BY event_id) - 1 AS seq FROM ev),
tw AS (SELECT *, event_id * 2 + CASE WHEN pid = 3 AND seq = 20 THEN 800 ELSE 0 END AS arr FROM sq UNION ALL SELECT *, event_id * 2 + 1 FROM sq WHERE event_id % 9 = 0 AND NOT (pid = 3 AND seq = 20)),
nr AS (SELECT *, row_number() OVER (PARTITION BY part, pid ORDER BY arr) AS n FROM tw)"""


def produced(spark, d) -> DataFrame:
    e = numbered(logs.events(spark, d), ["partition", "producer_id"], ["arrival_seq"], "n").withColumn("sequence", (F.col("n") - 1).cast("int")).drop("n")
    late = (F.col("producer_id") == 3) & (F.col("sequence") == 20)
    again = e.where("arrival_seq % 9 = 0").where(~late).withColumn("arrival_seq", F.col("arrival_seq") * 2 + 1)
    return e.withColumn("arrival_seq", F.col("arrival_seq") * 2 + F.when(late, 800).otherwise(0)).unionByName(again)


@query(
    "dedup_idempotent",
    f"""WITH RECURSIVE {PROD}, f AS (SELECT part, pid, arr, n, seq, CASE WHEN seq = 0 THEN 0 ELSE -1 END AS last, CASE WHEN seq = 0 THEN 'accepted' ELSE 'gap' END AS status FROM nr WHERE n = 1
      UNION ALL SELECT nr.part, nr.pid, nr.arr, nr.n, nr.seq, CASE WHEN nr.seq = f.last + 1 THEN nr.seq ELSE f.last END, CASE WHEN nr.seq = f.last + 1 THEN 'accepted' WHEN nr.seq <= f.last THEN 'duplicate' ELSE 'gap' END
      FROM f JOIN nr ON nr.part = f.part AND nr.pid = f.pid AND nr.n = f.n + 1)
    SELECT arr AS arrival_seq, status FROM f""",
)
def dedup_idempotent(spark, d):
    return logops.dedup(produced(spark, d)).select("arrival_seq", "status")


@query("dedup_fold", SQL["dedup_idempotent"])
def dedup_fold(spark, d):
    return logops.dedup_fold(produced(spark, d)).select("arrival_seq", "status")


@query(
    "transaction_states",
    f"""WITH {EV}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1)
    SELECT CAST(user_id AS VARCHAR) AS transactional_id, CASE n % 5 WHEN 0 THEN 'CompleteCommit' WHEN 1 THEN 'Ongoing' WHEN 2 THEN 'Ongoing' WHEN 3 THEN 'PrepareAbort' ELSE 'CompleteAbort' END AS state,
      CAST(n // 5 + CASE WHEN n % 5 >= 3 THEN 1 ELSE 0 END AS INTEGER) - CAST(n // 5 AS INTEGER) AS epoch, 0 AS refused, CAST(n // 5 AS INTEGER) AS committed_offsets FROM n""",
)
def transaction_states(spark, d):
    """Each user's events in turn: add, offsets, commit, markers and add again for whole fives (ending complete); the
    rest add, offsets, timeout, markers as far as they go."""
    e = logs.events(spark, d).select(F.col("key").cast("string").alias("transactional_id"), "arrival_seq")
    e = numbered(e, ["transactional_id"], ["arrival_seq"], "i")
    n = e.groupBy("transactional_id").agg(F.count("*").alias("n"))
    e = e.join(n, "transactional_id").withColumn("k", F.expr("(i - 1) % 5"))
    whole = F.expr("array(array('add'), array('offsets'), array('commit'), array('markers'), array())[CAST(k AS INT)]")
    rest = F.expr("array(array('add'), array('offsets'), array('timeout'), array('markers'), array())[CAST(k AS INT)]")
    e = e.withColumn("event", F.explode(F.when(F.expr("(i - 1) div 5 < n div 5"), whole).otherwise(rest)))
    return logops.transaction_states(e.select("transactional_id", "arrival_seq", "event"))


@query("split_batches", f"WITH {EV}, b AS (SELECT part, off // 7 AS b, min(off) AS base FROM ev GROUP BY ALL) SELECT ev.part AS partition, off AS offset, CAST(off * 3 // 3 AS INTEGER) AS sequence, key FROM ev")
def split_batches(spark, d):
    """The log gathered in batches of seven entries and split again."""
    e = logs.events(spark, d)
    b = e.groupBy("partition", F.expr("offset div 7").alias("b")).agg(F.min("offset").alias("base_offset"), F.sort_array(F.collect_list(F.struct("offset", F.col("key").cast("string").alias("key")))).alias("r"))
    b = b.select("partition", "base_offset", F.col("base_offset").cast("int").alias("base_sequence"), F.transform("r", lambda x: F.struct(x["key"].alias("key"))).alias("records"))
    return logops.split_batches(b).select("partition", "offset", "sequence", "key")


@query(
    "produce_batches",
    f"""WITH {EV}, b AS (SELECT part, user_id % 8 AS pid, event_id // 40 AS t, count(*) AS n, min(event_id) AS arr FROM ev GROUP BY ALL),
    s AS (SELECT *, row_number() OVER (PARTITION BY part, pid ORDER BY arr) - 1 AS i, sum(n) OVER (PARTITION BY part, pid ORDER BY arr) - n AS base FROM b),
    w AS (SELECT part, pid, arr * 2 AS arr, n, base, i, FALSE AS again FROM s UNION ALL SELECT part, pid, arr * 2 + 1, n, base, i, TRUE FROM s WHERE i % 3 = 1),
    r AS (SELECT *, CASE WHEN pid = 5 THEN 42 WHEN pid = 6 THEN 48 WHEN pid = 2 AND i >= 1 THEN 45 ELSE 0 END AS error, pid = 2 AND i = 0 AS lost FROM w),
    k AS (SELECT *, error = 0 AND NOT lost AND NOT again AS taken FROM r WHERE NOT lost),
    o AS (SELECT *, sum(CASE WHEN taken THEN n ELSE 0 END) OVER (PARTITION BY part ORDER BY arr) - n AS off FROM k)
    SELECT part AS partition, arr AS arrival_seq, error, CAST(CASE WHEN taken THEN off ELSE -1 END AS BIGINT) AS base_offset FROM o""",
)
def produce_batches(spark, d):
    """Batches of a producer's events, some sent twice; producer 5 sends control batches, 6 has no open
    transaction, and the first batch of producer 2 is lost, so all that follow are out of order."""
    return batches.produce(None, *sent_batches(spark, d))[0].drop("topic")


@query("produce_appended", f"WITH {EV}, f AS (SELECT part, user_id % 8 AS pid, min(event_id // 40) AS t FROM ev GROUP BY ALL) SELECT part AS partition, count(*) AS n, count(*) - 1 AS last_offset, count(DISTINCT key) AS keys FROM ev WHERE user_id % 8 NOT IN (2, 5, 6) GROUP BY part")
def produce_appended(spark, d):
    entries = batches.produce(None, *sent_batches(spark, d))[1]
    return entries.groupBy("partition").agg(F.count("*").alias("n"), F.max("offset").alias("last_offset"), F.countDistinct("key").alias("keys"))


def sent_batches(spark, d) -> tuple[DataFrame, DataFrame]:
    e = logs.events(spark, d)
    record = F.struct(F.col("arrival_seq").alias("i"), "key", "value", "headers", "timestamp_ms")
    b = e.groupBy("topic", "partition", "producer_id", F.expr("arrival_seq div 40").alias("t")).agg(F.sort_array(F.collect_list(record)).alias("records"), F.min("arrival_seq").alias("arrival_seq"))
    b = running(b.withColumn("n", F.size("records").cast("long")), ["topic", "partition", "producer_id"], ["arrival_seq"], F.col("n"), "upto")
    b = numbered(b, ["topic", "partition", "producer_id"], ["arrival_seq"], "i")
    b = b.selectExpr("topic", "partition", "producer_id", "CAST(0 AS SMALLINT) AS producer_epoch", "CAST(upto - n AS INT) AS base_sequence", "producer_id = 6 AS is_transactional", "producer_id = 5 AS is_control", "i - 1 AS i", "arrival_seq", "records")
    b = b.where("NOT (producer_id = 2 AND i = 0)")
    again = b.where("i % 3 = 1").withColumn("arrival_seq", F.col("arrival_seq") * 2 + 1)
    sent = b.withColumn("arrival_seq", F.col("arrival_seq") * 2).unionByName(again).drop("i")
    return sent, spark.createDataFrame([(6, "committed"), (4, "ongoing")], "producer_id long, state string")


#: Transactions of 50 events, every fifth aborted, those of the last 120 events ongoing.
TXN = EV + """, tx AS (SELECT part, user_id % 8 AS pid, event_id // 50 AS t, min(off) AS f, max(off) + 1 AS l, max(event_id) AS e FROM ev GROUP BY ALL),
ts AS (SELECT part, pid, f, l, CASE WHEN e > (SELECT max(event_id) - 120 FROM ev) THEN 'ongoing' WHEN t % 5 = 0 THEN 'aborted' ELSE 'committed' END AS state FROM tx),
hw AS (SELECT part, max(off) + 1 AS hw FROM ev GROUP BY part),
ls AS (SELECT hw.part, hw, least(hw, fo) AS lso FROM hw LEFT JOIN (SELECT part, min(f) AS fo FROM ts WHERE state = 'ongoing' GROUP BY part) USING (part))"""


def transactions(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = logs.events(spark, d)
    last = e.agg(F.max("arrival_seq")).first()[0]
    t = e.groupBy("topic", "partition", "producer_id", F.expr("arrival_seq div 50").alias("t")).agg(F.min("offset").alias("first_offset"), (F.max("offset") + 1).alias("last_offset"), F.max("arrival_seq").alias("e"))
    state = F.when(F.col("e") > last - 120, "ongoing").when(F.col("t") % 5 == 0, "aborted").otherwise("committed")
    ends = logs.earliest_latest(e).select("topic", "partition", F.col("latest").alias("high_watermark"))
    return e, t.withColumn("state", state).drop("t", "e"), ends


@query("read_committed", f"WITH {TXN} SELECT ev.part AS partition, off AS offset FROM ev JOIN ls USING (part) WHERE off < lso AND NOT EXISTS (SELECT 1 FROM ts WHERE ts.part = ev.part AND ts.pid = ev.user_id % 8 AND state = 'aborted' AND off >= f AND off < l)")
def read_committed(spark, d):
    return logops.read_committed(*transactions(spark, d)).select("partition", "offset")


@query("last_stable_offset", f"WITH {TXN} SELECT part AS partition, hw AS high_watermark, lso FROM ls")
def last_stable_offset(spark, d):
    _, t, ends = transactions(spark, d)
    return logops.last_stable_offset(ends, t).drop("topic")


@query("log_latest_committed", f"WITH {TXN} SELECT part AS partition, (SELECT min(off) FROM ev WHERE ev.part = ls.part) AS earliest, lso AS latest FROM ls")
def log_latest_committed(spark, d):
    e, t, ends = transactions(spark, d)
    return logs.latest_committed(e, logops.last_stable_offset(ends, t)).drop("topic")


@query("aborted_ranges", f"WITH {TXN} SELECT part AS partition, pid AS producer_id, f AS first_offset, l AS last_offset FROM ts WHERE state = 'aborted' AND f < 400 AND l > 100")
def aborted_ranges(spark, d):
    return logops.aborted_ranges(transactions(spark, d)[1], 100, 400).select("partition", "producer_id", "first_offset", "last_offset")


# ---- groups, placement -------------------------------------------------------------------

COMMITS = EV + """, cm AS (SELECT 'g' || (user_id % 3) AS group_id, part, off AS committed_offset, event_id FROM ev WHERE event_id % 5 = 0 AND NOT (user_id % 3 = 2 AND part = 1)),
lo AS (SELECT group_id, part, arg_max(committed_offset, event_id) AS committed_offset FROM cm GROUP BY ALL)"""


def commits(spark, d) -> DataFrame:
    e = logs.events(spark, d).withColumn("u", F.col("key").cast("string").cast("long"))
    return e.where("arrival_seq % 5 = 0 AND NOT (u % 3 = 2 AND partition = 1)").selectExpr("concat('g', u % 3) AS group_id", "topic", "partition", "offset AS committed_offset", "arrival_seq")


@query("group_lag", f"WITH {COMMITS}, hw AS (SELECT part, max(off) + 1 AS hw FROM ev WHERE part <> 3 GROUP BY part) SELECT group_id, part AS partition, committed_offset, coalesce(hw, 0) AS high_watermark, greatest(coalesce(hw, 0) - committed_offset, 0) AS lag FROM lo LEFT JOIN hw USING (part)")
def group_lag(spark, d):
    ends = logs.earliest_latest(logs.events(spark, d)).where("partition <> 3").select("topic", "partition", F.col("latest").alias("high_watermark"))
    return joins.lag(groups.latest_offsets(commits(spark, d)), ends).drop("topic")


@query("offset_fetch", f"WITH {COMMITS}, w AS (SELECT 'g' || g AS group_id, CAST(p AS INTEGER) AS part FROM range(4) a(g), range(4) b(p)) SELECT group_id, part AS partition, coalesce(committed_offset, -1) AS committed_offset FROM w LEFT JOIN lo USING (group_id, part)")
def offset_fetch(spark, d):
    wanted = spark.createDataFrame([(f"g{g}", "events", p) for g in range(4) for p in range(4)], "group_id string, topic string, partition int")
    return groups.fetch_offsets(wanted, groups.latest_offsets(commits(spark, d))).drop("topic")


@query(
    "commit_validation",
    f"""WITH {COMMITS}, c AS (SELECT *, ['', 'a', 'b'][CAST(event_id % 3 AS INTEGER) + 1] AS member_id, event_id % 2 AS generation FROM cm)
    SELECT group_id, part AS partition, committed_offset, member_id FROM c WHERE CASE WHEN member_id = '' THEN group_id <> 'g0' ELSE group_id = 'g0' AND (member_id, generation) IN (('a', 1), ('b', 0)) END""",
)
def commit_validation(spark, d):
    members = spark.createDataFrame([("g0", "a", 1), ("g0", "b", 0)], "group_id string, member_id string, generation long")
    sent = commits(spark, d).selectExpr("*", "array('', 'a', 'b')[arrival_seq % 3] AS member_id", "arrival_seq % 2 AS generation")
    return groups.valid_commits(sent, members).select("group_id", "partition", "committed_offset", "member_id")


@query("group_listing", f"WITH {COMMITS} SELECT coalesce(m.group_id, o.group_id) AS group_id, coalesce(members, 1) AS members, coalesce(offsets, 0) AS offsets, members IS NULL AS offsets_only FROM (SELECT * FROM (VALUES ('g0', 2), ('idle', 1)) t(group_id, members)) m FULL JOIN (SELECT group_id, count(*) AS offsets FROM lo GROUP BY 1) o USING (group_id)")
def group_listing(spark, d):
    members = spark.createDataFrame([("g0", "a"), ("g0", "b"), ("idle", "c")], "group_id string, member_id string")
    return groups.list_groups(members, groups.latest_offsets(commits(spark, d)))


#: Three replicas of each partition with ends behind the leader's by steps; broker 2 is dead.
REPL = EV + """, hw AS (SELECT part, max(off) + 1 AS e FROM ev GROUP BY part),
rp AS (SELECT part, CAST((part + r) % 4 AS INTEGER) AS broker_id, CAST(r AS INTEGER) AS r, e - r * part * 3 AS end_offset, r = 0 AS is_leader, (part + r) % 4 <> 2 AS alive FROM hw, range(3) t(r))"""


def replicas(spark, d) -> DataFrame:
    e = logs.earliest_latest(logs.events(spark, d))
    r = e.select("topic", "partition", "latest", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("r"))
    return r.selectExpr("topic", "partition", "(partition + r) % 4 AS broker_id", "latest - r * partition * 3 AS end_offset", "r = 0 AS is_leader", "(partition + r) % 4 <> 2 AS alive")


@query(
    "high_watermark_isr",
    f"""WITH {REPL}, i AS (SELECT rp.part, rp.broker_id, rp.end_offset FROM rp JOIN rp l ON l.part = rp.part AND l.is_leader WHERE rp.is_leader OR (rp.alive AND l.end_offset - rp.end_offset <= 9))
    SELECT part AS partition, min(end_offset) AS high_watermark, string_agg(broker_id::VARCHAR, ',' ORDER BY broker_id) AS isr FROM i GROUP BY part""",
)
def high_watermark_isr(spark, d):
    return logops.high_watermark(replicas(spark, d), 9).select("partition", "high_watermark", F.array_join(F.transform("isr", lambda x: x.cast("string")), ",").alias("isr"))


@query("leader_election", f"WITH {REPL} SELECT part AS partition, coalesce((SELECT broker_id FROM rp x WHERE x.part = hw.part AND alive ORDER BY (NOT r < 2), end_offset DESC, broker_id LIMIT 1), 0) AS leader FROM hw")
def leader_election(spark, d):
    r = replicas(spark, d).withColumn("in_sync", F.pmod(F.col("broker_id") - F.col("partition"), F.lit(4)) < 2)
    return groups.elect(r).drop("topic")


@query("leader_election_excluding", f"WITH {REPL} SELECT part AS partition, coalesce((SELECT broker_id FROM rp x WHERE x.part = hw.part AND alive AND broker_id <> 1 ORDER BY (NOT r < 2), end_offset DESC, broker_id LIMIT 1), 0) AS leader FROM hw")
def leader_election_excluding(spark, d):
    r = replicas(spark, d).withColumn("in_sync", F.pmod(F.col("broker_id") - F.col("partition"), F.lit(4)) < 2)
    return groups.elect(r, exclude=1).drop("topic")


@query("metadata_leaders", f"WITH {REPL} SELECT part AS partition, broker_id AS leader, CASE WHEN broker_id <> 2 THEN 'b' || broker_id || ':9092' END AS address FROM rp WHERE is_leader")
def metadata_leaders(spark, d):
    brokers = spark.createDataFrame([(b, f"b{b}:9092") for b in (0, 1, 3)], "broker_id int, address string")
    return joins.leaders(replicas(spark, d).where("is_leader").selectExpr("partition", "broker_id AS leader"), brokers)


@query(
    "replica_choice",
    f"""WITH {REPL}, rk AS (SELECT *, ['a', 'b'][CAST(broker_id % 2 AS INTEGER) + 1] AS rack FROM rp), rd AS (SELECT p * 2 + k AS read_id, CAST(p AS INTEGER) AS part, ['a', 'b'][CAST(k AS INTEGER) + 1] AS rack, 40 AS fo FROM range(4) a(p), range(2) b(k)),
    c AS (SELECT rd.read_id, rk.*, CASE WHEN rk.rack = rd.rack AND is_leader THEN 0 WHEN rk.rack = rd.rack AND alive AND end_offset >= fo THEN 1 WHEN is_leader THEN 2 END AS rank FROM rd JOIN rk ON rk.part = rd.part)
    SELECT read_id, broker_id FROM c WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY rank, CASE WHEN rank = 1 THEN -end_offset ELSE 0 END, broker_id) = 1""",
)
def replica_choice(spark, d):
    r = replicas(spark, d).withColumn("in_sync", F.col("alive")).withColumn("rack", F.expr("array('a', 'b')[broker_id % 2]"))
    reads = spark.createDataFrame([(p * 2 + k, "events", p, "ab"[k], 40) for p in range(4) for k in range(2)], "read_id long, topic string, partition int, rack string, fetch_offset long")
    return groups.choose_replica(r, reads)


@query("placement_round_robin", "SELECT CAST(p AS INTEGER) AS partition, CAST(r AS INTEGER) AS replica, CAST([1, 2, 5, 9][CAST((p + r) % 4 AS INTEGER) + 1] AS INTEGER) AS broker_id FROM range(10) a(p), range(3) b(r)")
def placement_round_robin(spark, d):
    brokers = spark.createDataFrame([(x,) for x in (9, 1, 5, 2)], "broker_id int")
    return groups.place_round_robin(spark.range(10).selectExpr("CAST(id AS INT) AS partition"), brokers, 3)


@query("share_assignment", "WITH m AS (SELECT 's' || m || 'm' || i AS member_id, m, i FROM (VALUES (3), (6)) t(m), range(6) r(i) WHERE i < m) SELECT member_id, CAST(p AS INTEGER) AS partition FROM m, range(4) q(p) WHERE CASE WHEN m <= 4 THEN p % m = i ELSE i % 4 = p END")
def share_assignment(spark, d):
    parts = spark.range(4).selectExpr("CAST(id AS INT) AS partition")
    two = [groups.share_assignment(spark.createDataFrame([(f"s{n}m{i}",) for i in range(n)], "member_id string"), parts) for n in (3, 6)]
    return two[0].unionByName(two[1])


# ---- queues, quotas ----------------------------------------------------------------------

def dead_letter_rows(spark, d, events) -> DataFrame:
    dead = queues.dead_letters(queues.replay(events), logs.events(spark, d))
    heads = F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string"))), ",")
    return dead.select("dlq_topic", "partition", "offset", F.col("value").cast("string").alias("value"), heads.alias("headers"))


DRAIN = 1400  # new records a round; 240 of them are released (every fifth, but not every seventh)
DRAINED = "CASE WHEN off % 7 = 0 THEN 'archived' ELSE 'acknowledged' END"


def drain_events(spark, d) -> DataFrame:
    """Each partition read to its end by one member, in rounds: what the round before released, then new
    records. Every seventh is rejected, every fifth released once, the others accepted."""
    ends = logs.earliest_latest(logs.events(spark, d)).where("latest > 0")
    head = ["'g' AS group_id", "topic", "partition"]
    acq = ends.withColumn("r", F.explode(F.expr(f"sequence(0L, (latest - 1) div {DRAIN} + 1)")))
    acq = acq.selectExpr(*head, "r * 10000 AS seq", "r AS now_ms", "'acquire' AS kind", "'m' AS member", "latest AS first", f"IF(r = 0, {DRAIN}L, {DRAIN + 240}L) AS last", "0 AS ack_type")
    o = ends.withColumn("o", F.explode(F.expr("sequence(0L, latest - 1)"))).withColumn("r", F.expr(f"o div {DRAIN}"))
    o = o.withColumn("ack_type", F.expr("CASE WHEN o % 7 = 0 THEN 3 WHEN o % 5 = 0 THEN 2 ELSE 1 END"))
    again = o.where("ack_type = 2").withColumn("r", F.col("r") + 1).withColumn("ack_type", F.lit(1))
    acks = o.unionByName(again).selectExpr(*head, f"r * 10000 + 1 + o % {2 * DRAIN} AS seq", "r AS now_ms", "'ack' AS kind", "'m' AS member", "o AS first", "o AS last", "ack_type")
    return acq.union(acks)


@query("share_replay_final_state", f"WITH {EV} SELECT part AS partition, off AS offset, {DRAINED} AS state, CASE WHEN off % 5 = 0 AND off % 7 <> 0 THEN 2 ELSE 1 END AS delivery_count, CASE WHEN off % 7 = 0 THEN 'rejected' END AS reason, count(*) OVER (PARTITION BY part) AS start_offset, count(*) OVER (PARTITION BY part) AS end_offset FROM ev")
def share_replay_final_state(spark, d):
    return queues.replay(drain_events(spark, d)).drop("group_id", "topic")


@query("share_state_counts", f"WITH {EV} SELECT part AS partition, 0::BIGINT AS available, 0::BIGINT AS acquired, count(*) FILTER (off % 7 <> 0) AS acknowledged, count(*) FILTER (off % 7 = 0) AS archived FROM ev GROUP BY part")
def share_state_counts(spark, d):
    return queues.state_counts(queues.replay(drain_events(spark, d))).drop("group_id", "topic")


@query("share_dlq", f"WITH {EV} SELECT 'events.g.dlq' AS dlq_topic, part AS partition, off AS offset, body AS value, 'type=' || event_type || ',x-original-topic=events,x-original-partition=' || part || ',x-original-offset=' || off || ',x-share-group=g,x-dlq-reason=rejected' AS headers FROM ev WHERE off % 7 = 0")
def share_dlq(spark, d):
    return dead_letter_rows(spark, d, drain_events(spark, d))


@query(
    "share_expiry",
    f"""WITH {EV} SELECT part AS partition, off AS offset, CASE WHEN off % 3 = 0 THEN 'acknowledged' WHEN off % 3 = 1 THEN 'archived' ELSE 'acquired' END AS state,
    CASE WHEN off % 3 = 0 THEN 1 WHEN off % 3 = 1 THEN 2 ELSE 1 END AS delivery_count, CASE WHEN off % 3 = 1 THEN 'delivery-limit-exceeded' END AS reason FROM ev""",
)
def share_expiry(spark, d):
    """Of each partition, read whole: every third record is accepted, the next is left until its lock has run out twice (the
    limit), the next has its lock renewed before each end."""
    ends = logs.earliest_latest(logs.events(spark, d)).where("latest > 0")
    head = ["'g' AS group_id", "topic", "partition"]
    acq = ends.withColumn("r", F.explode(F.array(F.lit(0), F.lit(1)))).selectExpr(*head, "r * 10000000L AS seq", "r * 31000L AS now_ms", "'acquire' AS kind", "'m' AS member", "latest AS first", "latest AS last", "0 AS ack_type")
    o = ends.withColumn("o", F.explode(F.expr("sequence(0L, latest - 1)")))
    first = o.where("o % 3 = 0").selectExpr(*head, "o + 1 AS seq", "1L AS now_ms", "'ack' AS kind", "'m' AS member", "o AS first", "o AS last", "1 AS ack_type")
    renew = o.where("o % 3 = 2").withColumn("t", F.explode(F.array(F.lit(20_000), F.lit(45_000)))).selectExpr(*head, "IF(t = 20000, 5000000L, 15000000L) + o AS seq", "CAST(t AS LONG) AS now_ms", "'ack' AS kind", "'m' AS member", "o AS first", "o AS last", "4 AS ack_type")
    end = ends.selectExpr(*head, "90000000L AS seq", "62000L AS now_ms", "'tick' AS kind", "'m' AS member", "0L AS first", "0L AS last", "0 AS ack_type")
    events = acq.union(first).union(renew).union(end)
    out = queues.replay(events, max_attempts=2, max_in_flight=1 << 40)
    return out.select("partition", "offset", "state", "delivery_count", "reason")


@query("share_skipped", f"WITH {TXN} SELECT ev.part AS partition, off AS offset, CASE WHEN EXISTS (SELECT 1 FROM ts WHERE ts.part = ev.part AND ts.pid = ev.user_id % 8 AND state = 'aborted' AND off >= f AND off < l) OR event_id % 13 = 0 THEN 'archived' ELSE 'acquired' END AS state FROM ev JOIN ls USING (part) WHERE off < lso")
def share_skipped(spark, d):
    """Read below the last stable offset: control records (every 13th here) and aborted ones are never delivered."""
    e, t, ends = transactions(spark, d)
    e = e.withColumn("is_control", F.col("arrival_seq") % 13 == 0)
    bound = logops.last_stable_offset(ends, t).where("lso > 0")
    acq = bound.selectExpr("'g' AS group_id", "topic", "partition", "0L AS seq", "0L AS now_ms", "'acquire' AS kind", "'m' AS member", "lso AS first", "lso AS last", "0 AS ack_type")
    out = queues.replay(acq, skipped=queues.undeliverable(e, t), max_in_flight=1 << 40)
    return out.select("partition", "offset", "state")


@query("share_max_bytes", f"WITH {EV}, r AS (SELECT part, off, sum(strlen(key) + strlen(body)) OVER (PARTITION BY part ORDER BY off) - strlen(key) - strlen(body) AS before FROM ev) SELECT part AS partition, count(*) AS acquired, max(off) AS last FROM r WHERE before < 5000 GROUP BY part")
def share_max_bytes(spark, d):
    """One acquire of 5,000 bytes in each partition; the record that passes the bound is still in it."""
    e = logs.events(spark, d)
    acq = logs.earliest_latest(e).selectExpr("'g' AS group_id", "topic", "partition", "0L AS seq", "0L AS now_ms", "'acquire' AS kind", "'m' AS member", "latest AS first", "latest AS last", "0 AS ack_type")
    out = queues.replay(acq, sizes=e.select("topic", "partition", "offset", logs.entry_bytes().alias("bytes")), max_bytes=5000, max_in_flight=1 << 40)
    return out.groupBy("partition").agg(F.count_if(F.col("state") == "acquired").alias("acquired"), F.max("offset").alias("last"))


USE = EV + """, us AS (SELECT CAST(user_id % 20 AS VARCHAR) AS user, event_type AS client_id, ts_ms // 600 AS now_ms, amt AS amount FROM ev)"""
SECS = USE + """, sc AS (SELECT user, client_id, now_ms // 1000 AS sec, sum(amount) AS amount, max(now_ms) AS now_ms FROM us GROUP BY ALL),
rt AS (SELECT user, client_id, sec, least(greatest(now_ms - min(sec) OVER w * 1000, 10000), 11000) / 1000 AS window_s, sum(amount) OVER w AS total FROM sc WINDOW w AS (PARTITION BY user, client_id ORDER BY sec RANGE BETWEEN 10 PRECEDING AND CURRENT ROW))"""


def usage(spark, d) -> DataFrame:
    """Event values as bytes used, time sped up so that seconds hold several."""
    e = logs.events(spark, d)
    amt = J.to_double(J.get(J.parse(F.col("value")), "amt"))
    return e.select(
        (F.col("key").cast("string").cast("long") % 20).cast("string").alias("user"), F.expr("headers[0].value").cast("string").alias("client_id"), F.expr("timestamp_ms div 600").alias("now_ms"), amt.alias("amount")
    )


@query("quota_window_rate", f"WITH {SECS} SELECT user, client_id, sec, round(total / window_s, 6) AS rate FROM rt")
def quota_window_rate(spark, d):
    return quotas.rates(usage(spark, d)).select("user", "client_id", "sec", F.round("rate", 6).alias("rate"))


@query("quota_request_time", f"WITH {SECS} SELECT user, client_id, sec, round(total * 1000000 / 1e9 * 100 / window_s, 6) AS percent FROM rt")
def quota_request_time(spark, d):
    busy = usage(spark, d).withColumn("amount", quotas.request_percent(F.col("amount") * 1_000_000))
    return quotas.rates(busy).select("user", "client_id", "sec", F.round("rate", 6).alias("percent"))


@query("quota_throttle", f"WITH {SECS} SELECT user, client_id, sec, CAST(CASE WHEN q <= 0 THEN 30000 WHEN r <= q THEN 0 ELSE least(ceil(round((r - q) / q * window_s * 1000, 3)), 30000) END AS INTEGER) AS throttle_ms FROM (SELECT *, round(total / window_s, 6) AS r, (CAST(user AS INTEGER) % 6)::DOUBLE AS q FROM rt)")
def quota_throttle(spark, d):
    r = quotas.rates(usage(spark, d)).withColumn("rate", F.round("rate", 6)).withColumn("q", (F.col("user").cast("int") % 6).cast("double"))
    return r.select("user", "client_id", "sec", quotas.throttle_ms(F.col("rate"), F.col("q"), F.col("window_s")).alias("throttle_ms"))


ENTRIES = [("1", "click", 10.0), ("1", "<default>", 20.0), ("2", None, 30.0), ("<default>", "view", 40.0), ("<default>", None, 50.0), (None, "error", 60.0), ("3", "click", None)]


@query(
    "quota_precedence",
    f"""WITH {USE}, c AS (SELECT DISTINCT user, client_id FROM us), e AS (SELECT * FROM (VALUES ('1', 'click', 10.0::DOUBLE), ('1', '<default>', 20.0), ('2', NULL, 30.0), ('<default>', 'view', 40.0), ('<default>', NULL, 50.0), (NULL, 'error', 60.0)) t(eu, ec, quota))
    SELECT user, client_id, quota FROM c LEFT JOIN e ON (eu = user OR eu = '<default>' OR eu IS NULL) AND (ec = client_id OR ec = '<default>' OR ec IS NULL)
    QUALIFY row_number() OVER (PARTITION BY user, client_id ORDER BY CASE WHEN eu = user THEN 0 WHEN eu = '<default>' THEN 1 ELSE 2 END, CASE WHEN ec = client_id THEN 0 WHEN ec = '<default>' THEN 1 ELSE 2 END) = 1""",
)
def quota_precedence(spark, d):
    entries = spark.createDataFrame(ENTRIES, "user string, client_id string, quota double")
    return quotas.resolve(usage(spark, d), entries).drop("rank")


# ---- rules, schemas, reports -------------------------------------------------------------

RULES = [
    ("r1", "User:*", "TOPIC", "public-*", "READ", "ALLOW", 1),
    ("r2", "User:7", "ALL", "*", "ALL", "DENY", 2),
    ("r3", "1?", "TOPIC", "click", "WRITE", "ALLOW", 3),
    ("r4", "User:3", "TOPIC", "p[uv]rchase", "ALL", "ALLOW", 4),
    ("r5", "*", "", "signup", "READ", "DENY", 5),
    ("r6", "[^1-4]?", "TOPIC", "v[^a-h]ew", "READ", "ALLOW", 6),
    ("r7", "4*", "TOPIC", "e\\rror", "ALL", "ALLOW", 7),
]


@query(
    "acl_evaluate",
    """WITH q AS (SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS p, event_type AS n, CASE WHEN event_id % 2 = 0 THEN 'READ' ELSE 'WRITE' END AS op FROM events),
    v AS (SELECT *, CASE WHEN p = '7' THEN 'r2' WHEN n = 'signup' AND op = 'READ' THEN 'r5' END AS d, CASE WHEN regexp_full_match(p, '1.') AND n = 'click' AND op = 'WRITE' THEN 'r3' WHEN p = '3' AND n = 'purchase' THEN 'r4'
      WHEN regexp_full_match(p, '[^1-4].') AND n = 'view' AND op = 'READ' THEN 'r6' WHEN p LIKE '4%' AND n = 'error' THEN 'r7' END AS a FROM q)
    SELECT request_id, d IS NULL AND (p = '20' OR a IS NOT NULL) AS allowed, CASE WHEN d IS NOT NULL THEN 'deny' WHEN p = '20' THEN 'super_admin' WHEN a IS NOT NULL THEN 'allow' ELSE 'default_deny' END AS verdict,
    CASE WHEN d IS NOT NULL THEN d WHEN p = '20' THEN NULL ELSE a END AS rule_id FROM v""",
)
def acl_evaluate(spark, d):
    asks = logs.events(spark, d).selectExpr("arrival_seq AS request_id", "concat('User:', CAST(key AS STRING)) AS principal", "'TOPIC' AS resource_type", "CAST(headers[0].value AS STRING) AS resource_name", "IF(arrival_seq % 2 = 0, 'READ', 'WRITE') AS operation")
    rules = spark.createDataFrame(RULES, "rule_id string, principal string, resource_type string, resource_name string, operation string, permission string, seq int")
    users = spark.createDataFrame([("20", "SUPER_ADMIN"), ("7", "SUPER_ADMIN"), ("3", "USER")], "username string, role string")
    return acl.evaluate(asks, rules, users)


#: Globs against names: classes, negated classes, escapes, stars that stop at a slash, characters that mean something elsewhere.
GLOBS = ("a*", "a/*", "?b", "[a-c]x", "[^a-c]x", "a\\*b", "a.b", "(a|b)", "[^x]*", "x[", "{a}", "a+")
GLOB_NAMES = ("a", "ab", "a/b", "bx", "dx", "a*b", "axb", "a.b", "a|b", "(a|b)", "x[", "{a}", "a+", "aa", "")
GLOB_SQL = {"a*": "a[^/]*", "a/*": "a/[^/]*", "?b": "[^/]b", "[a-c]x": "[a-c]x", "[^a-c]x": "[^a-c]x", "a\\*b": "a\\*b", "a.b": "a\\.b", "(a|b)": "\\(a\\|b\\)", "[^x]*": "[^x][^/]*", "{a}": "\\{a\\}", "a+": "a\\+"}


@query(
    "glob_match",
    "SELECT p AS pattern, n AS name, coalesce(regexp_full_match(n, r), FALSE) AS hit FROM (VALUES "
    + ", ".join(f"('{g}', {chr(39) + GLOB_SQL[g] + chr(39) if g in GLOB_SQL else 'NULL'})" for g in GLOBS)
    + ") g(p, r), (VALUES " + ", ".join(f"('{n}')" for n in GLOB_NAMES) + ") n(n)",
)
def glob_match(spark, d):
    rows = spark.createDataFrame([(g, n) for g in GLOBS for n in GLOB_NAMES], "pattern string, name string")
    return rows.select("pattern", "name", F.rlike("name", acl.glob(F.col("pattern"))).alias("hit"))


FIELDS = [
    ("a", "old", "id", "string", False), ("a", "new", "id", "string", False), ("a", "new", "status", "string", True),
    ("b", "old", "id", "string", False), ("b", "new", "id", "string", False), ("b", "new", "tax", "double", False),
    ("c", "old", "n", "int", False), ("c", "new", "n", "long", False), ("d", "old", "n", "long", False), ("d", "new", "n", "int", False),
    ("e", "old", "x", "string", True), ("e", "old", "id", "int", False), ("e", "new", "id", "int", False), ("f", "old", "x", "bytes", True), ("f", "new", "x", "string", False),
]


@query("schema_compat_avro", "SELECT * FROM (VALUES ('a', TRUE, TRUE, TRUE), ('b', FALSE, TRUE, FALSE), ('c', TRUE, TRUE, TRUE), ('d', FALSE, FALSE, FALSE), ('e', TRUE, TRUE, TRUE), ('f', FALSE, TRUE, FALSE)) t(subject, backward, forward, \"full\")")
def schema_compat_avro(spark, d):
    return schemas.avro_compatibility(spark.createDataFrame(FIELDS, "subject string, side string, name string, type string, has_default boolean"))


#: Pairs of schemas of fields a, b and c by the digits of a number: in the old one, in the new one, typed otherwise, with a
#: default (Avro, JSON) there, required (JSON).
PAIRS = """p AS (SELECT CAST(i AS BIGINT) AS i, f.k, f.n, (i // CAST(f.k AS BIGINT)) % 2 = 1 AS o, (i // (CAST(f.k AS BIGINT) * 2)) % 2 = 1 AS w, (i // (CAST(f.k AS BIGINT) * 4)) % 2 = 1 AS other, (i // (CAST(f.k AS BIGINT) * 8)) % 2 = 1 AS odef, (i // (CAST(f.k AS BIGINT) * 16)) % 2 = 1 AS ndef
  FROM range(1024) r(i), (VALUES (1, 'a'), (32, 'b')) f(k, n))"""


def schema_pairs(spark, field, whole) -> DataFrame:
    """(i, old, new): field(name, other type, default) is a field's text, whole(fields) the schema's."""
    r = spark.range(1024).select(F.col("id").alias("i"))
    bit = lambda k: F.expr(f"(i div {k}) % 2 = 1")
    olds, news = [], []
    for k, n in ((1, "a"), (32, "b")):
        olds.append(F.when(bit(k), field(n, F.lit(False), bit(8 * k))))
        news.append(F.when(bit(2 * k), field(n, bit(4 * k), bit(16 * k))))
    return r.select("i", whole(F.concat_ws(",", *olds)).alias("old"), whole(F.concat_ws(",", *news)).alias("new"))


@query(
    "schema_compat_avro_texts",
    f"""WITH {PAIRS}, j AS (SELECT i, bool_and(NOT (o AND w) OR NOT other) AS shared, bool_and(NOT (w AND NOT o) OR ndef) AND bool_and(NOT (o AND w AND odef AND NOT ndef)) AS back, bool_and(NOT (o AND NOT w) OR odef) AS forth FROM p GROUP BY i)
    SELECT i, shared AND back AS backward, shared AND forth AS forward, shared AND back AND forth AS "full", TRUE AS "none" FROM j""",
)
def schema_compat_avro_texts(spark, d):
    field = lambda n, other, default: F.concat(F.lit(f'{{"name":"{n}","type":"'), F.when(other, "boolean").otherwise("string"), F.lit('"'), F.when(default, ',"default":""').otherwise(""), F.lit("}"))
    p = schema_pairs(spark, field, lambda x: F.concat(F.lit('{"type":"record","name":"R","fields":['), x, F.lit("]}")))
    return p.select("i", *[schemas.compatible_column("AVRO", v, F.col("old"), F.col("new")).alias(v.lower()) for v in ("BACKWARD", "FORWARD", "FULL", "NONE")])


@query(
    "schema_compat_json",
    f"""WITH {PAIRS}, j AS (SELECT i, bool_and(NOT (o AND w) OR NOT other) AS shared, bool_and(NOT (w AND NOT o) OR ndef) AS back, bool_and(NOT (o AND NOT w) OR odef) AS forth FROM p GROUP BY i)
    SELECT i, shared AND back AS backward, shared AND forth AS forward FROM j""",
)
def schema_compat_json(spark, d):
    """All properties are required, so one without a default may not come (backward) or go (forward)."""
    field = lambda n, other, default: F.concat(F.lit(f'"{n}":{{"type":"'), F.when(other, "integer").otherwise("string"), F.lit('"'), F.when(default, ',"default":""').otherwise(""), F.lit("}"))
    p = schema_pairs(spark, field, lambda x: F.concat(F.lit('{"properties":{'), x, F.lit('},"required":["a","b"]}')))
    return p.select("i", *[schemas.compatible_column("JSON", v, F.col("old"), F.col("new")).alias(v.lower()) for v in ("BACKWARD", "FORWARD")])


@query("schema_compat_protobuf", f"WITH {PAIRS} SELECT i, bool_and(NOT (o AND w) OR NOT other) AS compatible FROM p GROUP BY i")
def schema_compat_protobuf(spark, d):
    """Several fields in a line, labels, comments and options; a tag may come, go and change its name, not its type."""
    tags = {"a": 1, "b": 2}
    field = lambda n, other, default: F.concat(F.when(default, "repeated ").otherwise("/* int32 x = 1; */ "), F.when(other, "int64").otherwise("string"), F.when(default, f" {n}1").otherwise(f" {n}2"), F.lit(f" = {tags[n]} [deprecated = true]; // bytes y = 2;\n"))
    p = schema_pairs(spark, field, lambda x: F.concat(F.lit('syntax = "proto3"; message M { reserved 9; '), F.replace(x, F.lit(","), F.lit(" ")), F.lit("}")))
    return p.select("i", schemas.compatible_column("PROTOBUF", "FULL", F.col("old"), F.col("new")).alias("compatible"))


@query("group_coordinators", "WITH n AS (SELECT DISTINCT event_type || '-' || user_id % 50 AS g FROM events), h AS (SELECT g, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(g, ''), lambda c: ascii(c)::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616) AS h FROM n) SELECT g AS group_id, CAST([1, 2, 5, 9, 11][CAST(h % 5 AS INTEGER) + 1] AS INTEGER) AS broker_id FROM h")
def group_coordinators(spark, d):
    from rivulet.functions import hashing

    @F.pandas_udf("int")
    def pick(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: hashing.coordinator(k, [9, 1, 5, 2, 11]))

    e = spark.read.parquet(f"{d.rstrip('/')}/events.parquet").selectExpr("concat(event_type, '-', user_id % 50) AS group_id").distinct()
    return e.select("group_id", pick("group_id").alias("broker_id"))


SETTINGS = [
    ("retention.ms", "5"), ("retention.ms", "-1"), ("retention.ms", "-9223372036854775808"), ("retention.ms", "9223372036854775808"), ("retention.ms", " 5"), ("retention.ms", "1_000"), ("retention.ms", ""), ("segment.bytes", "2147483647"),
    ("segment.bytes", "2147483648"), ("min.cleanable.dirty.ratio", "0.5"), ("min.cleanable.dirty.ratio", "1.5"), ("min.cleanable.dirty.ratio", "x"), ("preallocate", "true"), ("preallocate", "TRUE"), ("cleanup.policy", "anything"),
    ("confluent.value.schema.validation", "true"), ("rivulet.own", "x"), ("no.such", "1"), ("retention.ms", None),
]


@query(
    "topic_settings",
    "SELECT name, value, CASE WHEN name = 'no.such' THEN 'Unknown topic config name: no.such' WHEN value IS NULL THEN NULL WHEN (name = 'retention.ms' AND NOT (regexp_full_match(value, '[+-]?[0-9]+') AND TRY_CAST(value AS BIGINT) IS NOT NULL)) OR (name = 'segment.bytes' AND TRY_CAST(value AS INTEGER) IS NULL) "
    "OR (name LIKE '%ratio' AND NOT coalesce(TRY_CAST(value AS DOUBLE) BETWEEN 0 AND 1, FALSE)) OR (name = 'preallocate' AND value NOT IN ('true', 'false')) THEN 'Invalid value ' || value || ' for configuration ' || name END AS error FROM (VALUES "
    + ", ".join(f"('{k}', {'NULL' if v is None else chr(39) + v + chr(39)})" for k, v in SETTINGS) + ") t(name, value)",
)
def topic_settings(spark, d):
    return spark.createDataFrame([(k, v, connectors.topic_config_error({k: v})) for k, v in SETTINGS], "name string, value string, error string")


@query("sticky_assignment", "SELECT t AS topic, 'm' || lpad(CAST(p % m AS VARCHAR), 2, '0') AS member_id, CAST(p AS INTEGER) AS partition FROM (VALUES ('t5', 5, 2), ('t9', 9, 4), ('t3', 3, 4)) v(t, n, m), range(9) r(p) WHERE p < n")
def sticky_assignment(spark, d):
    """Nothing held: partitions in turn to the least loaded. Assigned again with all held, nothing moves."""
    members = {f"m{i:02d}": {t for t, m in (("t5", 2), ("t9", 4), ("t3", 4)) if i < m} for i in range(4)}
    sizes = {"t5": 5, "t9": 9, "t3": 3}
    held = groups.sticky_assignment(sizes, members, {})
    again = groups.sticky_assignment(sizes, members, held)
    return spark.createDataFrame([(t, m, p) for m, topics in again.items() for t, ps in topics.items() for p in ps], "topic string, member_id string, partition int")


@query("placement_racks", "SELECT CAST(p AS INTEGER) AS partition, 3::BIGINT AS replicas, 3::BIGINT AS racks FROM range(12) r(p)")
def placement_racks(spark, d):
    """Three replicas of each of twelve partitions, never two in a rack while there are three racks."""
    racks = {1: "x", 2: "x", 3: "y", 4: "z", 5: "y", 6: "z"}
    rows = spark.createDataFrame([(p, b, racks[b]) for p, got in enumerate(groups.place_racks(12, racks, 3)) for b in got], "partition int, broker_id int, rack string")
    return rows.groupBy("partition").agg(F.countDistinct("broker_id").alias("replicas"), F.countDistinct("rack").alias("racks"))


@query("schema_registry", "SELECT * FROM (VALUES (1, 'orders', 1, 'AVRO'), (2, 'orders', 2, 'AVRO'), (1, 'copies', 1, 'AVRO'), (3, 'people', 1, 'JSON')) t(id, subject, version, type)")
def schema_registry(spark, d):
    r = schemas.Registry()
    order = '{"type":"record","name":"Order","fields":[{"name":"id","type":"string"},{"name":"amount","type":"double"}]}'
    r.register("orders", "AVRO", order)
    r.register("orders", "AVRO", order.replace("]}", ',{"name":"status","type":"string","default":"new"}]}'))
    r.register("copies", "AVRO", order.replace(":", ": "))
    r.register("people", "JSON", '{"properties":{"id":{"type":"integer"}},"required":["id"]}')
    return r.frame(spark).drop("schema")


PTS = ", ".join(f"min(value) FILTER (rn > least(CAST(floor(n * {p}) AS BIGINT), n - 1)) AS {k}" for k, p in reports.POINTS.items())


@query("latency_percentiles", f"WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, {PTS} FROM r GROUP BY event_type")
def latency_percentiles(spark, d):
    return reports.percentiles(spark.read.parquet(f"{d.rstrip('/')}/events.parquet"), "value", ["event_type"])


@query("throughput_summary", "WITH r AS (SELECT event_type, user_id % 5 AS round, count(*) / 300.0 AS rate, sum(value) * 1024 / 1048576 / 300 AS mb FROM events GROUP BY ALL) SELECT event_type, round(median(rate), 6) AS rate_median, round(min(rate), 6)::DOUBLE AS rate_min, round(max(rate), 6)::DOUBLE AS rate_max, round(median(mb), 6) AS mb_median FROM r GROUP BY event_type")
def throughput_summary(spark, d):
    e = spark.read.parquet(f"{d.rstrip('/')}/events.parquet")
    r = e.groupBy("event_type", F.expr("user_id % 5").alias("round")).agg(F.count("*").alias("messages"), (F.sum("value") * 1024).alias("bytes"), F.lit(300.0).alias("seconds"))
    t = reports.throughput(r, ["event_type"])
    return t.select("event_type", *[F.round(c, 6).alias(c) for c in ("rate_median", "rate_min", "rate_max", "mb_median")])


# ---- streaming: the same jobs over a streamed copy of the log ----------------------------


def streamed(spark, d, build, mode: str) -> DataFrame:
    """Writes the log as files, streams them through ``build`` until all is read, returns what the sink wrote: files,
    as a table in memory would be the driver's."""
    import uuid

    from rivulet.streaming import jobs as stream

    root = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    files = max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a file is read by one task or few
    # by hash: one micro-batch takes all files, and ranges would make the whole log once more for their bounds
    logs.events(spark, d).repartition(files, "arrival_seq").write.parquet(f"{root}/log")
    q = stream.start_files(build(stream.read_log(spark, f"{root}/log")), f"{root}/result", f"{root}/checkpoint", mode)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return stream.read_files(spark, f"{root}/result", mode)


@query("stream_tumbling_update", f"{TUMBLE}, {AGG} FROM ev GROUP BY ALL")
def stream_tumbling_update(spark, d):
    from pyspark.sql import Window

    from rivulet.streaming import jobs as stream

    out = streamed(spark, d, lambda s: stream.aggregate(s, tumbling_job("sum")), "update")
    last = Window.partitionBy("key", "window_start").orderBy(F.desc("batch"))  # the newest update of a window
    return rounded(out.withColumn("rn", F.row_number().over(last)).where("rn = 1"), "key", "window_start", "window_end")


@query("stream_session", SQL["agg_session_avg"])
def stream_session(spark, d):
    from rivulet.streaming import jobs as stream

    job = jobs.JobConfig("s", "AGGREGATE", "events", key_field="user", value_field="amt", agg="avg", window=WindowSpec("session", gap_ms=6 * HOUR))
    return rounded(streamed(spark, d, lambda s: stream.aggregate(s, job), stream.output_mode(job)), "key", "window_start", "window_end")


@query("stream_join_static", SQL["join_left_latest"])
def stream_join_static(spark, d):
    from rivulet.streaming import jobs as stream

    job = jobs.JobConfig("j", "JOIN", "events", key_field="user", table_topic="customers", table_key_field="id", join_type="left")
    return streamed(spark, d, lambda s: stream.join_static(s, customers(spark, d), job), "append").drop("batch")


@query("stream_exact_sliding", f"WITH {EV}, p AS (SELECT a.event_id AS arrival_seq, a.key, a.ts_ms, b.amt FROM ev a JOIN ev b ON a.key = b.key AND b.event_id <= a.event_id AND b.ts_ms > a.ts_ms - {DAY} AND b.ts_ms <= a.ts_ms) SELECT arrival_seq, key, ts_ms - {DAY - 1} AS window_start, ts_ms AS window_end, {AGG} FROM p GROUP BY arrival_seq, key, ts_ms")
def stream_exact_sliding(spark, d):
    job = jobs.JobConfig("x", "AGGREGATE", "events", key_field="user", value_field="amt", agg="sum", window=WindowSpec("sliding", DAY), grace_ms=DAY)
    return rounded(exact(spark, d, logs.events(spark, d), job), "arrival_seq", "key", "window_start", "window_end")


def exact(spark, d, log: DataFrame, job: jobs.JobConfig) -> DataFrame:
    """A job's exact updates over a streamed copy of ``log``, in three micro-batches."""
    import uuid

    from rivulet.streaming import jobs as stream

    root = f"{scratch_root(spark)}/exact-{uuid.uuid4().hex}"
    n = log.agg(F.max("arrival_seq")).first()[0] + 1
    for i in range(3):  # in order of arrival, a file each
        log.where((F.col("arrival_seq") >= n * i // 3) & (F.col("arrival_seq") < n * (i + 1) // 3)).coalesce(1).write.mode("append").parquet(f"{root}/log")
    q = stream.exact_files(stream.read_log(spark, f"{root}/log", max_files=1), job, f"{root}/result", f"{root}/checkpoint")
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(f"{root}/result/out").drop("batch")


@query("stream_exact_late", SQL["changelog_tumbling"])
def stream_exact_late(spark, d):
    """Tumbling updates of the events in their late order: what is late is dropped as a single stream time over all batches says."""
    late = numbered(logs.events(spark, d).withColumn("delayed", F.col("timestamp_ms") + (F.col("arrival_seq") * 7919 % 11) * HOUR), [], ["delayed", "arrival_seq"], "n", DAY)
    late = late.withColumn("arrival_seq", F.col("n")).drop("n", "delayed")
    job = jobs.JobConfig("x", "AGGREGATE", "events", key_field="user", value_field="amt", agg="sum", window=WindowSpec("tumbling", 2 * HOUR), grace_ms=HOUR)
    return rounded(exact(spark, d, late, job), "arrival_seq", "key", "window_start", "window_end")


@query(
    "poll_table_first",
    f"""WITH {TAB}, t AS (SELECT 'customers' AS topic, 0 AS partition, row_number() OVER (ORDER BY arr, key) - 1 AS off FROM tab), a AS (SELECT topic, partition, off, 0 AS side FROM t WHERE off < 70 UNION ALL SELECT 'events', part, off, 1 FROM ev WHERE off >= part * 5 AND off < part * 5 + 70)
    SELECT topic, partition, off AS offset, row_number() OVER (ORDER BY side, topic, partition, off) - 1 AS arrival_seq FROM a""",
)
def poll_table_first(spark, d):
    """One pass of at most 70 entries a partition: the table's topic first, the stream from where the last pass ended."""
    e = logs.events(spark, d).select("topic", "partition", "offset", "arrival_seq", F.col("key").cast("string").alias("key"))
    c = customers(spark, d).withColumn("k", F.col("key").cast("string"))
    c = numbered(c, [], ["arrival_seq", "k"], "n").selectExpr("'customers' AS topic", "0 AS partition", "n - 1 AS offset", "arrival_seq", "k AS key")
    at = spark.createDataFrame([("events", p, 5 * p) for p in range(1, 4)], "topic string, partition int, next_offset long")
    job = jobs.JobConfig("j", "JOIN", "events", table_topic="customers", table_key_field="id")
    return jobs.poll(e.unionByName(c), job, at, 70)[0].select("topic", "partition", "offset", "arrival_seq")


@query("table_sink_snapshots", f"WITH {EV} SELECT part AS partition, off AS offset, event_type AS type, amt FROM ev")
def table_sink_snapshots(spark, d):
    import uuid

    t = tables.SnapshotTable(spark, f"{scratch_root(spark)}/table-{uuid.uuid4().hex}")
    e = logs.events(spark, d)
    fields = {"type": "string", "amt": "double"}
    t.commit(e.where("offset < 100"), fields)
    while t.commit(e, fields, max_rows=1 << 40):
        pass
    return t.read().select("partition", "offset", "type", "amt")
