"""Analytical tables fed from topics: typed projection, snapshots with source offsets."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import jsonpath as J
from rivulet.operators.ranges import numbered
from rivulet.sources import avro


def headers_json() -> Column:
    """Headers as ``[{"key", "value"}]`` with the bytes read as UTF-8."""
    pairs = F.transform("headers", lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value")))
    return F.when(F.col("headers").isNotNull(), F.to_json(pairs))


def project(log: DataFrame, fields: dict[str, str | tuple[str, str]] | None = None) -> DataFrame:
    """System columns, and typed top-level JSON fields if named (column -> string, long, int,
    double or boolean, or a pair of the field's name and one of these; null on mismatch)."""
    specs = {c: (c, x) if isinstance(x, str) else x for c, x in (fields or {}).items()}
    v = J.parse(F.col("value"))
    return log.select(
        "topic", "partition", "offset", F.timestamp_millis("timestamp_ms").alias("timestamp"), "key", "value", headers_json().alias("headers"),
        *[J.typed(v, name, kind).alias(c) for c, (name, kind) in specs.items()],
    )


#: Field ids of the system columns; JSON columns follow from 10 on (fixed values).
SYSTEM = {"partition": (1, "int"), "offset": (2, "long"), "timestamp": (3, "timestamptz"), "key": (4, "binary"), "value": (5, "binary"), "headers": (6, "string")}
FIRST_JSON = 10


def _field(name: str, number: int, kind, default: bool = False) -> dict:
    return {"name": name, "type": ["null", kind] if default else kind, "field-id": number} | ({"default": None} if default else {})


def _record(name: str, *fields: dict) -> dict:
    return {"type": "record", "name": name, "fields": list(fields)}


#: Avro schemas of a manifest's entries and of a manifest list, format version 2 (fixed values).
MANIFEST = _record(
    "manifest_entry",
    _field("status", 0, "int"), _field("snapshot_id", 1, "long", True), _field("sequence_number", 3, "long", True), _field("file_sequence_number", 4, "long", True),
    _field("data_file", 2, _record("r2", _field("content", 134, "int"), _field("file_path", 100, "string"), _field("file_format", 101, "string"), _field("partition", 102, _record("r102")), _field("record_count", 103, "long"), _field("file_size_in_bytes", 104, "long"))),
)
MANIFEST_LIST = _record(
    "manifest_file",
    _field("manifest_path", 500, "string"), _field("manifest_length", 501, "long"), _field("partition_spec_id", 502, "int"), _field("content", 517, "int"), _field("sequence_number", 515, "long"), _field("min_sequence_number", 516, "long"),
    _field("added_snapshot_id", 503, "long"), _field("added_files_count", 504, "int"), _field("existing_files_count", 505, "int"), _field("deleted_files_count", 506, "int"),
    _field("added_rows_count", 512, "long"), _field("existing_rows_count", 513, "long"), _field("deleted_rows_count", 514, "long"),
)


class Files:
    """Small files below a path of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.io = spark._jvm.org.apache.commons.io.IOUtils

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.hadoop(path))

    def read(self, path: str) -> bytes:
        f = self.fs.open(self.hadoop(path))
        try:
            return bytes(self.io.toByteArray(f))
        finally:
            f.close()

    def write(self, path: str, data: bytes, *, overwrite: bool = False) -> None:
        """Fails if the file is there, unless told to overwrite it."""
        f = self.fs.create(self.hadoop(path), overwrite)
        try:
            f.write(bytearray(data))
        finally:
            f.close()

    def list(self, path: str) -> list[tuple[str, int]]:
        """(path, bytes) of the Parquet files of a folder."""
        return [(x.getPath().toString(), x.getLen()) for x in self.fs.listStatus(self.hadoop(path)) if x.getPath().getName().endswith(".parquet")]


class SnapshotTable:
    """An append-only table of the open table format, version 2: Parquet files with field ids below ``data``, and below
    ``metadata`` manifests, manifest lists, a JSON document for each version and a hint to the last.

    A commit writes one manifest of the files it adds and a list of that and all manifests before, then the next
    version's document, which must not be there yet: of two writers one fails. The next offset of every
    source partition is a property of the table, so a commit resumes where the last one ended, and a
    failed one leaves files that no snapshot names. Readers see named files only. Everything is read and
    written through Spark's file systems. There is no schema evolution: the fields are those of the first commit.
    """

    OFFSETS = "rivulet.source-offsets"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def metadata(self) -> dict | None:
        """The document of the last version; None before the first commit."""
        hint = f"{self.path}/metadata/version-hint.text"
        if not self.files.exists(hint):
            return None
        n = int(self.files.read(hint))
        while self.files.exists(f"{self.path}/metadata/v{n + 1}.metadata.json"):  # a writer that had no time to move the hint
            n += 1
        return json.loads(self.files.read(f"{self.path}/metadata/v{n}.metadata.json")) | {"version": n}

    def snapshots(self) -> DataFrame:
        """snapshot_id, parent, sequence, added, total and committed_ms of every snapshot."""
        rows = [
            (x["snapshot-id"], x.get("parent-snapshot-id"), x["sequence-number"], int(x["summary"]["added-records"]), int(x["summary"]["total-records"]), x["timestamp-ms"])
            for x in (self.metadata() or {"snapshots": []})["snapshots"]
        ]
        return self.spark.createDataFrame(rows, "snapshot_id long, parent long, sequence long, added long, total long, committed_ms long")

    def commit(self, log: DataFrame, fields: dict[str, str] | None = None, max_rows: int = 100_000) -> dict | None:
        """Rows after the last committed offsets, at most ``max_rows`` in order of topic,
        partition and offset; the rest waits for the next commit. None if there is nothing."""
        before = self.metadata()
        done = {tuple(k.rsplit("/", 1)): v for k, v in json.loads(before["properties"][self.OFFSETS]).items()} if before else {}
        marks = self.spark.createDataFrame([(t, int(p), o) for (t, p), o in done.items()], "topic string, partition int, next long")
        new = log.join(F.broadcast(marks), ["topic", "partition"], "left").where("next IS NULL OR offset >= next").drop("next")  # a row a partition
        left, cut = max_rows, []
        spans = new.groupBy("topic", "partition").agg(F.count("*").alias("n")).orderBy("topic", "partition").collect()
        for s in spans:  # one row a partition
            cut.append((s.topic, s.partition, min(s.n, left), s.n))
            left -= min(s.n, left)
        takes = self.spark.createDataFrame([c for c in cut if c[2]], "topic string, partition int, take long, n long")
        if not any(c[2] for c in cut):
            return None
        rows = new.join(F.broadcast(takes), ["topic", "partition"])
        if any(0 < c[2] < c[3] for c in cut):
            rows = numbered(rows, ["topic", "partition"], ["offset"], "__rn").where("__rn <= take").drop("__rn")
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        out = project(rows.drop("take", "n"), fields)
        ids = {k: i for k, (i, _) in SYSTEM.items()} | {k: FIRST_JSON + i for i, k in enumerate(fields or {})}
        self._write(out.select("topic", *[F.col(c).alias(c, metadata={"parquet.field.id": i}) for c, i in ids.items()]), folder)
        # counts and ends of what was written, by file: the driver sees a row for each file and partition
        back = self.spark.read.parquet(folder).select("topic", "partition", "offset", F.col("_metadata.file_path").alias("f"))
        ends = back.groupBy("topic", "partition").agg(F.max("offset").alias("o")).collect()
        counts = {r.f.rsplit("/", 1)[1]: r.n for r in back.groupBy("f").agg(F.count("*").alias("n")).collect()}
        done |= {(r.topic, str(r.partition)): r.o + 1 for r in ends}
        return self._snapshot(before, folder, counts, {f"{t}/{p}": o for (t, p), o in sorted(done.items())}, fields or {})

    def _write(self, out: DataFrame, folder: str) -> None:
        key = "spark.sql.parquet.outputTimestampType"
        old = self.spark.conf.get(key)
        self.spark.conf.set(key, "TIMESTAMP_MICROS")  # the format knows no other
        try:
            out.write.parquet(folder)
        finally:
            self.spark.conf.set(key, old)

    def _snapshot(self, before: dict | None, folder: str, counts: dict[str, int], offsets: dict[str, int], fields: dict[str, str]) -> dict:
        now, version = int(time.time() * 1000), before["version"] + 1 if before else 1
        sid, sequence = uuid.uuid4().int >> 65, before["last-sequence-number"] + 1 if before else 1
        parent = before["snapshots"][-1] if before else None
        kinds = {"string": "string", "long": "long", "int": "int", "double": "double", "boolean": "boolean"}
        kind_of = lambda x: kinds[x if isinstance(x, str) else x[1]]
        columns = [{"id": i, "name": k, "required": False, "type": t} for k, (i, t) in SYSTEM.items()] + [{"id": FIRST_JSON + i, "name": k, "required": False, "type": kind_of(x)} for i, (k, x) in enumerate(fields.items())]
        schema = {"type": "struct", "schema-id": 0, "fields": columns}
        meta = f"{self.path}/metadata"
        files = [(f, n) for f, n in self.files.list(folder) if f.rsplit("/", 1)[1] in counts]
        entries = [
            {"status": 1, "snapshot_id": sid, "data_file": {"content": 0, "file_path": f, "file_format": "PARQUET", "partition": {}, "record_count": counts[f.rsplit("/", 1)[1]], "file_size_in_bytes": n}}
            for f, n in files
        ]
        about = {"schema": json.dumps(schema), "schema-id": "0", "partition-spec": "[]", "partition-spec-id": "0", "format-version": "2", "content": "data"}
        manifest = avro.write(MANIFEST, entries, about)
        at = f"{meta}/{uuid.uuid4().hex}-m0.avro"
        self.files.write(at, manifest)
        added = sum(counts.values())
        mine = {"manifest_path": at, "manifest_length": len(manifest), "partition_spec_id": 0, "content": 0, "sequence_number": sequence, "min_sequence_number": sequence, "added_snapshot_id": sid, "added_files_count": len(files), "existing_files_count": 0, "deleted_files_count": 0, "added_rows_count": added, "existing_rows_count": 0, "deleted_rows_count": 0}
        older = avro.read(self.files.read(parent["manifest-list"]))[0] if parent else []
        listed = f"{meta}/snap-{sid}-1-{uuid.uuid4().hex}.avro"
        self.files.write(listed, avro.write(MANIFEST_LIST, [*older, mine], {"snapshot-id": str(sid), "sequence-number": str(sequence), "format-version": "2"} | ({"parent-snapshot-id": str(parent["snapshot-id"])} if parent else {})))
        total = added + (int(parent["summary"]["total-records"]) if parent else 0)
        summary = {"operation": "append", "added-data-files": str(len(files)), "added-records": str(added), "total-records": str(total), "total-data-files": str(len(files) + (int(parent["summary"]["total-data-files"]) if parent else 0))}
        snap = {"snapshot-id": sid, "sequence-number": sequence, "timestamp-ms": now, "manifest-list": listed, "summary": summary, "schema-id": 0} | ({"parent-snapshot-id": parent["snapshot-id"]} if parent else {})
        doc = {
            "format-version": 2, "table-uuid": before["table-uuid"] if before else str(uuid.uuid4()), "location": self.path, "last-sequence-number": sequence, "last-updated-ms": now, "last-column-id": max(c["id"] for c in columns),
            "current-schema-id": 0, "schemas": [before["schemas"][0] if before else schema], "default-spec-id": 0, "partition-specs": [{"spec-id": 0, "fields": []}], "last-partition-id": 999,
            "default-sort-order-id": 0, "sort-orders": [{"order-id": 0, "fields": []}], "properties": {self.OFFSETS: json.dumps(offsets)}, "current-snapshot-id": sid, "refs": {"main": {"snapshot-id": sid, "type": "branch"}},
            "snapshots": [*(before["snapshots"] if before else []), snap], "snapshot-log": [*(before["snapshot-log"] if before else []), {"timestamp-ms": now, "snapshot-id": sid}],
            "metadata-log": [*before["metadata-log"], {"timestamp-ms": before["last-updated-ms"], "metadata-file": f"{meta}/v{version - 1}.metadata.json"}] if before else [],
        }
        self.files.write(f"{meta}/v{version}.metadata.json", json.dumps(doc).encode())
        self.files.write(f"{meta}/version-hint.text", str(version).encode(), overwrite=True)
        return {"snapshot_id": sid, "parent": snap.get("parent-snapshot-id"), "sequence": sequence, "added": added, "total": total}

    def data_files(self, sequence: int | None = None) -> list[str]:
        """Paths of the files of a snapshot, by default the last."""
        meta = self.metadata()
        snaps = [x for x in meta["snapshots"] if sequence is None or x["sequence-number"] <= sequence] if meta else []
        if not snaps:
            return []
        manifests = avro.read(self.files.read(snaps[-1]["manifest-list"]))[0]
        return [e["data_file"]["file_path"] for m in manifests for e in avro.read(self.files.read(m["manifest_path"]))[0] if e["status"] != 2]

    def read(self, sequence: int | None = None) -> DataFrame:
        """The table as of a snapshot, by default the last."""
        return self.spark.read.parquet(*self.data_files(sequence))


def sink(table: SnapshotTable, fields: dict[str, str] | None = None):
    """``foreachBatch`` function that commits every micro-batch; replayed offsets are skipped."""
    return lambda batch, _: table.commit(batch, fields, max_rows=1 << 62) and None
