"""Connector registry: lifecycle and configuration checks. Data moves through Spark's own sources."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Plugin -> (kind, required setting, settings with defaults) (fixed values).
PLUGINS = {
    "HttpWebhookSinkConnector": ("sink", "http.url", {"http.method": "POST"}),
    "S3ArchivalSinkConnector": ("sink", "s3.bucket", {"s3.region": "us-east-1"}),
    "DatabaseCdcSourceConnector": ("source", "db.host", {"db.port": "5432"}),
    "ElasticSearchSinkConnector": ("sink", "es.host", {"es.index": "default-index"}),
}


def validate(plugin: str, config: dict[str, str]) -> dict[str, list[str]]:
    """Errors of every setting, known or given, in order; raises for an unknown plugin."""
    name = next((p for p in PLUGINS if plugin.lower() == p.lower() or plugin.endswith("." + p)), None)
    if name is None:
        raise KeyError(f"plugin not found: {plugin}")
    kind, required, defaults = PLUGINS[name]
    missing = lambda k: [] if config.get(k) else [f'Missing required configuration "{k}" which has no default value.']
    out = {k: missing(k) for k in ("name", "connector.class")}
    tasks = config.get("tasks.max", "1")
    ok = not tasks or (tasks.lstrip("+").isdigit() and int(tasks) > 0)
    out["tasks.max"] = [] if ok else [f"Invalid value {tasks} for configuration tasks.max: Not a positive integer"]
    if kind == "sink":
        out["topics"] = [] if any(config.get(k) for k in ("topics", "topic", "topics.regex")) else missing("topics")
    out[required] = missing(required)
    return out | {k: [] for k in defaults} | {k: [] for k in sorted(config) if k not in out and k not in defaults}


#: Broker-side topic settings by kind of value (fixed values).
TOPIC_SETTINGS = {
    "long": ("delete.retention.ms", "file.delete.delay.ms", "flush.messages", "flush.ms", "max.compaction.lag.ms", "min.compaction.lag.ms", "retention.bytes", "retention.ms", "segment.jitter.ms", "segment.ms"),
    "int": ("index.interval.bytes", "max.message.bytes", "min.insync.replicas", "segment.bytes", "segment.index.bytes"),
    "ratio": ("min.cleanable.dirty.ratio",),
    "boolean": ("preallocate", "unclean.leader.election.enable"),
    "any": (
        "cleanup.policy", "compression.type", "message.timestamp.type", "message.format.version", "message.timestamp.difference.max.ms", "message.downconversion.enable",
        "follower.replication.throttled.replicas", "leader.replication.throttled.replicas", "remote.storage.enable", "local.retention.ms", "local.retention.bytes",
        "iceberg.enabled", "iceberg.catalog", "iceberg.table", "confluent.value.schema.validation",
    ),
}


def topic_config_error(config: dict[str, str | None], own_prefix: str = "rivulet.") -> str | None:
    """First unknown name or bad value; None if all are good. Names under the broker's ``own_prefix`` are let
    through. Whole numbers are an optional sign and
    ASCII digits, within 64 or 32 bits; ratios lie between 0 and 1."""
    kinds = {k: kind for kind, names in TOPIC_SETTINGS.items() for k in names}

    def good(kind: str, v: str) -> bool:
        if kind in ("long", "int"):
            top = 1 << (63 if kind == "long" else 31)
            return bool(re.fullmatch(r"[+-]?[0-9]+", v)) and -top <= int(v) < top
        if kind == "ratio":
            return bool(re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", v)) and 0.0 <= float(v) <= 1.0
        return kind != "boolean" or v in ("true", "false")

    for k, v in config.items():
        if k not in kinds and not k.startswith(own_prefix):
            return f"Unknown topic config name: {k}"
        if v is not None and not good(kinds.get(k, "any"), v):
            return f"Invalid value {v} for configuration {k}"
    return None


@dataclass
class Task:
    id: int
    state: str = "RUNNING"
    trace: str = ""


@dataclass
class Connector:
    name: str
    plugin: str
    config: dict[str, str]
    state: str = "RUNNING"
    topics: set[str] = field(default_factory=set)
    tasks: list[Task] = field(default_factory=list)
    error: str = ""


class Connectors:
    """register, list, status, pause, resume, stop, fail, restart (of a connector, its tasks or one), delete."""

    def __init__(self) -> None:
        self._by: dict[str, Connector] = {}

    def register(self, name: str, plugin: str, config: dict[str, str]) -> Connector:
        if name in self._by:
            raise KeyError(f"connector {name!r} exists")
        wrong = [e for es in validate(plugin, {"name": name, "connector.class": plugin} | config).values() for e in es]
        if wrong:
            raise ValueError("; ".join(wrong))
        topics = {t.strip() for t in config.get("topics", config.get("topic", "")).split(",") if t.strip()}
        self._by[name] = Connector(name, plugin, config, topics=topics, tasks=[Task(i) for i in range(int(config.get("tasks.max") or 1))])
        return self._by[name]

    def list(self) -> list[str]:
        return sorted(self._by)

    def status(self, name: str) -> Connector:
        return self._by[name]

    def _set(self, name: str, state: str) -> None:
        c = self._by[name]
        c.state = state
        for t in c.tasks:
            t.state = state

    def pause(self, name: str) -> None:
        self._set(name, "PAUSED")

    def resume(self, name: str) -> None:
        self._set(name, "RUNNING")

    def stop(self, name: str) -> None:
        self._set(name, "STOPPED")

    def fail(self, name: str, error: str, task: int | None = None) -> None:
        c = self._by[name]
        if task is None:
            c.state, c.error = "FAILED", error
        else:
            c.tasks[task].state, c.tasks[task].trace = "FAILED", error

    def restart(self, name: str, *, include_tasks: bool = False, only_failed: bool = False) -> None:
        """The connector, with its tasks if asked; ``only_failed`` leaves alone whatever has not failed."""
        c = self._by[name]
        if not only_failed or c.state == "FAILED":
            c.state, c.error = "RUNNING", ""
        for t in c.tasks if include_tasks else ():
            if not only_failed or t.state == "FAILED":
                t.state, t.trace = "RUNNING", ""

    def restart_task(self, name: str, task: int) -> None:
        c = self._by[name]
        if not 0 <= task < len(c.tasks):
            raise KeyError(f"connector {name!r} has no task {task}")
        c.tasks[task].state, c.tasks[task].trace = "RUNNING", ""

    def delete(self, name: str) -> None:
        del self._by[name]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """What a registered source reads: its ``format`` (of :data:`FORMATS`) at its ``path``."""
        c = self._by[name]
        if c.state != "RUNNING":
            raise ValueError(f"connector {name!r} is {c.state}")
        return FORMATS[c.config["format"]](spark, c.config["path"])


#: Formats that Spark reads itself, from any file system it reaches; others need their jar on the class path.
FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parquet": lambda s, p: s.read.parquet(p),
    "json": lambda s, p: s.read.json(p),
    "csv": lambda s, p: s.read.option("header", True).csv(p),
    "orc": lambda s, p: s.read.orc(p),
    "text": lambda s, p: s.read.text(p),
}
