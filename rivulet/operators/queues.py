"""Share groups: a partition consumed as a queue, replayed from its events; dead letters."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.session import ship

#: Acknowledgement types (fixed values).
GAP, ACCEPT, RELEASE, REJECT, RENEW = 0, 1, 2, 3, 4


@dataclass
class SharePartition:
    """State of one share partition, advanced event by event."""

    max_attempts: int = 5
    lock_ms: int = 30_000
    max_in_flight: int = 2000
    start: int = 0
    end: int = 0
    due: float = float("inf")  # no lock ends before
    records: dict[int, list] = field(default_factory=dict)  # offset -> [state, deliveries, member, deadline, reason]

    def acquire(self, member: str, now: int, high: int, limit: int, skipped: frozenset[int] = frozenset(), sizes: dict[int, int] | None = None, max_bytes: float = float("inf")) -> list[int]:
        """Available records first, then new ones below ``high``, until ``limit`` records or ``max_bytes`` bytes (one
        record at least); skipped offsets are archived without being delivered."""
        got, used = [], 0
        self.due = min(self.due, now + self.lock_ms)
        room = min(limit, self.max_in_flight - sum(r[0] == "acquired" for r in self.records.values()))
        offsets = sorted(o for o, r in self.records.items() if r[0] == "available")
        while len(got) < room and not (got and used >= max_bytes):
            if offsets:
                o = offsets.pop(0)
            elif self.end < high:
                o, self.end = self.end, self.end + 1
                if o in skipped:
                    self.records[o] = ["archived", 0, None, 0, None]
                    continue
            else:
                break
            n = self.records.get(o, [None, 0])[1] + 1
            self.records[o] = ["acquired", n, member, now + self.lock_ms, None]
            used += sizes.get(o, 0) if sizes else 0
            got.append(o)
        self.trim()
        return got

    def acknowledge(self, member: str, first: int, last: int, kind: int, now: int) -> bool:
        """All or nothing: every offset must be acquired by the member."""
        mine = [self.records.get(o) for o in range(first, last + 1)]
        if last < first or kind not in (GAP, ACCEPT, RELEASE, REJECT, RENEW) or any(r is None or r[0] != "acquired" or r[2] != member for r in mine):
            return False
        for r in mine:
            if kind == RENEW:
                r[3] = now + self.lock_ms
            elif kind == RELEASE:
                self.release(r)
            else:
                r[0], r[2] = "acknowledged" if kind == ACCEPT else "archived", None
                r[4] = "rejected" if kind == REJECT else None
        self.trim()
        return True

    def release(self, r: list) -> None:
        r[2], r[3] = None, 0
        if r[1] >= self.max_attempts:
            r[0], r[4] = "archived", "delivery-limit-exceeded"
        else:
            r[0] = "available"

    def expire(self, now: int) -> None:
        if now >= self.due:
            for r in self.records.values():
                if r[0] == "acquired" and r[3] <= now:
                    self.release(r)
            self.due = min((r[3] for r in self.records.values() if r[0] == "acquired"), default=float("inf"))
        self.trim()

    def trim(self) -> None:
        while (r := self.records.get(self.start)) and r[0] in ("acknowledged", "archived"):
            self.start += 1


def undeliverable(log: DataFrame, transactions: DataFrame | None = None) -> DataFrame:
    """(topic, partition, offset) that a share group must not deliver: control records and, for readers of
    committed data, records of aborted ``transactions``."""
    out = log.where("is_control").select("topic", "partition", "offset")
    if transactions is not None:
        gone = transactions.where("state = 'aborted'").select("topic", "partition", "producer_id", F.explode(F.sequence("first_offset", F.col("last_offset") - 1)).alias("offset"))
        out = out.unionByName(log.where("is_transactional AND NOT is_control").join(gone, ["topic", "partition", "producer_id", "offset"], "left_semi").select("topic", "partition", "offset"))
    return out


def replay(events: DataFrame, max_attempts: int = 5, lock_ms: int = 30_000, *, max_in_flight: int = 2000, skipped: DataFrame | None = None, sizes: DataFrame | None = None, max_bytes: float = float("inf")) -> DataFrame:
    """Final record states of every (group_id, topic, partition) from its events in order.

    events: group_id, topic, partition, seq, now_ms, kind (acquire, ack, tick), member,
    first, last (for acquire: the bound, which is the high watermark or for readers of committed data the last
    stable offset, and most records), ack_type. skipped: (topic, partition, offset) that are archived without
    delivery (:func:`undeliverable`, and offsets that the log no longer has). sizes: (topic, partition, offset,
    bytes), against which an acquire's ``max_bytes`` is counted. A share
    partition is one fold, as each event depends on the ones before.
    """
    schema = "group_id string, topic string, partition int, offset long, state string, delivery_count int, reason string, start_offset long, end_offset long"
    cols = ["group_id", "topic", "partition", "seq", "now_ms", "kind", "member", "first", "last", "ack_type"]
    each = events.select("group_id", "topic", "partition").distinct()
    for more, kind, value in ((skipped, "skip", F.lit(0).cast("long")), (sizes, "size", F.col("bytes").cast("long") if sizes is not None else None)):
        if more is not None:
            rows = more.join(each, ["topic", "partition"]).select("group_id", "topic", "partition", F.lit(-1).cast("long").alias("seq"), F.lit(0).cast("long").alias("now_ms"), F.lit(kind).alias("kind"), F.lit("").alias("member"), F.col("offset").alias("first"), value.alias("last"), F.lit(0).alias("ack_type"))
            events = events.select(*cols).unionByName(rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = SharePartition(max_attempts, lock_ms, max_in_flight)
        skip = frozenset(pdf["first"][pdf.kind == "skip"].astype(int))
        given = pdf[pdf.kind == "size"]
        bytes_ = dict(zip(given["first"].astype(int), given["last"].astype(int), strict=True))
        head = tuple(pdf[["group_id", "topic", "partition"]].iloc[0])
        for e in pdf[~pdf.kind.isin(["skip", "size"])].sort_values("seq").itertuples():
            s.expire(e.now_ms)
            if e.kind == "acquire":
                s.acquire(e.member, e.now_ms, int(e.first), int(e.last), skip, bytes_, max_bytes)
            elif e.kind == "ack":
                s.acknowledge(e.member, int(e.first), int(e.last), int(e.ack_type), e.now_ms)
        rows = [(*head, o, r[0], r[1], r[4], s.start, s.end) for o, r in sorted(s.records.items())]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    ship(events.sparkSession)
    return events.groupBy("group_id", "topic", "partition").applyInPandas(run, schema)


def state_counts(state: DataFrame) -> DataFrame:
    names = ("available", "acquired", "acknowledged", "archived")
    return state.groupBy("group_id", "topic", "partition").agg(*[F.count_if(F.col("state") == n).alias(n) for n in names])


def dead_letters(state: DataFrame, log: DataFrame, template: str = "{topic}.{group}.dlq") -> DataFrame:
    """Archived records with a reason, copied to their dead-letter topic with five headers;
    none where that is the source topic."""
    gone = state.where("state = 'archived' AND reason IS NOT NULL").select("group_id", "topic", "partition", "offset", "reason")
    to = F.replace(F.replace(F.lit(template), F.lit("{topic}"), F.col("topic")), F.lit("{group}"), F.col("group_id"))

    def header(k: str, v: Column) -> Column:
        return F.struct(F.lit(k).alias("key"), v.cast("string").cast("binary").alias("value"))

    extra = F.array(
        header("x-original-topic", F.col("topic")), header("x-original-partition", F.col("partition")), header("x-original-offset", F.col("offset")),
        header("x-share-group", F.col("group_id")), header("x-dlq-reason", F.col("reason")),
    )
    rows = log.join(gone, ["topic", "partition", "offset"])
    none = F.array().cast("array<struct<key:string,value:binary>>")
    return rows.select(to.alias("dlq_topic"), "topic", "partition", "offset", "key", "value", F.concat(F.coalesce("headers", none), extra).alias("headers"), "reason").where("dlq_topic <> topic")
