"""Log maintenance and visibility: compaction, de-duplication, transactions, watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.session import ship
from rivulet.sources.log import entry_bytes

DAY_MS = 86_400_000


def is_null_value(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0)) == 0


def _closed(segmented: DataFrame) -> DataFrame:
    """Adds closed (segment before the last) and the latest closed offset of the row's key.

    The latest offset is a partial aggregate joined back, not a window over the key, so
    a key with very many records is combined map-side and its join can be split.
    """
    last = segmented.groupBy("topic", "partition").agg(F.max("segment_id").alias("active"))
    rows = segmented.join(last, ["topic", "partition"]).withColumn("closed", F.col("segment_id") < F.col("active")).drop("active")
    latest = rows.where("closed AND key IS NOT NULL AND NOT is_control").groupBy("topic", "partition", "key").agg(F.max("offset").alias("latest"))
    return rows.join(latest, ["topic", "partition", "key"], "left")


def compact(segmented: DataFrame, now_ms: int, tombstone_retention_ms: int = DAY_MS) -> DataFrame:
    """Latest record per key of the closed segments, offsets as they were.

    The last segment passes untouched and supersedes nothing. Keyless and control records
    stay. A latest tombstone stays until it is older than the retention.
    """
    rows = _closed(segmented)
    kept = F.col("key").isNull() | F.col("is_control") | (F.col("offset") == F.col("latest"))
    dead = is_null_value(F.col("value")) & F.col("key").isNotNull() & ~F.col("is_control") & (F.lit(now_ms) - F.col("timestamp_ms") > tombstone_retention_ms)
    return rows.where(~F.col("closed") | (kept & ~dead)).select(*segmented.columns)


def dirty_ratio(segmented: DataFrame, now_ms: int, tombstone_retention_ms: int = DAY_MS) -> DataFrame:
    """Superseded or expired bytes over all bytes of the closed segments, per partition; 0 without keys."""
    rows = _closed(segmented).where("closed")
    keyed = F.col("key").isNotNull() & ~F.col("is_control")
    dead = is_null_value(F.col("value")) & (F.lit(now_ms) - F.col("timestamp_ms") > tombstone_retention_ms)
    gone = F.coalesce(keyed & ((F.col("offset") < F.col("latest")) | dead), F.lit(False))
    size = entry_bytes()
    return rows.groupBy("topic", "partition").agg(
        F.sum(F.when(gone, size).otherwise(0)).alias("dirty_bytes"), F.sum(size).alias("total_bytes"), F.countDistinct("key").alias("keys")
    ).withColumn("ratio", F.coalesce(F.try_divide(F.col("dirty_bytes").cast("double"), F.col("total_bytes")), F.lit(0.0)))


def needs_compaction(ratios: DataFrame, threshold: float = 0.5) -> DataFrame:
    return ratios.where(F.col("ratio") >= threshold)


def dedup(log: DataFrame) -> DataFrame:
    """Adds status accepted, duplicate, gap or fenced for idempotent producers, by arrival.

    A record is accepted if it continues the run of its producer's epoch (or begins a new, higher
    epoch at 0); a sequence accepted before is a duplicate, a later one a gap until what is missing
    arrives, and a record of an older epoch is fenced. Producers whose sequences arrive in order but for
    repeats, nearly all, are decided by windows; those with any gap go to :func:`dedup_fold`, without payloads.
    Records of a producer that arrive together are taken by epoch and sequence; each has a status of its own.
    """
    who, turn = ["topic", "partition", "producer_id"], ["arrival_seq", "producer_epoch", "sequence"]
    by = Window.partitionBy(*who).orderBy(*turn).rowsBetween(Window.unboundedPreceding, 0)
    epoch = Window.partitionBy(*who, "producer_epoch").orderBy(*turn).rowsBetween(Window.unboundedPreceding, -1)
    slim = log.select(*who, "producer_epoch", "sequence", "arrival_seq").withColumn("__top", F.max("producer_epoch").over(by))
    slim = slim.withColumn("__seen", F.coalesce(F.max("sequence").over(epoch), F.lit(-1)))
    jump = (F.col("sequence") > F.col("__seen") + 1) & (F.col("producer_epoch") == F.col("__top"))
    slim = slim.withColumn("__jump", F.max(jump.cast("int")).over(Window.partitionBy(*who)) == 1)
    status = F.when(F.col("producer_epoch") < F.col("__top"), "fenced").when(F.col("sequence") <= F.col("__seen"), "duplicate").otherwise("accepted")
    plain = slim.where("NOT __jump").select(*who, *turn, status.alias("status"))
    decided = plain.unionByName(dedup_fold(slim.where("__jump")))
    # arrival_seq need not tell a producer's records apart: those of one arrival are matched by their place in it
    together = decided.groupBy(*who, "arrival_seq").agg(F.sort_array(F.collect_list(F.struct(*turn[1:], "status"))).alias("__s"))
    place = F.row_number().over(Window.partitionBy(*who, "arrival_seq").orderBy(*turn[1:]))
    out = log.withColumn("__place", place).join(together, [*who, "arrival_seq"])
    return out.select(*log.columns, F.get("__s", F.col("__place") - 1)["status"].alias("status"))


def dedup_fold(log: DataFrame) -> DataFrame:
    """(topic, partition, producer_id, arrival_seq, producer_epoch, sequence, status) for any order of arrival:
    a fold per producer, after a gap accepting again once the missing sequence arrives. With a record_count
    column a row is a batch of so many sequences from its own on."""
    schema = "topic string, partition int, producer_id long, arrival_seq long, producer_epoch int, sequence int, status string"

    def run(pdf):
        pdf = pdf.sort_values(["arrival_seq", "producer_epoch", "sequence"], na_position="first")
        epoch, last, out = None, -1, []
        for e, s, n in zip(pdf.producer_epoch, pdf.sequence, pdf.record_count, strict=True):
            n = max(1, n)
            if epoch is not None and e < epoch:
                out.append("fenced")
            elif epoch is None or e > epoch:
                out.append("accepted" if s == 0 else "gap")
                if s == 0:
                    epoch, last = e, n - 1
            elif s == last + 1:
                last = s + n - 1
                out.append("accepted")
            else:
                out.append("duplicate" if s <= last else "gap")
        return pdf.assign(status=out)[["topic", "partition", "producer_id", "arrival_seq", "producer_epoch", "sequence", "status"]]

    count = F.col("record_count").cast("int") if "record_count" in log.columns else F.lit(1)
    ship(log.sparkSession)
    rows = log.select("topic", "partition", "producer_id", "producer_epoch", "sequence", "arrival_seq", F.coalesce(count, F.lit(1)).alias("record_count"))
    return rows.groupBy("topic", "partition", "producer_id").applyInPandas(run, schema)


def split_batches(batches: DataFrame) -> DataFrame:
    """One entry per record of a batch (records array), offsets and sequences counted on."""
    rows = batches.select("*", F.posexplode("records").alias("__i", "__r"))
    return rows.withColumn("offset", F.col("base_offset") + F.col("__i")).withColumn("sequence", F.col("base_sequence") + F.col("__i")).select("*", "__r.*").drop("__i", "__r", "records")


def last_stable_offset(ends: DataFrame, transactions: DataFrame) -> DataFrame:
    """ends: topic, partition, high_watermark. transactions: topic, partition, producer_id,
    first_offset, last_offset (exclusive; the marker), state ongoing, committed or aborted."""
    open_ = transactions.where("state = 'ongoing'").groupBy("topic", "partition").agg(F.min("first_offset").alias("first_open"))
    return ends.join(open_, ["topic", "partition"], "left").select("topic", "partition", "high_watermark", F.least("high_watermark", "first_open").alias("lso"))


def aborted_ranges(transactions: DataFrame, from_offset: int, to_offset: int) -> DataFrame:
    """Aborted transactions that overlap [from, to)."""
    return transactions.where((F.col("state") == "aborted") & (F.col("first_offset") < to_offset) & (F.col("last_offset") > from_offset))


#: Offsets that share a join key in :func:`read_committed`.
BLOCK = 1024


def read_committed(log: DataFrame, transactions: DataFrame, ends: DataFrame) -> DataFrame:
    """Visible rows: below the last stable offset, no control record, not aborted.

    Aborted ranges are cut into blocks of offsets, so the range test is an anti-join on equal
    keys: no rows are sorted, and no producer, however busy, meets in a task.
    """
    p = ["topic", "partition"]
    lso = last_stable_offset(ends, transactions).select(*p, "lso")
    rows = log.join(lso, p).where("offset < lso AND NOT is_control").drop("lso").withColumn("__block", F.floor(F.col("offset") / BLOCK))
    gone = transactions.where("state = 'aborted' AND last_offset > first_offset")
    blocks = F.sequence(F.floor(F.col("first_offset") / BLOCK), F.floor((F.col("last_offset") - 1) / BLOCK))
    gone = gone.select(*[F.col(c).alias(f"__{c}") for c in (*p, "producer_id", "first_offset", "last_offset")], F.explode(blocks).alias("__b"))
    same = (F.col("__block") == F.col("__b")) & (F.col("offset") >= F.col("__first_offset")) & (F.col("offset") < F.col("__last_offset"))
    for c in (*p, "producer_id"):
        same = same & (F.col(c) == F.col(f"__{c}"))
    return rows.join(gone, same, "left_anti").select(*log.columns)


def high_watermark(replicas: DataFrame, max_lag: int) -> DataFrame:
    """Per partition the smallest end offset over the in-sync replicas: the leader and live
    followers that lag it by at most ``max_lag``; 0 where there is none."""
    p = ["topic", "partition"]
    lead = replicas.where("is_leader").select(*p, F.col("end_offset").alias("leader_end"))
    isr = replicas.join(lead, p, "left").where(F.col("is_leader") | (F.col("alive") & (F.col("leader_end") - F.col("end_offset") <= max_lag)))
    marks = isr.groupBy(*p).agg(F.min("end_offset").alias("high_watermark"), F.array_sort(F.collect_list("broker_id")).alias("isr"))
    return replicas.select(*p).distinct().join(marks, p, "left").select(*p, F.coalesce("high_watermark", F.lit(0)).alias("high_watermark"), F.coalesce("isr", F.array().cast("array<int>")).alias("isr"))


#: Transaction state machine: state -> event -> next state (fixed values).
TRANSACTION_STEPS = {
    "Empty": {"add": "Ongoing"},
    "Ongoing": {"add": "Ongoing", "commit": "PrepareCommit", "abort": "PrepareAbort", "timeout": "PrepareAbort"},
    "PrepareCommit": {"markers": "CompleteCommit"},
    "PrepareAbort": {"markers": "CompleteAbort"},
    "CompleteCommit": {"add": "Ongoing"},
    "CompleteAbort": {"add": "Ongoing"},
}


def transaction_states(log: DataFrame) -> DataFrame:
    """Final state of every transactional id from its events (transactional_id, arrival_seq, event):
    epoch rises on a timeout, offsets count only after a commit; an event that the state does
    not know is refused."""
    schema = "transactional_id string, state string, epoch int, refused int, committed_offsets int"

    def run(pdf):
        state, epoch, refused, pending, done = "Empty", 0, 0, 0, 0
        for event in pdf.sort_values("arrival_seq").event:
            if event == "offsets" and state == "Ongoing":
                pending += 1
                continue
            nxt = TRANSACTION_STEPS[state].get(event)
            if nxt is None:
                refused += 1
                continue
            epoch += event == "timeout"
            if nxt == "CompleteCommit":
                done += pending
            if nxt.startswith("Complete"):
                pending = 0
            state = nxt
        import pandas as pd

        return pd.DataFrame([(pdf.transactional_id.iloc[0], state, epoch, refused, done)], columns=["transactional_id", "state", "epoch", "refused", "committed_offsets"])

    ship(log.sparkSession)
    return log.groupBy("transactional_id").applyInPandas(run, schema)
