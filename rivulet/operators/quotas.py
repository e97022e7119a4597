"""Client quotas: observed rates over sliding samples, precedence of entries, throttle times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES, MAX_THROTTLE_MS, DEFAULT = 11, 30_000, "<default>"


def rates(usage: DataFrame) -> DataFrame:
    """usage: user, client_id, now_ms, amount. Per second with usage, at its last record: rate over the
    samples of the last 11 seconds, the window being 10 to 11 seconds long."""
    sec = usage.groupBy("user", "client_id", F.floor(F.col("now_ms") / 1000).cast("long").alias("sec")).agg(F.sum("amount").alias("amount"), F.max("now_ms").alias("now_ms"))
    w = Window.partitionBy("user", "client_id").orderBy("sec").rangeBetween(-(SAMPLES - 1), 0)
    span = F.least(F.greatest(F.col("now_ms") - F.min("sec").over(w) * 1000, F.lit((SAMPLES - 1) * 1000)), F.lit(SAMPLES * 1000)) / 1000
    return sec.withColumn("window_s", span).withColumn("rate", F.sum("amount").over(w) / F.col("window_s"))


def throttle_ms(rate: Column, quota: Column, window_s: Column) -> Column:
    """Milliseconds until the rate is down to the quota, rounded up (but for the noise of division)."""
    over = F.ceil(F.round(F.try_divide(rate - quota, quota) * window_s * 1000, 3))
    return F.when(quota <= 0, MAX_THROTTLE_MS).when(rate <= quota, 0).otherwise(F.least(over, F.lit(MAX_THROTTLE_MS))).cast("int")


def request_percent(nanos: Column) -> Column:
    return nanos / 1e9 * 100.0


#: (user, client) selectors from most to least specific: own, default or absent (fixed values).
PRECEDENCE = (("own", "own"), ("own", "default"), ("own", "none"), ("default", "own"), ("default", "default"), ("default", "none"), ("none", "own"), ("none", "default"))


def resolve(clients: DataFrame, entries: DataFrame) -> DataFrame:
    """(user, client_id, quota): the most specific entry (user, client_id, quota; null for an absent
    dimension). Eight equality joins at most, of which the first hit counts; entries are
    configuration, so each side is small or the join shuffles by key."""
    out = clients.select("user", "client_id").distinct()
    e = entries.where("quota IS NOT NULL").select(F.col("user").alias("eu"), F.col("client_id").alias("ec"), "quota")
    side = lambda kind, own: {"own": F.col(own), "default": F.lit(DEFAULT), "none": F.lit(None).cast("string")}[kind]
    wanted = F.array(*[F.struct(F.lit(i).alias("rank"), side(u, "user").alias("eu"), side(c, "client_id").alias("ec")) for i, (u, c) in enumerate(PRECEDENCE)])
    keys = out.select("user", "client_id", F.explode(wanted).alias("k")).select("user", "client_id", "k.*").alias("k")
    e = e.alias("e")
    hit = keys.join(e, F.col("k.eu").eqNullSafe(F.col("e.eu")) & F.col("k.ec").eqNullSafe(F.col("e.ec")))
    best = hit.groupBy("user", "client_id").agg(F.min_by("quota", "rank").alias("quota"), F.min("rank").alias("rank"))
    return out.join(best, ["user", "client_id"], "left")
