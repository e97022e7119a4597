"""Consumer groups and placement: offsets, assignment, replicas, leaders."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_offsets(commits: DataFrame) -> DataFrame:
    """Last commit of each (group_id, topic, partition) by arrival."""
    return commits.groupBy("group_id", "topic", "partition").agg(F.max_by("committed_offset", "arrival_seq").alias("committed_offset"))


def fetch_offsets(wanted: DataFrame, offsets: DataFrame) -> DataFrame:
    """Committed offset of every wanted (group_id, topic, partition); -1 where there is none."""
    k = ["group_id", "topic", "partition"]
    return wanted.join(offsets, k, "left").select(*k, F.coalesce("committed_offset", F.lit(-1)).alias("committed_offset"))


def valid_commits(commits: DataFrame, members: DataFrame) -> DataFrame:
    """Commits that are let in: of a member at the group's generation, or, with no member named,
    to a group that has none."""
    m = members.select("group_id", F.col("member_id").alias("m"), F.col("generation").alias("g"))
    named = commits.where("member_id <> ''").join(m, (commits.group_id == m.group_id) & (F.col("member_id") == F.col("m")) & (commits.generation == F.col("g")), "left_semi")
    alone = commits.where("coalesce(member_id, '') = ''").join(m.select("group_id").distinct(), "group_id", "left_anti")
    return named.unionByName(alone)


def list_groups(members: DataFrame, offsets: DataFrame) -> DataFrame:
    """Groups with their number of members; one that has offsets only counts one stand-in member."""
    a = members.groupBy("group_id").agg(F.countDistinct("member_id").alias("members"))
    b = offsets.groupBy("group_id").agg(F.count("*").alias("offsets"))
    return a.join(b, "group_id", "full").select("group_id", F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("offsets", F.lit(0)).alias("offsets"), F.col("members").isNull().alias("offsets_only"))


def share_assignment(members: DataFrame, partitions: DataFrame) -> DataFrame:
    """(member_id, partition): with no more members than partitions, partition i to member i mod M;
    otherwise member i to partition i mod P. Both lists are metadata of one group."""
    m = members.select("member_id", (F.row_number().over(Window.orderBy("member_id")) - 1).alias("mi"))
    p = partitions.select("partition", (F.row_number().over(Window.orderBy("partition")) - 1).alias("pi"))
    nm, np_ = m.count(), p.count()
    if not nm or not np_:
        return m.select("member_id", F.lit(0).alias("partition")).limit(0)
    key = (F.col("pi") % nm == F.col("mi")) if nm <= np_ else (F.col("mi") % np_ == F.col("pi"))
    return m.join(p, key).select("member_id", "partition")


def sticky_assignment(partitions: dict[str, int], members: dict[str, set[str]], held: dict[str, dict[str, list[int]]]) -> dict[str, dict[str, list[int]]]:
    """Cooperative sticky assignment, per topic: member -> topic -> partitions.

    Members keep what they hold up to the quota; those in front keep the extra ones of an
    uneven division; free partitions go, lowest first, to the least loaded member, ties
    to the lowest id. Metadata-sized, so it runs on the driver.
    """
    out: dict[str, dict[str, list[int]]] = defaultdict(dict)
    for topic, n in sorted(partitions.items()):
        who = sorted(m for m, topics in members.items() if topic in topics)
        if not who:
            continue
        quota, extra = divmod(n, len(who))
        mine: dict[str, list[int]] = {}
        taken: set[int] = set()
        for m in who:
            keep = [p for p in sorted(held.get(m, {}).get(topic, [])) if p < n and p not in taken]
            taken |= set(keep)
            mine[m] = keep
        over = [m for m in who if len(mine[m]) > quota]
        for rank, m in enumerate(over):
            room = quota + (1 if rank < extra else 0)
            taken -= set(mine[m][room:])
            mine[m] = mine[m][:room]
        for p in (p for p in range(n) if p not in taken):
            m = min(who, key=lambda x: (len(mine[x]), x))
            mine[m].append(p)
        for m in who:
            out[m][topic] = sorted(mine[m])
    return dict(out)


def place_round_robin(partitions: DataFrame, brokers: DataFrame, replicas: int) -> DataFrame:
    """(partition, replica, broker_id): replica r of partition p on broker (p + r) mod n, in id order."""
    b = brokers.select("broker_id", (F.row_number().over(Window.orderBy("broker_id")) - 1).alias("bi"))
    n = b.count()
    r = F.explode(F.sequence(F.lit(0), F.lit(min(replicas, n) - 1))).alias("replica")
    return partitions.select("partition", r).withColumn("bi", (F.col("partition") + F.col("replica")) % n).join(F.broadcast(b), "bi").select("partition", "replica", "broker_id")


def place_racks(n_partitions: int, brokers: dict[int, str], replicas: int) -> list[list[int]]:
    """Replicas of each partition over racks in turn: a rack is used again only once all are."""
    racks: dict[str, list[int]] = defaultdict(list)
    for b in sorted(brokers):
        racks[brokers[b]].append(b)
    order, names = [], sorted(racks)
    for i in range(max(map(len, racks.values()), default=0)):
        order += [racks[r][i] for r in names if i < len(racks[r])]
    out, n = [], len(order)
    for p in range(n_partitions if n else 0):
        first, *rest = order[p % n :] + order[: p % n]
        shift = p // n % max(1, len(rest))
        got = [first]
        for b in rest[shift:] + rest[:shift]:
            used = {brokers[x] for x in got}
            if len(got) < replicas and (brokers[b] not in used or used >= set(names)):
                got.append(b)
        got += [b for b in order if b not in got][: max(0, min(replicas, n) - len(got))]
        out.append(got)
    return out


def choose_replica(replicas: DataFrame, reads: DataFrame) -> DataFrame:
    """(read_id, broker_id): the leader if it is in the reader's rack, else the in-sync replica there
    that is furthest on and reaches the offset, ties to the lowest id, else the leader."""
    r = replicas.select("topic", "partition", "broker_id", F.col("rack").alias("broker_rack"), "end_offset", "in_sync", "is_leader")
    j = reads.join(r, ["topic", "partition"])
    near = F.col("broker_rack") == F.col("rack")
    rank = F.when(near & F.col("is_leader"), 0).when(near & F.col("in_sync") & (F.col("end_offset") >= F.col("fetch_offset")), 1).when(F.col("is_leader"), 2)
    best = F.min_by("broker_id", F.struct("rank", F.when(F.col("rank") == 1, -F.col("end_offset")).otherwise(0), "broker_id"))
    return j.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("read_id").agg(best.alias("broker_id"))


def elect(replicas: DataFrame, exclude: int | None = None) -> DataFrame:
    """New leader: furthest live in-sync replica, else furthest live one, ties to the lowest id, else 0;
    never the broker ``exclude``, which is on its way out."""
    if exclude is not None:
        replicas = replicas.withColumn("alive", F.col("alive") & (F.col("broker_id") != exclude))
    rank = F.when(F.col("alive") & F.col("in_sync"), 0).when(F.col("alive"), 1)
    best = F.min_by(F.when(F.col("rank").isNotNull(), F.col("broker_id")), F.struct(F.coalesce("rank", F.lit(2)), -F.col("end_offset"), "broker_id"))
    return replicas.withColumn("rank", rank).groupBy("topic", "partition").agg(F.coalesce(best, F.lit(0)).alias("leader"))
