"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token
blocks, with a seeded choice of blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm.common import maybe_broadcast, stage, table, whole_row

WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(sources: DataFrame, total: Column, limit: float) -> DataFrame:
    """Targets proportional to ``w``, stopped at ``limit`` times ``source_size``, the excess
    reshared by weight until none is above.

    Sources in order of limit per weight stop one after another: with the first k
    stopped the level of the rest is (total - their limits) / (remaining weight). One
    row a source, so the ordering window is small.
    """
    cap = F.col("source_size") * limit
    before = Window.orderBy(F.col("cap") / F.col("w"), "srank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sources.withColumn("cap", cap).withColumn("total", total)
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("w_left"))
    stopped = F.col("level") * F.col("w") >= F.col("cap")
    whole = Window.orderBy(F.col("cap") / F.col("w"), "srank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("rest", F.first(F.when(~stopped, F.col("level")), ignorenulls=True).over(whole))
    out = F.when(F.coalesce(F.col("rest") * F.col("w"), F.col("cap")) >= F.col("cap"), F.col("cap")).otherwise(F.col("rest") * F.col("w"))
    return s.withColumn("target", out).drop("cap", "cap_before", "w_left", "level", "rest", "total")


def apportion(targets: DataFrame, houses: list[int]) -> DataFrame:
    """Sainte-Laguë seats of every source (srank, target) in houses of the given sizes:
    (srank, house, seats), highest quotients target / (2k + 1), ties to the lower srank.

    Seats sure to be won (divisor W / (N - n/2)) are not ranked one by one: with n
    sources only those between that divisor and W / (N + n/2) are, 2n at most. As the
    method is house-monotone, this gives the same seats as ranking all quotients.
    """
    n = Window.partitionBy("house").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = targets.select("srank", "target", F.explode(F.array(*[F.lit(x).cast("long") for x in houses])).alias("house"))
    h = h.withColumn("all", F.sum("target").over(n)).withColumn("half", F.count("*").over(n) / 2)
    share = F.when(F.col("all") > 0, F.col("target") / F.col("all")).otherwise(F.lit(0.0))
    low = F.greatest(F.ceil(share * (F.col("house") - F.col("half")) - 0.5), F.lit(0)).cast("long")
    high = (F.floor(share * (F.col("house") + F.col("half")) + 0.5) + 1).cast("long")
    h = h.withColumn("low", low).withColumn("high", F.greatest(high, low + 1)).withColumn("open", F.col("house") - F.sum("low").over(n))
    q = h.where("target > 0").withColumn("k", F.explode(F.sequence(F.col("low"), F.col("high"))))
    best = Window.partitionBy("house").orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "srank", "k")
    won = q.withColumn("rn", F.row_number().over(best)).where("rn <= open").groupBy("house", "srank").agg(F.count("*").alias("won"))
    return h.join(won, ["house", "srank"], "left").select("srank", "house", (F.col("low") + F.coalesce("won", F.lit(0))).alias("seats"))


#: Copies of one row that may share a key.
HOT = 20_000


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` with a key of its own for every copy of a row that is repeated more than ``HOT`` times. Such
    rows are gathered as one with a count, map-side, and written out again, numbered."""
    hot = stage(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"), "mix-hot")
    if hot.isEmpty():
        return rows
    hot = maybe_broadcast(hot, 200_000)
    many = rows.join(hot, "key", "left_semi").groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    many = many.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    many = many.withColumn("key", F.md5(F.concat("key", F.lit("|"), F.col("__i").cast("string")).cast("binary")))
    return stage(rows.join(hot, "key", "left_anti").unionByName(many.select(*rows.columns)), "mix-spread")


def plan_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    limit: float = 2.0,
    block: int = 64,
    n_shards: int = 8,
    seed: str = "mix-1",
    payload: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, and what is taken of it.

    Sources by code point, null last, weigh ``weights`` repeating; their targets share
    ``share`` of all words and stop at ``limit`` times their size (:func:`fill`).

    A source's documents, in order of a seeded MD5 of doc_id and the text's MD5, so that rows that
    share a key are equal but for other columns,
    are one run of words cut in blocks of ``block``; all targets make N blocks, dealt to
    the sources by :func:`apportion`. The awards of shard j are those from house
    N*j/n_shards to N*(j+1)/n_shards, so each shard has integer quotas. Seat t of a
    source takes block (t + a seeded shift) modulo its number of blocks: a seeded run of
    whole documents, cut only at its two ends, and no block is taken more than
    ceil(limit) times. ``first_shard`` is the shard of the first seat that takes from
    the row; ``spans`` lists (pass, from, to) in words, ``to`` exclusive.

    Running word counts come from sums over (source, first bits of the MD5), so no
    window holds more than a small part of a hot source; rows without ids spread by their text, and of a row
    that is repeated more than ``HOT`` times each copy gets an MD5 of its own (:func:`spread`). Null texts have no
    words; empty tables, repeated rows and extra columns are allowed. All sources, one row
    each, meet in one task: they are thousands, not millions.
    """
    own = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), own).cast("binary"))
    rows = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("src"),
            word_count(F.col(text_col)).alias("size"),
            key.alias("key"),
            *[F.col(c).alias(f"__p{i}") for i, c in enumerate(payload)],
        ),
        "mix-rows",
    )
    rows = spread(rows)
    n = rows.count()
    bits = min(28, max(8, (n // 20_000).bit_length()))
    bucket = F.shiftright(F.conv(F.substring("key", 1, 7), 16, 10).cast("long"), 28 - bits)
    sums = stage(rows.withColumn("bucket", bucket).groupBy("src", "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    per = sums.groupBy("src").agg(F.sum("words").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("srank") % len(weights) + 1).cast("int"))
    total = int(per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    ranked = per.withColumn("srank", rank).withColumn("w", weight)
    targets = stage(fill(ranked, F.lit(share * total), limit), "mix-targets")
    blocks = int(share * total / block + 0.5)
    houses = [blocks * j // n_shards for j in range(n_shards + 1)]
    seats = apportion(targets, sorted(set(houses))).groupBy("srank").agg(
        F.map_from_entries(F.collect_list(F.struct("house", "seats"))).alias("by_house")
    )
    shift = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce("src", F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")
    nb = F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)).cast("long")
    dealt = (
        targets.join(seats, "srank")
        .withColumn("nb", nb)
        .withColumn("at", F.array(*[F.try_element_at("by_house", F.lit(h).cast("long")) for h in houses]))
        .withColumn("quota", F.least(F.element_at("at", -1), F.floor(F.col("nb") * limit).cast("long")))
        .withColumn("shift", F.pmod(shift, "nb"))
        .select("src", "source_size", F.round("target", 6).alias("target"), "nb", "quota", "shift", "at")
    )
    prefix = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("src", "bucket", F.coalesce(F.sum("words").over(prefix), F.lit(0)).alias("base"))
    small = maybe_broadcast(stage(base.join(dealt, base.src.eqNullSafe(dealt.src)).select(base.src, "bucket", "base", *dealt.columns[1:]), "mix-base"), 200_000)

    run = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("bucket", bucket).withColumn("end", F.sum("size").over(run)).alias("r")
    small = small.alias("b")
    both = placed.join(small, F.col("r.src").eqNullSafe(F.col("b.src")) & (F.col("r.bucket") == F.col("b.bucket"))).select(
        "r.*", *[f"b.{c}" for c in small.columns if c not in ("src", "bucket")]
    )
    start = F.col("base") + F.col("end") - F.col("size")

    def span(k: int, wrapped: bool) -> Column:
        """Words of the row that pass k takes: the run of r blocks from ``shift``, or its part past the end."""
        r = F.least(F.greatest(F.col("quota") - k * F.col("nb"), F.lit(0)), F.col("nb"))
        lo = F.lit(0).cast("long") if wrapped else F.col("shift") * block
        hi = (F.col("shift") + r - F.col("nb")) * block if wrapped else (F.col("shift") + r) * block
        if wrapped:
            hi = F.greatest(hi, F.lit(0))
        else:
            hi = F.least(hi, F.col("nb") * block)
        a, b = F.greatest(lo - start, F.lit(0)), F.least(hi - start, F.col("size"))
        seat = F.pmod(F.floor((start + a) / block).cast("long") - F.col("shift"), "nb") + k * F.col("nb")
        return F.struct(F.lit(k).alias("pass"), a.cast("long").alias("from"), b.cast("long").alias("to"), seat.alias("seat"))

    passes = -int(-limit // 1)
    spans = F.filter(F.array(*[span(k, x) for k in range(passes) for x in (False, True)]), lambda s: s["to"] > s["from"])
    out = both.withColumn("spans", spans)
    first = F.array_min(F.transform("spans", lambda s: s["seat"]))
    shard = F.size(F.filter(F.slice("at", 2, n_shards), lambda x: x <= first)).cast("int")
    return out.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"]).alias("taken"),
        F.when(F.size("spans") > 0, F.least(shard, F.lit(n_shards - 1))).alias("first_shard"),
        F.transform("spans", lambda s: F.struct(s["pass"], s["from"], s["to"])).alias("spans"),
        *[F.col(f"__p{i}").alias(c) for i, c in enumerate(payload)],
    )


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", **kw) -> DataFrame:
    """The mix itself: a row for every span taken, with the columns of ``docs``, whatever their names.

    A span of all words has the text as it was; a shorter one the words with the white
    space after each. ``chars_col``, if present, becomes the new text's length.
    """
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(source_col).alias("__source"), whole_row(docs).alias("__row"))
    m = plan_mix(src, id_col="__id", text_col="__text", source_col="__source", payload=("__row",), **kw)
    m = m.select("size", F.explode("spans").alias("span"), F.col("__row").alias("row"))
    a, b, before = F.col("span.from"), F.col("span.to"), F.col("row").getField(text_col)
    parts = F.regexp_extract_all(before, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(F.slice(parts, (a + 1).cast("int"), (b - a).cast("int")), "")
    m = m.withColumn("cut", F.when(b - a == F.col("size"), before).otherwise(cut))
    new = {text_col: F.col("cut")}
    if chars_col in docs.columns:
        new[chars_col] = F.length("cut").cast(docs.schema[chars_col].dataType)
    return m.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: All quotients are ranked one by one here; words are counted, sources filled and runs placed afresh.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST(r % 3 AS INT) + 1] AS w, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
f(round, stopped) AS (
  SELECT 0, CAST([] AS BIGINT[])
  UNION ALL
  SELECT round + 1, (SELECT list(r ORDER BY r) FROM w, (SELECT sum(CASE WHEN list_contains(f.stopped, r) THEN 2.0 * source_size ELSE 0 END) c,
                                                   sum(CASE WHEN list_contains(f.stopped, r) THEN 0 ELSE w END) v FROM w) x
                     WHERE list_contains(f.stopped, r) OR (x.v > 0 AND (total - x.c) * w / x.v >= 2.0 * source_size))
  FROM f WHERE round < 30),
z AS (SELECT coalesce(stopped, []) AS stopped FROM f WHERE round = 30),
x AS (SELECT sum(CASE WHEN list_contains(stopped, r) THEN 2.0 * source_size ELSE 0 END) c, sum(CASE WHEN list_contains(stopped, r) THEN 0 ELSE w END) v FROM w, z),
t AS (SELECT source, source_size, r, total, CAST(CASE WHEN list_contains(stopped, r) THEN 2.0 * source_size ELSE (total - x.c) * w / x.v END AS DOUBLE) AS target,
             greatest(CAST(ceil(source_size / 64.0) AS BIGINT), 1) AS nb FROM w, z, x),
q AS (SELECT r, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, r, k) AS rn, CAST(floor(total / 64 + 0.5) AS BIGINT) AS blocks
      FROM (SELECT r, target, total, unnest(range(2 * nb + 2)) AS k FROM t WHERE target > 0)),
u AS (SELECT t.*, least(coalesce((SELECT count(*) FROM q WHERE q.r = t.r AND rn <= blocks), 0), 2 * nb) AS quota,
             CAST(('0x' || substr(md5('mix-1/' || coalesce(source, '')), 1, 15)) AS BIGINT) % nb AS shift FROM t),
p AS (SELECT d.*, u.source_size, u.target, u.nb, u.quota, u.shift,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS a
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
o AS (SELECT *, least(quota, nb) AS r0, greatest(quota - nb, 0) AS r1 FROM p)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(greatest(least((least(shift + r0, nb)) * 64, a + size) - greatest(shift * 64, a), 0)
     + greatest(least((shift + r0 - nb) * 64, a + size) - a, 0)
     + greatest(least((least(shift + r1, nb)) * 64, a + size) - greatest(shift * 64, a), 0)
     + greatest(least((shift + r1 - nb) * 64, a + size) - a, 0) AS BIGINT) AS taken
FROM o
"""
