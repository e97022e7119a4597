"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries,
range partition, overfull ranges subdivided. The law that holds is ``bytes``."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import stage, table

SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )


def assign_shards(
    docs: DataFrame,
    n_shards: int = 24,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    cells_per_shard: int = 64,
    samples_per_cell: int = 8,
    seed: int = 7,
) -> DataFrame:
    """One row per input row: its shard and its slot there, sizes near equal.

    The key of a row is a 64-bit hash of its text, so equal texts are one key and
    stay in one shard, unless the group is larger than a whole shard: only such a
    key is subdivided, by doc_id (rows without an id by their place).

    1. Sizes are summed by key (map-side first). A key is drawn with probability
       min(1, its bytes / (all bytes / samples)), so about
       ``n_shards * cells_per_shard * samples_per_cell`` keys reach the driver
       whatever the input, and every key as large as a cell is among them.
    2. Weighted quantiles of the sample are the splitters of
       ``n_shards * cells_per_shard`` ranges; keys larger than a cell get a range alone.
    3. Exact bytes per range; overfull ones are subdivided by key hash, those of one key
       by doc_id. The parts of a group that fits a shard stay together: the largest such groups go first, each to the emptiest shard;
       the other cells, in key order, then fill the shards up one after another. So a shard is
       off by about one cell, by one row where single rows are larger, or by what a
       group too large for the room left exceeds it.
    4. A slot is the cell's row offset in its shard plus the row number inside the
       cell: no window spans a shard, nor a large group.

    Null text counts as empty (size 8, crc 0); null ids, repeated rows and extra
    columns are allowed; an empty table gives no rows.
    """
    rows = stage(_keys(docs, id_col, text_col), "shard-keys")
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return spark.createDataFrame([], SCHEMA)
    cells = n_shards * cells_per_shard
    cell = total / cells
    step = cell / samples_per_cell
    by_key = rows.groupBy("key").agg(F.sum("size").alias("w"))
    draw = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = sorted((r.key, r.w) for r in by_key.where(draw < F.col("w") / F.lit(step)).collect())

    splitters, heavy, filled, want = set(), {}, 0.0, cell
    for key, w in sample:
        if w > cell:
            heavy[key] = w
            splitters |= {key, min(key + 1, (1 << 63) - 1)}
        filled += max(w, step)
        if filled >= want:
            splitters.add(min(key + 1, (1 << 63) - 1))
            want = (filled // cell + 1) * cell
    cuts = np.array(sorted(splitters), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(), side="right").astype(np.int32))

    ranged = stage(rows.withColumn("rng", range_of("key")).withColumn("place", F.monotonically_increasing_id()), "shard-ranges")
    sizes = dict(tuple(r) for r in ranged.groupBy("rng").agg(F.sum("size")).collect())
    alone = {bisect_right(cuts.tolist(), k) for k in heavy}
    whole = {r for r in alone if sizes[r] <= total / n_shards}
    over = [(r, -(-s // int(max(cell, 1))), r in alone) for r, s in sizes.items() if s > 1.5 * cell]
    parts = spark.createDataFrame(over, "rng int, parts long, alone boolean")
    celled = ranged.join(F.broadcast(parts), "rng", "left").withColumn(
        "sub",
        F.when(F.col("parts").isNull(), F.lit(0))
        .when(F.col("alone"), F.pmod(F.xxhash64(F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("place")), F.lit(seed + 1)), F.col("parts")))
        .otherwise(F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.col("parts")))
        .cast("int"),
    )
    found = sorted(tuple(r) for r in celled.groupBy("rng", "sub").agg(F.sum("size"), F.count("*")).collect())
    bytes_, slots, placed = [0] * n_shards, [0] * n_shards, []

    def put(at: tuple, shard: int) -> None:
        placed.append((at[0], at[1], shard, slots[shard]))
        bytes_[shard] += at[2]
        slots[shard] += at[3]

    for r in sorted(whole, key=lambda r: (-sizes[r], r)):
        shard = min(range(n_shards), key=lambda i: (bytes_[i], i))
        for at in (x for x in found if x[0] == r):
            put(at, shard)
    fill_shards([x for x in found if x[0] not in whole], bytes_, put)
    where = spark.createDataFrame(placed, "rng int, sub int, shard int, base long")
    return celled.join(F.broadcast(where), ["rng", "sub"]).selectExpr(
        "doc_id",
        "size",
        "text_crc32",
        "'bytes' AS law",
        "shard",
        "base + row_number() OVER (PARTITION BY rng, sub ORDER BY key, doc_id) - 1 AS slot",
        "CAST(NULL AS INT) AS grown_shard",
    )


def fill_shards(cells: list[tuple], bytes_: list[int], put) -> None:
    """Cells (range, sub, bytes, rows) in key order fill up the room below a common level, shard by shard.

    The level is that at which all cells fit above what the shards hold already."""
    rest, level, held = sum(x[2] for x in cells), 0.0, sorted(bytes_)
    for k in range(1, len(held) + 1):
        level = (rest + sum(held[:k])) / k
        if k == len(held) or level <= held[k]:
            break
    room = [max(0.0, level - b) for b in bytes_]
    ends = np.cumsum(room)
    last = max(i for i, r in enumerate(room) if r > 0 or i == 0)
    before = 0
    for x in cells:
        put(x, min(last, int(np.searchsorted(ends, before + x[2] / 2, side="right"))))
        before += x[2]


def write_shards(docs: DataFrame, assignment: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes whole records under ``path/shard=N`` in slot order inside each file.

    Needs unique ids. A shard is spread over several files, so that no task holds one whole.
    """
    a = assignment.select(F.col("doc_id").alias(id_col), "shard", "slot")
    (
        docs.drop("shard", "slot")
        .join(a, id_col)
        .withColumn("block", F.floor(F.col("slot") / 50_000))
        .repartition("shard", "block")
        .sortWithinPartitions("shard", "slot")
        .drop("block")
        .write.partitionBy("shard")
        .parquet(path)
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
