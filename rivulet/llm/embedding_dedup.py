"""Embedding near-duplicates: iterative quantisation learns rotations for balanced binary
codes, multi-index Hamming tables retrieve, the original vectors decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import connected_components, join_spread, stage, table
from rivulet.session import ship

COSINE = 0.95
#: Rows that the rotations are learnt from, those of the smallest id hashes.
SAMPLE = 20_000
#: Share of pairs made at exactly the threshold that may miss every table.
MISS = 0.001
#: Vectors that more than one row in so many holds are broadcast with their result.
HOT_SHARE = 1000
#: Different vectors of a length up to which they are compared with each other.
FEW = 2048
#: Vectors expected in a bucket of random codes, and at most about so many in a block.
BUCKET, BLOCK = 64, 1024


def tables_for(n: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """(bits of a substring, number of tables) for n vectors.

    Substrings grow with log2(n), so buckets don't. A bit differs with probability
    angle / pi; were bits independent, a pair at the threshold would have an equal substring
    in one of so many tables but for ``miss``. :func:`learn` measures it and adds what is missing.
    """
    bits = min(24, max(8, round(math.log2(max(2, n / BUCKET)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def itq(x: np.ndarray, bits: int, seed: int = 5, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(projection d x bits, thresholds): codes are ``x @ projection > thresholds``.

    Principal directions of the centred sample, turned by the rotation that brings
    them closest to their signs (alternating sign and orthogonal Procrustes steps).
    More bits than dimensions come from further rotations with other starts.
    Thresholds are medians, so every bit is balanced on the sample.
    """
    d = x.shape[1]
    if d == 1:  # no direction to turn
        return np.ones((1, bits)), np.zeros(bits)
    centred = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(np.cov(centred, rowvar=False).reshape(d, d) + 1e-12 * np.eye(d))
    v = centred @ axes.T
    rng = np.random.default_rng(seed)
    parts = []
    for _ in range(-(-bits // d)):
        r, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(v.T @ np.where(v @ r >= 0, 1.0, -1.0))
            r = u @ w
        parts.append(axes.T @ r)
    projection = np.concatenate(parts, axis=1)[:, :bits]
    return projection, np.median(x @ projection, axis=0)


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares from over- and underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes_of(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The code of each row of unit vectors in every table."""
    projection, cuts, bits = model
    on = (x @ projection > cuts).reshape(len(x), -1, bits)
    return (on * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2).astype(np.int32)


def learn(x: np.ndarray, n: int, cosine: float, miss: float = MISS) -> tuple[np.ndarray, np.ndarray, int]:
    """(projection, cuts, bits of a table) for n vectors, from a sample of unit vectors.

    Bits of one rotation depend on each other, so the number of tables is not taken from a formula
    alone: pairs at exactly the threshold are made from the sample (its vectors turned in random
    directions), and tables are added until at most ``miss`` of them share no code.
    """
    bits, tables = tables_for(n, cosine, miss)
    rng = np.random.default_rng(17)
    a = x[rng.integers(0, len(x), 20_000)]
    turn = rng.standard_normal(a.shape)
    turn -= (turn * a).sum(axis=1, keepdims=True) * a
    turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-300)
    b = cosine * a + math.sqrt(1 - cosine * cosine) * turn
    while True:
        model = (*itq(x, bits * tables), bits)
        missed = float((codes_of(a, model) != codes_of(b, model)).all(axis=1).mean())
        if missed <= miss or tables >= 512:
            return model
        tables += max(2, tables // 4)


def near_vectors(rows: DataFrame, cosine: float = COSINE, *, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links, component_id, kept.

    Two vectors of equal length link if their cosine, in double precision, is at least ``cosine``.
    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths. Equal vectors are one with a
    count (summed map-side first), so copies are never paired; rows that repeat an id
    and its vector count once, rows without an id are vectors of their own without links or
    component (kept is false). An empty table gives no rows; extra columns are ignored.

    Each length with more than ``FEW`` different vectors has rotations of its own, learnt from ``sample``
    rows at most (:func:`learn`); every vector is indexed. The vectors of a rarer length are one bucket.
    Each vector goes to one bucket of every table. A bucket is cut into blocks of about
    ``BLOCK`` and a task sees two blocks, whatever the size of the bucket. A pair is
    reranked and counted in the first table whose bucket both share. Only a count and a
    link to a root for each vector come out of a block, never pairs, and no candidate
    is dropped.
    """
    ship(rows.sparkSession)
    src = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    fit = usable(F.col("v")) & F.col("vec_id").isNotNull()
    classes = stage(src.where(fit).groupBy("v").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies")), "ve-classes")
    dim = F.size("v")
    many = {r.d: r["n"] for r in classes.groupBy(dim.alias("d")).agg(F.count("*").alias("n")).where(F.col("n") > FEW).collect()}  # a row for each common length
    models = {}
    for d, n in many.items():
        some = classes.where(dim == d).orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").toArrow()["v"].combine_chunks()
        models[d] = learn(units(matrix(some)), n, cosine)
    wide = str(src.schema["v"].dataType).find("Double") >= 0
    kind = np.float64 if wide else np.float32

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                b = batch.filter(pa.array(dims == d))
                x = matrix(b.column(0))
                codes = codes_of(units(x), models[d]) if d in models else np.zeros((len(x), 1), np.int32)
                raw = [r.tobytes() for r in x.astype(kind)]
                lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d, np.int32)), b.column(1), b.column(2), pa.array(raw, pa.binary()), lists], names=["d", "rep", "copies", "raw", "codes"])

    coded = stage(classes.select("v", "rep", "copies").mapInArrow(encode, "d int, rep long, copies long, raw binary, codes array<int>"), "ve-codes")
    keyed = coded.select("d", "rep", F.posexplode("codes").alias("tab", "code"))
    blocks = keyed.groupBy("d", "tab", "code").agg(F.count("*").alias("n")).where("n > 1").select("d", "tab", "code", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    dealt = keyed.join(blocks, ["d", "tab", "code"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("d", "rep", "tab", "code", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))

    def rerank(t: pa.Table) -> pa.Table:
        tab, two = t["tab"][0].as_py(), t["b1"][0].as_py() != t["b2"][0].as_py()
        rep, copies, block = (t[c].to_numpy() for c in ("rep", "copies", "block"))
        x = units(np.frombuffer(b"".join(t["raw"].to_pylist()), kind).reshape(len(rep), -1).astype(np.float64))
        codes = t["codes"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        first, second = (np.flatnonzero(block == t[c][0].as_py()) for c in ("b1", "b2"))
        s = x[first] @ x[second].T >= cosine
        if not two:
            s = np.triu(s, 1)
        i, j = np.nonzero(s)
        i, j = first[i], second[j]
        keep = (codes[i] == codes[j]).argmax(axis=1) == tab
        i, j = i[keep], j[keep]
        links = np.zeros(len(rep), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root = rep.copy()
        while len(i):  # smallest id reachable inside the block
            low = np.minimum(root[i], root[j])
            if (root[i] == low).all() and (root[j] == low).all():
                break
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
        m = links > 0
        return pa.table({"rep": rep[m], "links": links[m], "root": root[m]})

    joined = dealt.join(coded.drop("d"), "rep")
    part = stage(joined.groupBy("d", "tab", "code", "b1", "b2").applyInArrow(rerank, "rep long, links long, root long"), "ve-links")
    comp = connected_components(part.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    total = part.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.join(total, "rep", "left").join(comp, F.col("rep") == F.col("id"), "left")
    named = named.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    named = stage(named, "ve-named")
    member = join_spread(src.where(fit), named, "v", HOT_SHARE).drop("v")
    alone = src.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return member.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(id, low) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.a, r.low FROM p JOIN r ON p.b = r.id),
c AS (SELECT id, min(low) AS component_id FROM r GROUP BY id)
SELECT c.id AS vec_id, (SELECT count(*) FROM p WHERE p.a = c.id) AS n_links, component_id, c.id = component_id AS kept FROM c
"""
