"""What the operators share: scratch tables, a ``let`` for columns, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.session import scratch_root, ship

#: Java pattern of the white space that separates words; words are ``[^\x20\x09-\x0D]+``.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Scratch tables written by this process: session, path, thread.
_WRITTEN: list[tuple[SparkSession, str, int]] = []


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared scratch folder and reads it back.

    Cuts the lineage: later steps re-read files that survive a lost executor. The
    files go when :func:`release` is told so, at the latest when the process ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{scratch_root(spark)}/rivulet/{label}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_delete, lambda _: True)
    _WRITTEN.append((spark, path, threading.get_ident()))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def written() -> set[str]:
    """What this thread has staged and not released."""
    return {path for _, path, thread in _WRITTEN if thread == threading.get_ident()}


def release(paths: set[str]) -> None:
    """Deletes these scratch tables. For a caller who has written what was built on them: whatever still
    reads one fails."""
    _delete(lambda path: path in paths)


def _delete(which: Callable[[str], bool]) -> None:
    gone = [x for x in _WRITTEN if which(x[1])]
    _WRITTEN[:] = [x for x in _WRITTEN if x not in gone]
    for spark, path, _ in gone:
        with contextlib.suppress(Exception):  # the session may have ended before the process
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; after the last, what this Python worker does not need goes back to the system, as a worker
    outlives its task and the executor's memory holds both."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system has it
        ctypes.CDLL(None).malloc_trim(0)


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` in one struct, so that no name of theirs can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a text (null: none), as an array of strings."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def maybe_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hints a broadcast only after counting: at most ``max_rows`` narrow rows.

    Above the bound the hint is left out and the join shuffles (with AQE's skew
    handling). ``df`` should be staged, as it is counted here.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("merge")


#: Keys that more than one row in so many has are broadcast by :func:`join_spread`.
HOT_SHARE = 10_000


def join_spread(rows: DataFrame, other: DataFrame, key: str, share: int = HOT_SHARE, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``other``, which has narrow rows and one for a key at most.

    Keys held by more than one row in ``share`` (that many at most, whatever the input) are broadcast with
    their row, so no task gets all rows of one; the others join by shuffle. Both should be staged. counts:
    (key, n) of ``rows``, staged, where the caller has them.
    """
    fields = [c for c in other.columns if c != key]
    total = rows.count() if counts is None else counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = rows.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    often = counts.where(F.col("n") > F.greatest(F.lit(total / share), F.lit(1.0)))
    hot = stage(other.join(often.select(key), key, "left_semi"), "hot-keys")
    marked = rows.join(F.broadcast(hot.select(key, F.struct(*fields).alias("__hot"))), key, "left")
    rest = marked.where("__hot IS NULL").drop("__hot").join(other, key)
    return marked.where("__hot IS NOT NULL").select(*rows.columns, "__hot.*").unionByName(rest.select(*rows.columns, *fields))


#: Edges up to which the nodes' minima are broadcast (16 bytes each, two nodes an edge at most).
FEW_EDGES = 200_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star.

    edges: (a, b) long. Returns (id, component) for every node except the roots
    themselves; component is the smallest id reachable. Each round is two grouped
    minima (combined map-side) joined back on the node, by a broadcast while there are few edges, else
    by a merge join that AQE can split, so the hub of a very large group costs one partial aggregate per task.
    Rounds grow with the logarithm of the longest path; a round's edges are deleted once
    the next are written. Raises RuntimeError if ``max_rounds`` do not suffice, which
    takes far longer paths than any table holds: nothing is ever returned unfinished.
    """
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    e = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )
    seen = mark(e)
    if not seen[0]:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        # nodes are at most twice the edges just counted: their minima are broadcast while that is few, so no hub meets in a task
        small = (lambda d: F.broadcast(d)) if seen[0] <= FEW_EDGES else (lambda d: d.hint("merge"))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(small(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = large.join(small(low), "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        before, e = e, stage(stars.select("e.*").where("a <> b").distinct(), "cc")
        now = mark(e)
        release({before._scratch})
        if now == seen:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
