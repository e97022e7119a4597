"""Near-duplicate documents by DartMinHash: hashed darts thrown into weighted element
regions, the earliest kept per coordinate, signatures joined in bands."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import connected_components, join_spread, maybe_broadcast, stage, table, trimmed, whole_row, words_of
from rivulet.session import ship

WORDS = 5
SIMILARITY = 0.8
#: 25 bands of 5 coordinates: a pair at 0.8 shares a band but for 5 in 100,000 pairs.
BANDS, ROWS = 25, 5
COORDS = 128
#: Coordinates that a pair of 0.8 agrees in: 102 at the mean, 4.5 the deviation; under 84: 3 in 100,000 pairs.
LOW_AGREE = 84
#: Members of a bucket that a block holds.
BLOCK = 512
#: Candidate ids (8 bytes each) up to which the texts are filtered by a broadcast.
BROADCAST_IDS = 1_000_000
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hash -> uniform in (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


class WordHashes(dict):
    """Word -> 64-bit hash, kept for the first words seen, up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 60_000:
            self[word] = h
        return h


_HASHES = WordHashes()


def shingles(words: list[bytes], k: int = WORDS) -> np.ndarray:
    """Hashes of all runs of k words in order; of the whole text where it is shorter."""
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if len(h) == 0:
        return h
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(h) if len(h) < k else k, np.uint64)
    for i in range(min(k, len(h))):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def elements(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements, sorted, and their weights (how often each occurs)."""
    return np.unique(s, return_counts=True)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two shingle lists: sum of minima over sum of maxima."""
    (xa, wa), (xb, wb) = elements(a), elements(b)
    _, ia, ib = np.intersect1d(xa, xb, assume_unique=True, return_indices=True)
    both = int(np.minimum(wa[ia], wb[ib]).sum())
    return both / max(1, int(wa.sum() + wb.sum()) - both)


def dart_minhash(sets: list[tuple[np.ndarray, np.ndarray]], coords: int = COORDS, seed: int = 1) -> np.ndarray:
    """Signatures of non-empty weighted sets (ids, weights): ``coords`` hashes each, two sets
    agreeing in each with probability equal to their weighted Jaccard similarity.

    The region of an element is its weight times rank. Every unit of weight is a column
    with a Poisson process of darts along the rank, all drawn from hashes of (element,
    column, number of the dart): waiting times are exponential, a dart falls at a hashed
    height in the column and on a hashed coordinate. Darts above the element's weight
    miss. Those of rank below (coords ln coords + 2 coords) / total weight are thrown,
    which hit every coordinate mostly; while one is left empty the rank doubles. So a
    set costs one hash for each unit of weight and a fixed number of darts, however
    many coordinates there are. All sets are thrown at together, dart by dart.
    """
    ids = np.concatenate([x for x, _ in sets])
    weights = np.concatenate([w for _, w in sets]).astype(np.float64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x, _ in sets])
    columns = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(ids)), columns)
    column = np.arange(len(at)) - np.repeat(np.cumsum(columns) - columns, columns)
    key = mix(ids[at] + mix(column.astype(np.uint64) * _U(0xD1342543DE82EF95) + _U(seed)))
    room = weights[at] - column  # the part of the column below the weight
    doc = owner[at]
    limit = (coords * math.log(coords) + 2 * coords) / np.bincount(owner, weights, len(sets))
    best_rank = np.full(len(sets) * coords, np.inf)
    best = np.zeros(len(sets) * coords, np.uint64)
    waiting: list[tuple[np.ndarray, np.ndarray, int]] = []  # columns, rank of their next dart, its number

    def wait(cols: np.ndarray, number: int) -> np.ndarray:
        return -np.log(unit(mix(key[cols] + _U((2 * number + 2) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))))

    def throw(cols: np.ndarray, rank: np.ndarray, number: int) -> None:
        """All darts below the limit; columns wait with their first dart above it."""
        slots, ranks, darts = [], [], []
        while len(cols):
            over = rank >= limit[doc[cols]]
            waiting.append((cols[over], rank[over], number))
            cols, rank = cols[~over], rank[~over]
            d = mix(key[cols] + _U((2 * number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            hit = unit(mix(d ^ _U(0xA0761D6478BD642F))) <= room[cols]
            d = d[hit]
            slots.append(doc[cols[hit]] * coords + ((d >> _U(40)) % _U(coords)).astype(np.int64))
            ranks.append(rank[hit])
            darts.append(d)
            number += 1
            rank = rank + wait(cols, number)
        if slots:
            slot, r, d = np.concatenate(slots), np.concatenate(ranks), np.concatenate(darts)
            sooner = r < best_rank[slot]
            slot, r, d = slot[sooner], r[sooner], d[sooner]
            order = np.argsort(-r, kind="stable")  # the earliest is written last
            best_rank[slot[order]], best[slot[order]] = r[order], d[order]

    every = np.arange(len(key))
    throw(every, wait(every, 0), 0)
    while (empty := ~np.isfinite(best_rank.reshape(-1, coords)).all(axis=1)).any():
        limit[empty] *= 2
        todo, waiting[:] = [(c[m], r[m], n) for c, r, n in waiting for m in (empty[doc[c]],)], []
        for x in todo:
            throw(*x)
    return best.reshape(-1, coords)


def bands(sig: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    h = np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    for i in range(rows):
        h = mix(h + sig[i : n * rows : rows])
    return h.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest of the word sequence, low bytes of the signature and band hashes of each
    row; nulls where there is no word."""

    def chunks(batch: pa.RecordBatch) -> Iterator[list[tuple[int, list[bytes]]]]:
        """Rows with their words, so many at a time that about 500,000 words and darts are held."""
        part, n = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = (text.as_py() or "").encode().split()
            part.append((doc_id, words))
            n += len(words) + 8 * COORDS  # darts: coords (ln coords + 2)
            if n > 500_000:
                yield part
                part, n = [], 0
        yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in chunks(batch)):
            full = [w for _, w in part if w]
            sigs = iter(dart_minhash([elements(shingles(w)) for w in full]) if full else [])
            cols: list[list] = [[], [], [], []]
            for doc_id, words in part:
                row = (doc_id, None, None, None)
                if words:
                    sig = next(sigs)
                    row = (doc_id, hashlib.md5(b" ".join(words)).digest(), sig.astype(np.uint8).tobytes(), bands(sig))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "digest", "low", "bands"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    return src.mapInArrow(lambda batches: trimmed(run(batches)), "id long, digest binary, low binary, bands array<long>")


def texts_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the given ids, written once: filtered by a broadcast of counted ids, beyond
    the bound by a join."""
    ids = stage(ids.distinct(), "nd-ids")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    words = words_of(F.col("text"))
    digest = F.when(F.size(words) > 0, F.md5(F.array_join(words, " ").cast("binary")))  # as in signatures(); null is passed over
    found = src.join(maybe_broadcast(ids, BROADCAST_IDS), "id", "left_semi")
    return stage(found.groupBy("id").agg(F.min_by("text", digest).alias("text")), "nd-texts")


def alike(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose signatures agree in ``LOW_AGREE`` coordinates; no text travels."""
    left = known.select(F.col("rep").alias("a"), F.col("low").alias("la"))
    right = known.select(F.col("rep").alias("b"), F.col("low").alias("lb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                la, lb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                keep = pa.array((la == lb).sum(axis=1) >= LOW_AGREE)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "la", "lb").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, similarity_: float) -> DataFrame:
    """Those pairs (a, b) whose texts' shingles are similar enough."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (shingles(t.as_py().encode().split()) for t in (ta, tb))
                keep.append(similarity(a, b) >= similarity_)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(lambda batches: trimmed(run(batches)), "a long, b long")


def blocked(members: DataFrame) -> DataFrame:
    """``members`` of buckets (band) by pairs of blocks (b1, b2) of about ``BLOCK`` of them: each row once
    for every block of its bucket. Buckets of one block, nearly all, are not looked up anywhere;
    the sizes of the others are broadcast where they are counted small, so no bucket meets in a task."""
    size = members.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    size = maybe_broadcast(stage(size.select("band", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")), "nd-large"), BROADCAST_IDS)
    dealt = members.join(size, "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other"))


def candidates(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, later rows j, coordinates agreed) of the rows of two blocks sorted by rep: pairs of different
    components, of the two blocks, that agree enough and have their first common bucket here."""
    band, two = t["band"][0].as_py(), t["b1"][0].as_py() != t["b2"][0].as_py()
    block, comp = t["block"].to_numpy(), t["comp"].to_numpy()
    low = np.frombuffer(b"".join(t["low"].to_pylist()), np.uint8).reshape(len(block), -1)
    buckets = np.array(t["bands"].to_pylist(), np.int64)
    for i in range(len(block) - 1):
        ok = comp[i + 1 :] != comp[i]
        if two:
            ok &= block[i + 1 :] != block[i]
        j = np.flatnonzero(ok) + i + 1
        if len(j):
            agree = (low[j] == low[i]).sum(axis=1)
            j, agree = j[agree >= LOW_AGREE], agree[agree >= LOW_AGREE]
        if len(j):
            first = (buckets[j] == buckets[i]).argmax(axis=1)
            here = buckets[i][first] == band
            if here.any():
                yield i, j[here], agree[here]


def settle(members: DataFrame, known: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity_: float) -> DataFrame:
    """Links between different components inside buckets, enough to join all that have one.

    members: (band, rep, comp); known: (rep, low, bands); texts: ids (rep) -> (rep, text). A bucket is
    cut into blocks of about ``BLOCK`` members, and a task sees two blocks, whatever the size of the
    bucket. First only signatures travel, and a row comes out for each member of two blocks that has a
    candidate there; the texts of these few, in the blocks where they have one, travel next. There every candidate is verified
    on its shingles, unless links found before already join the two. Only links come out, never pairs.
    """
    cols = ["band", "b1", "b2", "block", "rep", "comp", "low", "bands"]
    kind = "band long, b1 long, b2 long, block long, rep long, comp long, low binary, bands array<long>"
    rows = blocked(members).join(known, "rep").select(*cols)

    def some(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        has = np.zeros(t.num_rows, bool)
        for i, j, _ in candidates(t):
            has[i] = True
            has[j] = True
        return t.filter(pa.array(has))

    few = stage(rows.groupBy("band", "b1", "b2").applyInArrow(some, kind), "nd-few")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        rep = t["rep"].to_pylist()
        found, own = np.unique(t["comp"].to_numpy(), return_inverse=True)
        top = np.arange(len(found))  # label of each component here
        texts_, sets = t["text"], {}

        def words(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingles(texts_[i].as_py().encode().split())
            return sets[i]

        links = []
        for i, j, agree in candidates(t):
            for x in j[np.argsort(-agree, kind="stable")].tolist():
                p, q = top[own[i]], top[own[x]]
                if p != q and similarity(words(i), words(x)) >= similarity_:
                    top[top == max(p, q)] = min(p, q)
                    links.append((rep[i], rep[x]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    with_text = few.join(texts(few.select("rep")), "rep").select(*cols, "text")
    return with_text.groupBy("band", "b1", "b2").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, similarity_: float = SIMILARITY, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id, kept.

    component_id is the smallest doc_id reachable by links; two documents link if the
    weighted Jaccard of their five-word shingles (weights: occurrences) is at least
    ``similarity_``. Texts of under five words are one shingle; null, empty and blank
    texts link with nothing. Rows of one doc_id are one document: of its texts that whose words
    have the smallest MD5 is compared, and equal words tie it to others through any of them.
    A row without an id cannot be named: it is kept, without a component. Extra columns are ignored.

    1. One pass computes signatures; rows with equal words become one representative.
    2. In every band bucket each representative is paired with the bucket's smallest
       (a star, not all pairs); distinct pairs whose signatures agree in ``LOW_AGREE`` of ``COORDS``
       coordinates are verified on whole texts.
    3. Components of those links. Only buckets that still span several components go on,
       to :func:`settle`, which looks for links between them block by block. Links inside
       a component need no row, so none between components is lost and large groups of
       copies never pair all with all.
    """
    ship(docs.sparkSession)
    sig = stage(signatures(docs, id_col, text_col), "nd-sig")
    worded = sig.where("digest IS NOT NULL")
    reps = stage(worded.groupBy("digest").agg(F.min("id").alias("rep")), "nd-reps")
    # several texts under one id: that of the smallest digest stands for it
    lead = F.min_by(F.struct("low", "bands"), "digest")
    known = stage(worded.join(reps, "digest").where("id = rep").groupBy("rep").agg(lead.alias("s")).select("rep", "s.*"), "nd-known")
    rows = known.select("rep", F.explode("bands").alias("band"))
    hubs = stage(rows.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count("*").alias("n")).where("hub < last"), "nd-hubs")
    shared = stage(join_spread(rows, hubs.select("band", "hub"), "band", counts=hubs.select("band", "n")), "nd-shared")
    pairs = stage(shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "nd-pairs")
    close = stage(alike(pairs, known), "nd-close")
    texts = lambda ids: texts_of(ids, docs, id_col, text_col)
    links = stage(verify(close, texts(close.select(F.explode(F.array("a", "b")).alias("id"))), similarity_), "nd-links")
    comp = connected_components(links)

    named = shared.join(comp, F.col("rep") == F.col("id"), "left").select("rep", "band", F.coalesce("component", "rep").alias("comp"))
    named = stage(named, "nd-named")
    mixed = named.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi AND n > 2")
    mixed = stage(mixed.select("band", "n"), "nd-mixed-bands")
    by_rep = lambda ids: texts(ids.select(F.col("rep").alias("id"))).withColumnRenamed("id", "rep")
    more = stage(settle(stage(join_spread(named, mixed, "band", counts=mixed).drop("n"), "nd-mixed"), known, by_rep, similarity_), "nd-more")
    # rows of equal words, and several texts under one id, tie their documents together
    same = worded.join(reps, "digest").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    found = stage(connected_components(links.unionByName(more).unionByName(same)), "nd-comp")
    out = sig.select(F.col("id").alias("doc_id")).join(found, F.col("doc_id") == F.col("id"), "left")
    out = out.select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    none = F.lit(None).cast("long")
    unnamed = docs.where(F.col(id_col).cast("long").isNull()).select(none.alias("doc_id"), none.alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(unnamed)


def drop_near_duplicates(docs: DataFrame, similarity_: float = SIMILARITY, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id; rows without an id stay.

    Rows that repeat an id become one, that of the smallest text (nulls last, ties by the row
    as JSON). They are looked for among the ids alone; only such rows move.
    """
    found = stage(near_duplicates(docs, similarity_, id_col=id_col, text_col=text_col), "nd-found")
    gone = maybe_broadcast(stage(found.where("NOT kept").select("doc_id").distinct(), "nd-gone"), BROADCAST_IDS)
    left = docs.join(gone, docs[id_col].cast("long") == gone["doc_id"], "left_anti")
    again = stage(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "nd-again")
    if again.isEmpty():
        return left
    again = maybe_broadcast(again, BROADCAST_IDS)
    same = left[id_col].cast("long") == again["doc_id"]
    row = whole_row(docs)
    first = F.min_by(row, F.struct(F.col(text_col).isNull(), F.col(text_col), F.to_json(row)))
    once = left.join(again, same, "left_semi").groupBy(F.col(id_col).cast("long").alias("__id")).agg(first.alias("__row"))
    return left.join(again, same, "left_anti").unionByName(once.select("__row.*"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Every pair that shares a shingle is compared here, and components are closed by recursion.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [len(w) || '|' || array_to_string(w, ' ')] ELSE [] END) AS g FROM d) GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE CAST(m AS DOUBLE) / CAST(x.n + y.n - m AS DOUBLE) >= 0.8),
r(id, low) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.a, r.low FROM l JOIN r ON l.b = r.id)
SELECT id AS doc_id, min(low) AS component_id, id = min(low) AS kept FROM r GROUP BY id
"""
