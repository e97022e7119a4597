"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts,
cut into parts by key, to which tokens are dealt to probe it level by level."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import stage, table
from rivulet.session import ship

#: Words before a token that are its context.
CONTEXT = 3
#: Most frequent words whose exact counts are broadcast (16 bytes each); the others join by their own key.
HEAD = 1 << 18
#: Tokens of one part of the filter, about: the lesser, until there are ``PARTS`` of them, then more, up to the greater.
PART_TOKENS, PARTS = (1_500_000, 2_000_000), 20_000
#: Contexts of more tokens are resolved before tokens are dealt; there is one for so many tokens at most.
HOT = 500_000
#: One token in so many is looked at for such contexts.
SAMPLED = 64
#: Quantisation: level l stands for counts from BASE**(l-1) to under BASE**l.
BASE = 1.5
LEVELS = 110
PROBES = 5
BITS_PER_ENTRY = 16
SEGMENTS = 256
#: Bound of one part of the filter; a larger corpus has more parts.
MAX_BITS = 1 << 29
#: Weight of the unigram distribution in a context, in counts.
MU = 4.0
END_KEY, START_KEY = (xxhash.xxh3_64_intdigest(x) for x in "\n\t")  # white space, so never words
_U = np.uint64
#: Of a dealt token's 32-bit code: not learnt from; not one of the head; its context is resolved.
_OUT, _TAIL, _ALONE = np.uint32(1 << 31), np.uint32(1 << 30), np.uint32(1 << 29)
#: Columns of a text's or a part's sums, and of the tokens dealt to a part.
SUMS = [pa.field(k, t) for k, t in (("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_log", pa.float64()), ("score", pa.float64()))]
PARTIAL = [pa.field(k, pa.binary()) for k in ("rows", "known", "bases", "scores")]
ANSWER = [pa.field("home", pa.int32()), *SUMS, *PARTIAL]
TOKENS = ("ctx", "code", "at", "w_word", "w_code", "w_at")
DEALT = [pa.field("part", pa.int32()), *SUMS, *[pa.field(k, pa.binary()) for k in TOKENS]]


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def count_of() -> np.ndarray:
    """Expected count by level: the mean of the whole numbers of the level; 0 for none."""
    out = [0.0]
    for k in range(1, LEVELS + 1):
        lo, hi = math.ceil(BASE ** (k - 1) - 1e-6), math.ceil(BASE**k - 1e-6) - 1
        out.append((lo + max(lo, hi)) / 2)
    return np.array(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def gram(prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit key of a pair of 64-bit word hashes."""
    return mix(mix(prev + _U(0x9E3779B97F4A7C15)) + word)


def probes(keys: np.ndarray, levels: np.ndarray, seg_bits: int) -> np.ndarray:
    """Bit positions (n x PROBES) of keys at levels, inside each key's own segment."""
    h = mix(keys ^ (levels.astype(np.uint64) * _U(0xD1342543DE82EF95)))
    a, b = h & _U(0xFFFFFFFF), (h >> _U(32)) | _U(1)
    inside = (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % _U(seg_bits)
    return inside


def lookup(bits: np.ndarray, seg_bits: int, keys: np.ndarray) -> np.ndarray:
    """Level of every key: levels are probed upwards until one is not in the filter."""
    out = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    for level in range(1, LEVELS + 1):
        if not len(live):
            break
        k = keys[live]
        at = probes(k, np.full(len(k), level), seg_bits) + ((k & _U(SEGMENTS - 1)) * _U(seg_bits))[:, None]
        on = ((bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1).all(axis=1)
        live = live[on]
        out[live] = level
    return out


def chunks(batch: pa.RecordBatch, column: int, size: int = 2_000_000) -> Iterator[tuple[slice, pa.Array]]:
    """Row ranges with their texts, about ``size`` bytes at a time."""
    texts = batch.column(column)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield slice(start, stop), texts.slice(start, stop - start)
        start = stop


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct token, index into these by token, first token of each text).

    Tokens are the words, A-Z in lower case, then one end for each text. Splitting and
    numbering run in Arrow's compiled code.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    owner = pc.list_parent_indices(lists)
    flat = pc.list_flatten(lists)
    some = pc.not_equal(pc.binary_length(flat), 0)  # blanks at the ends of a text give empty parts
    coded = flat.filter(some).dictionary_encode()
    owner = owner.filter(some).to_numpy(zero_copy_only=False)
    h = np.append(hashes(coded.dictionary.to_pylist()), _U(END_KEY))
    sizes = np.bincount(owner, minlength=len(texts)) + 1
    starts = np.cumsum(sizes) - sizes
    token = np.full(int(sizes.sum()), len(h) - 1, np.int64)
    token[np.arange(len(owner)) + owner] = coded.indices.to_numpy(zero_copy_only=False)
    return h, token, starts


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Position of each key in ``sorted_keys``, -1 where it is not."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


class Held:
    """Counts by key, gathered in parts and summed when they are taken."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([c for _, c in self.parts])).astype(np.int64)
        self.parts, self.size = [], 0
        return keys, counts


def contexts(h: np.ndarray, token: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit key of each token's context: the ``CONTEXT`` tokens before it in its text, with marks of the start where
    there are fewer."""
    at = np.arange(len(token)) - np.repeat(starts, np.diff([*starts, len(token)]))
    key = np.full(len(token), CONTEXT, np.uint64)
    for back in range(CONTEXT, 0, -1):
        before = np.full(len(token), START_KEY, np.uint64)
        before[back:] = np.where(at[back:] >= back, h[token[:-back]], _U(START_KEY))
        key = gram(key, before)
    return key


def counted(docs: DataFrame) -> DataFrame:
    """(kind, h, c) of ``docs`` (row, held_out, text): exact counts of the training tokens by word hash
    (kind 0), and of all contexts in a sample of the tokens by context key (kind 1)."""

    def out(kind: int, held: Held) -> pa.RecordBatch:
        h, c = held.take()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(c)], names=["kind", "h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before = Held(), Held()
        for batch in batches:
            for rows, texts in chunks(batch, 2):
                h, token, starts = numbered(texts)
                row, out_of = (batch.column(i).slice(rows.start, rows.stop - rows.start).to_numpy(zero_copy_only=False) for i in (0, 1))
                sizes = np.diff([*starts, len(token)])
                words.add(h, np.bincount(token[~np.repeat(np.asarray(out_of, bool), sizes)], minlength=len(h)))
                place = np.repeat(mix(row.astype(np.uint64)), sizes) + np.arange(len(token), dtype=np.uint64)
                key = contexts(h, token, starts)[mix(place) % _U(SAMPLED) == 0]
                before.add(key, np.ones(len(key), np.int64))
                for kind, held in ((0, words), (1, before)):
                    if held.size > 1_000_000:
                        yield out(kind, held)
        for kind, held in ((0, words), (1, before)):
            if held.size:
                yield out(kind, held)

    return docs.mapInArrow(run, "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c")).where("c > 0")


def hot_counts(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(ctx, pair, seen, c) of every token after one of the ``hot`` (sorted) contexts: how often the
    pair occurs at all and in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch, 2):
                h, token, starts = numbered(texts)
                out_of = np.repeat(np.asarray(batch.column(1).slice(rows.start, rows.stop - rows.start).to_numpy(zero_copy_only=False), bool), np.diff([*starts, len(token)]))
                key = contexts(h, token, starts)
                m = find(hot, key) >= 0
                both, first, at = np.unique(gram(key[m], h[token[m]]), return_index=True, return_inverse=True)
                seen, c = np.bincount(at, minlength=len(both)), np.bincount(at[~out_of[m]], minlength=len(both))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key[m][first], both, seen, c)], names=["ctx", "pair", "seen", "c"])

    found = docs.mapInArrow(run, "ctx long, pair long, seen long, c long")
    return found.groupBy("ctx", "pair").agg(F.sum("seen").alias("seen"), F.sum("c").alias("c"))


def fill(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Bytes of the filter that holds ``keys`` at levels 1..l of their counts, and its bits a segment."""
    top = level_of(counts)
    seg_bits = max(64, -(-int(top.sum()) * BITS_PER_ENTRY // (SEGMENTS * 8)) * 8)
    on = np.zeros(seg_bits * SEGMENTS, np.uint8)
    for level in range(1, int(top.max(initial=0)) + 1):
        k = keys[top >= level]
        for i in range(0, len(k), 500_000):
            e = k[i : i + 500_000]
            on[(probes(e, np.full(len(e), level), seg_bits) + ((e & _U(SEGMENTS - 1)) * _U(seg_bits))[:, None]).astype(np.int64)] = 1
    return np.packbits(on, bitorder="little"), seg_bits


def packed(x: np.ndarray, order: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value a part: the numbers of ``x`` that go there."""
    data = x[order]
    return pa.array([data[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())


def even_labels(spark: SparkSession, n: int) -> np.ndarray:
    """n different ints that a shuffle by one int column deals evenly: few parts, numbered at random, would often
    meet in a task. Many parts need no care."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n > 20 * tasks:
        return np.arange(n, dtype=np.int32)
    tried = spark.range(16 * max(n, tasks)).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks))).toArrow().column(0).to_numpy()
    turn = np.zeros(len(tried), np.int64)  # how many of the same task come before
    order = np.argsort(tried, kind="stable")
    starts = np.flatnonzero(np.diff(tried[order], prepend=-1))
    turn[order] = np.arange(len(tried)) - np.repeat(starts, np.diff([*starts, len(tried)]))
    return np.argsort(turn * tasks + tried, kind="stable")[:n].astype(np.int32)


def level_value(c: Column) -> Column:
    """What the level of a count stands for, as a column; as :func:`level_of` and :func:`count_of`."""
    level = F.floor(F.log(c.cast("double")) / math.log(BASE) + 1e-9) + 1
    return F.element_at(F.array(*[F.lit(float(x)) for x in count_of()[1:]]), level.cast("int"))


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, head: int = HEAD, mu: float = MU, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    Training texts are those whose crc32(doc_id as text) mod 7 is not 2. ``base_score``
    is the add-one unigram score from exact counts.

    ``score`` is the log10 probability under a model of quantised counts: q(c) is what the
    logarithmic level (base 1.5) of c stands for, 0 for 0. With p1(w) = (q(c(w)) + 1) / (sum of
    q over all words + V + 1), a token w after the three tokens x has
    p = (q(c(x, w)) + mu p1(w)) / (sum of q(c(x, .)) + mu); before the first tokens of a text stand marks of its start.
    For every context these add up to 1, but for false positives of the filter.

    The levels of all four-token sequences and of the words past the ``head`` most frequent lie in a
    Bloom filter of 16 bits an entry, which is cut into parts by key: a sequence goes to the part
    of its context, and to that of its last word too where that is none of the ``head``, whose
    counts are broadcast. A context's sum is that of the filter's answers for what was seen after it.
    Tokens move once, packed, to their parts, which count, fill their piece of the filter, probe it
    and send their sums by text, packed, to a home that adds them up. The number of
    parts grows with the corpus, so that one has 1,500,000 to 2,000,000 tokens and ``max_bits`` bits at
    most on average; nothing is left out. Contexts of more than ``hot`` tokens (found in a sample, then counted
    exactly) do not gather in one part: their sums, and pairs as frequent, are broadcast, one for
    each ``hot`` tokens of the corpus at most, and the rest goes to parts by pair.

    Two passes over whole texts, a third if there are hot contexts. Null and empty texts are one token,
    the end. Without training texts every probability is 1. Null ids count as training;
    repeated rows are scored each, extra columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    held = F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), text.alias("text"))
    counts = stage(counted(src.select("row", "held_out", "text")), "lm-counts")
    words = counts.where("kind = 0")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(level_value(F.col("c"))), F.lit(0.0)).alias("q")).first()
    n, v, whole = int(total.n), int(total.v), float(total.q) + int(total.v) + 1
    top = words.orderBy(F.desc("c"), "h").limit(head).toArrow()
    top_h, top_c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    by_hash = np.argsort(top_h)
    often = counts.where((F.col("kind") == 1) & (F.col("c") * SAMPLED > hot * 0.9)).select("h").toArrow()["h"].to_numpy().view(np.uint64)
    hot_x, hot_mass, hot_p, hot_q = np.sort(often), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0)
    if n and len(hot_x):
        near = stage(hot_counts(src.select("row", "held_out", "text"), hot_x), "lm-hot")
        near = near.withColumn("q", F.when(F.col("c") > 0, level_value(F.col("c"))).otherwise(0.0))
        sums = near.groupBy("ctx").agg(F.sum("q").alias("q")).toArrow()
        x = sums["ctx"].to_numpy().view(np.uint64)
        order = np.argsort(x)
        hot_x, hot_mass = x[order], sums["q"].to_numpy()[order]
        pairs = near.where(F.col("seen") > hot // 2).select("pair", "q").toArrow()
        x = pairs["pair"].to_numpy().view(np.uint64)
        order = np.argsort(x)
        hot_p, hot_q = x[order], pairs["q"].to_numpy()[order]
    known = spark.sparkContext.broadcast((top_h[by_hash], top_c[by_hash], hot_x, hot_mass, hot_p, hot_q))
    # a part has an entry for each training token and each tail word at most; more parts than tasks spread evenly
    each = min(PART_TOKENS[1], max(PART_TOKENS[0], n // PARTS), max_bits // (2 * BITS_PER_ENTRY))
    need = -(-n * 7 // (6 * max(1, each)))
    n_parts = max(1, need, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 10_000))
    labels = even_labels(spark, n_parts)
    base = math.log10(n + (v + 1))
    chunk = min(16_000_000, max(2_000_000, 400 * n_parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_h, head_c, hot_x, hot_mass, hot_p, hot_q = known.value
        values = count_of()
        p1 = (values[level_of(head_c)] + 1) / whole if len(head_c) else np.zeros(0)
        schema = pa.schema(DEALT)
        for batch in batches:
            for rows, texts in chunks(batch, 3, chunk):
                part_of = lambda i: batch.column(i).slice(rows.start, rows.stop - rows.start)  # noqa: E731, B023
                h, token, starts = numbered(texts)
                sizes = np.diff([*starts, len(token)])
                at = find(head_h, h)
                in_head = at >= 0
                exact = np.where(in_head, np.log10(head_c[at] + 1.0), 0.0) if len(head_c) else np.zeros(len(h))
                word_p1 = np.where(in_head, p1[at], 0.0) if len(head_c) else np.zeros(len(h))
                ctx = contexts(h, token, starts)
                in_hot = find(hot_x, ctx) if len(hot_x) else np.full(len(token), -1)
                mass = np.where(in_hot >= 0, hot_mass[in_hot], 0.0) if len(hot_x) else np.zeros(len(token))
                hot_ = in_hot >= 0
                headed = in_head[token]
                alone = np.where(hot_, -np.log10(mass + mu), 0.0)  # what is known here of a token's logarithm
                pair = gram(ctx, h[token])
                done = np.zeros(len(token), bool)
                if len(hot_p):
                    found = np.where(hot_ & headed, find(hot_p, pair), -1)
                    done = found >= 0
                    alone[done] += np.log10(hot_q[found[done]] + mu * word_p1[token[done]])
                docs_ = {"part": labels[np.arange(len(texts)) % n_parts], "n_tokens": sizes.astype(np.int64), "n_known": np.add.reduceat(headed.astype(np.int64), starts)}
                docs_ |= {"base_log": np.add.reduceat(exact[token], starts), "score": np.add.reduceat(alone, starts) if n else np.zeros(len(texts))}
                out = {k: pa.array(x) for k, x in docs_.items()} | {k: part_of(i) for i, k in enumerate(("row", "doc_id", "held_out"))}
                yield pa.RecordBatch.from_arrays([out[f.name] if f.name in out else pa.nulls(len(texts), f.type) for f in schema], schema=schema)
                if not n:
                    continue
                flags = np.repeat(np.where(np.asarray(part_of(2).to_numpy(zero_copy_only=False), bool), _OUT, np.uint32(0)).astype(np.uint32), sizes)
                local = np.repeat(np.arange(len(texts), dtype=np.uint32 if len(texts) > 65_535 else np.uint16), sizes)
                tail_code = (h >> _U(35)).astype(np.uint32) | _TAIL
                code = np.where(in_head, at, 0).astype(np.uint32)[token]
                code = np.where(headed, code, tail_code[token] & ~_ALONE) | flags
                # to the context's part: all but the tail after a hot context; to the word's: the tail
                go = np.flatnonzero(~done & (headed | ~hot_))
                where = np.where(hot_[go], pair[go], ctx[go])
                code = np.where(hot_[go], code[go] | _ALONE, code[go])
                low = lambda x: x.astype(np.uint32)
                got = [(((where >> _U(33)) % _U(n_parts)).astype(np.int32), {"ctx": low(where), "code": code, "at": local[go]})]
                go = np.flatnonzero(~headed)
                word = h[token[go]]
                got.append((((word >> _U(33)) % _U(n_parts)).astype(np.int32), {"w_word": low(word), "w_code": low(pair[go]) >> np.uint32(1) | flags[go], "w_at": local[go]}))
                used = np.unique(np.concatenate([p for p, _ in got]))
                cols = {"part": pa.array(labels[used]), "row": pa.array(np.full(len(used), part_of(0)[0].as_py()))}
                for p, columns in got:
                    order = np.argsort(p.astype(np.uint16) if n_parts < 1 << 16 else p, kind="stable")
                    ends = np.searchsorted(p[order], used, side="right")
                    cols |= {k: packed(x, order, ends) for k, x in columns.items()}
                yield pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(len(used), f.type) for f in schema], schema=schema)

    def home(row: np.ndarray) -> np.ndarray:
        return labels[(mix(row.astype(np.uint64)) % _U(n_parts)).astype(np.int32)]

    def answer(key: tuple, t: pa.Table) -> pa.Table:
        infos = t.filter(pc.is_null(t["ctx"]))
        t = t.filter(pc.is_valid(t["ctx"]))
        out = infos.select([f.name for f in SUMS])
        for f in PARTIAL:
            out = out.append_column(f, pa.nulls(len(out), f.type))
        out = out.add_column(0, ANSWER[0], pa.array(home(infos["row"].to_numpy())))
        if not t.num_rows:
            return out
        head_c = known.value[1]
        values = count_of()
        p1 = mu * (values[level_of(head_c)] + 1) / whole if len(head_c) else np.zeros(0)
        flat = lambda k: np.frombuffer(b"".join(t[k].to_pylist()), np.uint32)

        def rows_of(key: str, at: str) -> np.ndarray:
            """The row of each token: the chunk's first and the text's place in it, 2 or 4 bytes each."""
            lens = pc.divide(pc.binary_length(t[key]), 4).to_numpy()
            size = pc.binary_length(t[at]).to_numpy()
            local = np.concatenate([np.frombuffer(x, np.uint32 if 4 * n_ == s else np.uint16).astype(np.int64) for x, n_, s in zip(t[at].to_pylist(), lens, size, strict=True)])
            return np.repeat(t["row"].to_numpy(), lens) + local

        def seen(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(distinct keys, index into these, training count of each)."""
            distinct, index = np.unique(keys, return_inverse=True)
            return distinct, index, np.bincount(index[learn], minlength=len(distinct))

        ctx, code, w_word, w_code = (flat(k) for k in ("ctx", "code", "w_word", "w_code"))
        pairs, pair, c = seen(ctx.astype(np.uint64) << _U(31) | (code & ~_OUT), code < _OUT)
        rare, word, cw = seen(w_word, w_code < _OUT)
        w_pairs, w_pair, wc = seen(w_word.astype(np.uint64) << _U(31) | (w_code & ~_OUT), w_code < _OUT)
        named = [gram(np.array([i], np.uint64), x.astype(np.uint64)) for i, x in enumerate((pairs, rare, w_pairs))]
        on = [k > 0 for k in (c, cw, wc)]
        bits, seg_bits = fill(np.concatenate([k[m] for k, m in zip(named, on, strict=True)]), np.concatenate([k[m] for k, m in zip((c, cw, wc), on, strict=True)]))
        q, qw, wq = (values[lookup(bits, seg_bits, k)] for k in named)
        # contexts: the pairs are sorted by theirs
        which = np.cumsum(np.diff(pairs >> _U(31), prepend=pairs[:1] >> _U(31)) != 0) if len(pairs) else np.zeros(0, np.int64)
        own = (pairs & _U((1 << 31) - 1)).astype(np.uint32)
        resolved, tail = own & _ALONE != 0, own & _TAIL != 0
        mass = np.bincount(which, np.where(on[0], q, 0.0))[which] if len(pairs) else np.zeros(0)
        alone = np.where(tail, 0, own & ~(_ALONE | _TAIL)).astype(np.int64)
        weight = np.where(tail, 1.0, np.where(resolved, q, np.minimum(q, mass)) + (p1[alone] if len(p1) else 0.0))
        logs = np.log10(weight) - np.where(resolved, 0.0, np.log10(mass + mu))
        # the tail: a sequence is no more frequent than its word
        of_word = np.searchsorted(rare, (w_pairs >> _U(31)).astype(np.uint32))
        w_logs = np.log10(np.minimum(wq, qw[of_word]) + mu * (qw[of_word] + 1) / whole)
        row = np.concatenate([rows_of("ctx", "at"), rows_of("w_word", "w_at")])
        ids, to = np.unique(row, return_inverse=True)
        nothing = np.zeros(len(ctx))
        summed = lambda a, b: np.bincount(to, np.concatenate([a, b]), minlength=len(ids))
        sums = {"rows": ids, "known": summed(nothing, cw[word] > 0).astype(np.int64), "bases": summed(nothing, np.log10(cw[word] + 1.0)), "scores": summed(logs[pair], w_logs[w_pair])}
        at_home = home(ids)
        order = np.argsort(at_home, kind="stable")
        used, first_of = np.unique(at_home[order], return_index=True)
        ends = np.append(first_of[1:], len(order))
        parts = pa.table([pa.array(used), *[pa.nulls(len(used), f.type) for f in SUMS], *[packed(sums[f.name], order, ends) for f in PARTIAL]], schema=pa.schema(ANSWER))
        return pa.concat_tables([out.cast(parts.schema), parts])

    def total_up(key: tuple, t: pa.Table) -> pa.Table:
        infos = t.filter(pc.is_null(t["rows"])).select([f.name for f in SUMS])
        order = np.argsort(infos["row"].to_numpy())
        infos = infos.take(pa.array(order))
        flat = lambda k, kind: np.frombuffer(b"".join(t[k].drop_null().to_pylist()), kind)
        at = np.searchsorted(infos["row"].to_numpy(), flat("rows", np.int64))
        for k, own, kind in (("n_known", "known", np.int64), ("base_log", "bases", np.float64), ("score", "scores", np.float64)):
            more = np.bincount(at, flat(own, kind), minlength=len(infos)).astype(kind)
            infos = infos.set_column(infos.schema.get_field_index(k), k, pa.array(infos[k].to_numpy() + more))
        return infos

    columns = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_log double, score double"
    dealt = src.mapInArrow(deal, f"part int, {columns}, {', '.join(f'{k} binary' for k in TOKENS)}")
    answers = dealt.groupBy("part").applyInArrow(answer, f"home int, {columns}, rows binary, known binary, bases binary, scores binary")
    out = answers.groupBy("home").applyInArrow(total_up, columns)
    return stage(out, "lm-scored").select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_log") - F.col("n_tokens") * base).alias("base_score"),
        F.least("score", F.lit(0.0)).alias("score"),
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
