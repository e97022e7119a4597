"""Token counts through a digest cache: only distinct misses are encoded."""

from __future__ import annotations

import hashlib
import importlib.metadata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import join_spread, stage, table
from rivulet.session import scratch_root, ship

CACHE = "tokenizer string, digest binary, n_tokens long"
_MODELS: dict[str, object] = {}


def as_is(text: Column) -> Column:
    """The normal form that never changes a count: null becomes empty."""
    return F.coalesce(text, F.lit(""))


def tokenizer_digest(path: str, form: str = "as_is") -> str:
    """Digest of the vocabulary file, the library's version and the normal form."""
    lib = "sentencepiece" if path.endswith(".model") else "tokenizers"
    h = hashlib.sha256(f"{lib} {importlib.metadata.version(lib)} {form}\n".encode())
    with open(path, "rb") as f:
        h.update(f.read())
    return h.hexdigest()


def _counter(path: str):
    """Count function of a vocabulary, loaded once per worker process."""
    if path not in _MODELS:
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            sp = SentencePieceProcessor(model_file=path)
            _MODELS[path] = lambda text: len(sp.encode(text, num_threads=1))
        else:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tk = Tokenizer.from_file(path)
            tk.no_truncation()
            tk.no_padding()
            _MODELS[path] = lambda text: len(tk.encode(text, add_special_tokens=False).ids)
    return _MODELS[path]


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer; a digest that two runs appended counts once."""
    try:
        known = spark.read.schema(CACHE).option("recursiveFileLookup", "true").parquet(cache)
    except Exception as e:  # a cache that nobody has written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], CACHE)
    return known.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, path: str, cache: str, limit: int = 4096, *, id_col: str = "doc_id", text_col: str = "text", normal=as_is
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    ``cache`` is a folder that all executors share. Texts are reduced to one per
    digest before the shuffle's reduce side (a map-side first), anti-joined with the
    cache on the digest, and only what is left is encoded; the counts are appended
    as files under a new name, so a failed or repeated run leaves no half entry. The
    rows then join their counts on the digest alone, without texts; digests of more than
    one row in 10,000 (so that many at most) are broadcast, so no task gets all copies of one.

    Null and empty texts count as the empty text; a text is encoded whole; equal
    texts, repeated rows, empty tables and extra columns need nothing special.
    """
    spark = docs.sparkSession
    ship(spark)
    tokenizer = tokenizer_digest(path, normal.__name__)
    text = normal(F.col(text_col))
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text.alias("text"),
    )
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache, tokenizer), "digest", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            counts = [count(t.as_py()) for t in batch.column(1)]
            names = pa.array([tokenizer] * len(counts), pa.string())
            yield pa.RecordBatch.from_arrays([names, batch.column(0), pa.array(counts, pa.int64())], names=["tokenizer", "digest", "n_tokens"])

    misses.mapInArrow(run, CACHE).write.parquet(f"{cache}/add-{uuid.uuid4().hex}")
    found = read_cache(spark, cache, tokenizer)
    rows = stage(keyed.select("doc_id", "n_bytes", "digest"), "token-rows")
    out = join_spread(rows, found, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so every distinct text is encoded here."""
    import public_tokenizers

    cache = f"{scratch_root(spark)}/rivulet/token-cache-{uuid.uuid4().hex}"
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)
