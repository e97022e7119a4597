"""A corpus in four stages: quality rules, near-duplicates, source mix, packing."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm.common import release, stage, table, written
from rivulet.llm.mixing import mix
from rivulet.llm.neardup import drop_near_duplicates
from rivulet.llm.packing import pack_documents
from rivulet.llm.quality import filter_quality

#: No SQL expresses the signatures and the tokenizer; tests/llm hold run() against brute force.
ORACLE_SQL = None


#: Scratch tables that this thread's last stage has left. Its result is written when the next stage is called, so they go then.
_LEFT = threading.local()


def one_stage(build: Callable[[], DataFrame], first: bool = False) -> DataFrame:
    """A stage's result; what the stage before it left in the scratch folder is deleted, but for the first: a
    result of an earlier run may not have been read yet."""
    if not first:
        release(getattr(_LEFT, "paths", set()))
    before = written()
    out = build()
    _LEFT.paths = written() - before
    return out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_stage(lambda: filter_quality(docs, table(spark, sf_dir, "labels")), first=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_stage(lambda: drop_near_duplicates(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_stage(lambda: mix(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and places; ``rivulet.llm.packing.sequences`` writes them out as padded sequences."""
    import public_tokenizers

    return one_stage(lambda: pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and deleted once the next is written."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        new = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        release({getattr(docs, "_scratch", None)})
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
