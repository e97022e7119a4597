"""Packing token sequences by first-fit decreasing on a tournament tree of bin
capacities, run independently in randomised groups."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import maybe_broadcast, stage, table, trimmed
from rivulet.session import ship

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Texts with any other character are left to the library whole: up to here all
#: versions of Unicode agree, composition changes nothing and lower case is one
#: to one. Excluded: C0 separators (blank to Python alone) and U+0130.
_UNUSUAL = re.compile("[^\t-\r -\u012f\u0131-\u024f]")
_WORDS, _PIECES = 250_000, 60_000
#: The steps of a vocabulary that :class:`WordIds` takes word by word. Its pieces never
#: join across white space.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(tokenizer: dict) -> bool:
    """Whether a vocabulary's own description has exactly the steps that are known here."""
    model, added = tokenizer["model"], tokenizer.get("added_tokens") or []
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback", "unk_token"))
    exact = not any(t[k] for t in added for k in ("normalized", "lstrip", "rstrip", "single_word"))
    return plain and exact and tokenizer["normalizer"] == _NORMALIZER and tokenizer["pre_tokenizer"] == _PRE_TOKENIZER


def byte_letters() -> dict[int, str]:
    """Byte -> the printable letter that byte-level vocabularies write for it: itself where
    it is printable in Latin-1, else the next code point from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class PieceIds(dict):
    """Piece -> its ids as little-endian uint32 bytes, merged by the library's model."""

    def __init__(self, model) -> None:
        self.model, self.letters = model, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < _PIECES and len(piece) <= 64:
            self[piece] = out
        return out


class WordIds(dict):
    """Word -> its ids as little-endian uint32 bytes.

    Where :func:`by_words` knows the vocabulary's steps, a text's ids are those of the pieces of its
    blank-separated words in order, merged by the library's model. Texts that hold an added token's string or an
    unusual character, and all texts of any other vocabulary, go to the library whole. The first
    words and pieces seen are kept, up to a fixed number: frequent ones
    come early, and rare ones are not worth their room.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parts = json.loads(self.tokenizer.to_str())
        self.known = by_words(parts)
        self.split = regex.compile(_SPLIT)
        added = "|".join(re.escape(t["content"]) for t in parts.get("added_tokens") or [])
        self.whole_only = re.compile(f"{_UNUSUAL.pattern}|{added}" if added else _UNUSUAL.pattern)
        self.pieces = PieceIds(self.tokenizer.model)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        out = b"".join(map(self.pieces.__getitem__, self.split.findall(word)))
        if len(self) < _WORDS and len(word) <= 64:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if not self.known or self.whole_only.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.lower().split()))


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One per worker process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def token_pieces(
    docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Encodes whole texts (null: empty), ends each with ``end_id`` and cuts pieces of
    at most ``length`` ids. One row per piece; ``ids`` (binary) too if ``keep_ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), struct.pack("<I", end_id)
        for batch in batches:
            cols: list[list] = [[] for _ in range(5 + keep_ids)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py()) + end
                n = len(ids) // 4
                for start in range(0, n, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, start, len(piece) // 4, zlib.crc32(piece), n, piece)
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
            types = [pa.int64()] * 5 + [pa.binary()] * keep_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    schema = PIECES + (", ids binary" if keep_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(lambda batches: trimmed(run(batches)), schema)


class Tournament:
    """First bin, in order of opening, with room for an item: a complete binary tree of
    largest remaining capacities over bins that are all still empty at first."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.half = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.half)

    def put(self, size: int) -> tuple[int, int]:
        """Bin and the room that it had."""
        best, i = self.best, 1
        while i < self.half:
            i *= 2
            if best[i] < size:
                i += 1
        room = best[i]
        at = i - self.half
        best[i] = room - size
        while i > 1:
            i //= 2
            m = best[2 * i] if best[2 * i] >= best[2 * i + 1] else best[2 * i + 1]
            if best[i] == m:
                break
            best[i] = m
        return at, room


#: Equal pieces that may share a group.
COPIES = 64


def occurrences(pieces: DataFrame) -> DataFrame:
    """``pieces`` with occ: 0, and 0 to n - 1 for n equal pieces if they are more than ``COPIES``; these need not
    meet in a task.

    Equal ones are looked for by narrow columns, counted map-side; only they are gathered,
    as one row with a count, and written out again from it."""
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    again = stage(pieces.groupBy(*own).agg(F.count("*").alias("n")).where(F.col("n") > COPIES).select(*own), "pieces-again")
    if again.isEmpty():
        return pieces.withColumn("occ", F.lit(0).cast("long"))
    again = maybe_broadcast(again, 1_000_000).select(*[F.col(c).alias(f"__{c}") for c in own])
    same = F.lit(True)
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    once = pieces.join(again, same, "left_anti").withColumn("occ", F.lit(0).cast("long"))
    many = pieces.join(again, same, "left_semi").groupBy(*pieces.columns).agg(F.count("*").alias("n"))
    many = many.withColumn("occ", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
    return once.unionByName(many)


def pack(pieces: DataFrame, capacity: int = 2048, *, group_pieces: int | None = None, seed: int = 11) -> DataFrame:
    """Adds sequence_id (group * 2^32 + bin, unique) and offset (gapless from 0).

    Pieces go to groups by a seeded hash of their document, place and ids, and, of many equal ones, of the number of the
    copy, so that neither the files of ``pieces``, a written table, nor null and
    repeated ids matter: about ``group_pieces`` in each (8,192, or 2,048 where
    pieces carry their ids, 8 KB each at most). Every
    group is packed by itself: largest first, ties by doc_id, start, ids and copy, each into the
    first bin with room. The groups are independent, bounded and re-run alike, so a
    lost executor costs only its groups.
    """
    ship(pieces.sparkSession)
    n = pieces.count()
    groups = max(1, -(-n // (group_pieces or (2048 if "ids" in pieces.columns else 8192))))
    schema = pieces.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id bigint, offset bigint"

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), *[(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "occ")]])
        lengths = t["length"].to_pylist()
        tree = Tournament(len(lengths), capacity)
        base = key[0].as_py() << 32
        ids, offsets = [], []
        for size in lengths:
            at, room = tree.put(size)
            ids.append(base + at)
            offsets.append(capacity - room)
        t = t.drop_columns(["grp", "occ"])
        return t.append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    at = F.xxhash64("doc_id", "start", "ids_crc32", "occ", F.lit(seed))
    grouped = occurrences(pieces).withColumn("grp", F.pmod(at, F.lit(groups)).cast("long"))
    return grouped.groupBy("grp").applyInArrow(run, schema)


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """Training sequences from pieces packed with their ``ids`` kept: (sequence_id, ids
    binary padded to ``capacity``, n_tokens). A sequence holds at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    body = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    pad = F.lit(struct.pack("<I", pad_id) * capacity)
    return packed.groupBy("sequence_id").agg(body.alias("ids"), F.sum("length").alias("n_tokens")).select(
        "sequence_id", F.substring(F.concat("ids", pad), 1, 4 * capacity).alias("ids"), "n_tokens"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, **kw) -> DataFrame:
    """Encodes and packs ``docs`` (see :func:`token_pieces` and :func:`pack`).

    Null and empty texts are one piece, the end id; texts of any length are cut, never
    shortened; extra columns are ignored; an empty table gives no rows. A row may
    repeat: each copy is packed.
    """
    return pack(stage(token_pieces(docs, tokenizer_path, **kw), "pieces"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
