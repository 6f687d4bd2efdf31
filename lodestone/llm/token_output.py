"""Token-ID output (operator 8): documents -> token ids -> rANS-coded segments in ascending doc_id order -> ids again.

write_tokens() range-partitions by doc_id, so that file order is doc_id order, and codes each partition as a stream of
segments of about SEGMENT tokens. A segment has one frequency table that its interleaved blocks share; blocks carry a
checkpoint (the place of their first token) and a checksum, so each can be decoded on its own. Parquet is the container:
Spark commits the files, and a lost executor only repeats its partition. read_tokens() decodes segments in parallel.

Defined results: doc_ids are whole numbers or null; null text is empty text; an empty text is the end id alone; repeated
rows and repeated doc_ids are kept, each as a row, in order of doc_id (null first) and then text; an empty table writes no
segment; other columns are ignored. A segment may hold any number of distinct ids.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import fresh_path, table
from lodestone.llm.rans import pack_segment, unpack_segment

SEGMENT = 1 << 20
#: Pieces that a Python worker remembers (twice as many at most, in two generations).
PIECES_KEPT = 400_000
#: What a vocabulary file has to say for its texts to be cut into pieces here: byte-level, without a normaliser.
_PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
SEGMENT_SCHEMA = "part int, seg int, n_tokens long, doc_ids array<long>, lengths array<long>, ids_table binary, blocks array<struct<at:long,n:long,crc:long,data:binary>>"
_SEGMENT = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids_table", pa.binary()), ("blocks", pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("data", pa.binary())])))])

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Texts of these characters alone are cut by _PIECE just as the vocabulary's own pattern cuts them.
_OTHER = re.compile(rf"[^\n\t\r -~{_LETTERS}]")
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")


class Recent(dict):
    """A bounded memory in two generations: when the younger one is full it becomes the older one."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
            if len(key) > 48:
                return out
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class PieceEncoder:
    """Ids of a text as little-endian 32-bit integers, with the tokenizers library.

    Texts of ASCII and western letters are cut into pieces as the vocabulary's pattern cuts them; the library's model is
    asked once for each piece that a bounded memory doesn't hold. All other texts go to the tokenizer whole, as do all texts
    of a vocabulary that isn't plainly byte-level (another pattern, a blank put before the text, a normaliser).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.visible = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}  # bytes as this kind of vocabulary spells them
        assert {chr(c) for c in self.visible.values()} == set(ByteLevel.alphabet())
        self.pieces = Recent(self.piece, PIECES_KEPT)
        told = json.loads(self.tokenizer.to_str())
        cutter = told["pre_tokenizer"] or {}
        plain_model = {k: told["model"].get(k) for k in _PLAIN_MODEL} == _PLAIN_MODEL
        self.plain = plain_model and not (told["normalizer"] or told["truncation"] or told["padding"]) and [cutter.get(k) for k in ("type", "add_prefix_space", "use_regex")] == ["ByteLevel", False, True]

    def piece(self, text: str) -> bytes:
        spelt = text.encode().decode("latin-1").translate(self.visible)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(spelt)])

    def encode(self, text: str) -> bytes:
        if not self.plain or _OTHER.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))


@lru_cache(2)
def encoder_for(path: str) -> PieceEncoder:
    """One encoder for all tasks of a Python worker."""
    return PieceEncoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, segment: int = SEGMENT) -> None:
    """Writes the segments of docs (doc_id, text) under path."""
    from pyspark import TaskContext

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, encoder, end = TaskContext.get().partitionId(), 0, encoder_for(vocabulary), np.array([end_id], "<u4").tobytes()
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            ids_table, blocks = pack_segment(ids)
            return pa.RecordBatch.from_pylist([{"part": part, "seg": seg, "n_tokens": len(ids), "doc_ids": doc_ids, "lengths": [len(x) // 4 for x in held], "ids_table": ids_table, "blocks": blocks}], _SEGMENT)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                held.append(encoder.encode(text) + end)
                doc_ids.append(doc_id)
                size += len(held[-1]) // 4
                if size >= segment:
                    yield flush()
                    doc_ids, held, size, seg = [], [], 0, seg + 1
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the beginning of the text divides rows that have one doc_id, or none
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(code, SEGMENT_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, where asked for, ids, from the segments under path."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                all_ids = unpack_segment(row["ids_table"], row["blocks"]).astype("<u4")
                lengths = np.asarray(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                each = [all_ids[e - n : e] for e, n in zip(ends, lengths, strict=True)]
                out = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "part": pa.array([row["part"]] * len(each), pa.int32()), "seg": pa.array([row["seg"]] * len(each), pa.int32()), "inside": pa.array(ends - lengths), "n_tokens": pa.array(lengths), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())}
                if ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(all_ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*out.values()], names=[*out])

    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    docs = segments.mapInArrow(decode, "doc_id long, part int, seg int, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
    sizes = segments.select("part", "seg", F.col("n_tokens").alias("seg_tokens"))
    # running totals in two steps: over the partitions (as many as the range shuffle has), then within each
    before = lambda w: F.coalesce(F.sum("seg_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("seg_tokens").alias("seg_tokens"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_start"))
    inner = sizes.select("part", "seg", before(Window.partitionBy("part").orderBy("seg")).alias("seg_start"))
    starts = inner.join(parts, "part").select("part", "seg", (F.col("part_start") + F.col("seg_start")).alias("first"))
    return docs.join(starts, ["part", "seg"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def token_output(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path, vocabulary or default_vocabulary())
    return read_tokens(spark, path, ids=False)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
