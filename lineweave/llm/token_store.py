"""A binary store of token ids: Simple-8b segments in plain files, written and read through Spark.

File format. A file is a sequence of segments, each followed by one line end. A segment is, all
little-endian:

====================  =======================================================
8 bytes               magic ``LWTOKEN2``
u32 x 4               block length, documents, blocks, words
u64                   ids
u32                   crc32 of what follows in the segment
i64 x documents       doc_id, 0 where it is null
u32 x documents       ids of the document
u8 x documents        1 where the doc_id is null
u32 x blocks          offset of the block's first word, for decoding a part
u64 x words           Simple-8b words
====================  =======================================================

Documents ascend by doc_id within a segment, across a file's segments and across files by part
number and number within the part. A document never spans segments; a file has ``FILE_SEGMENTS`` of
them at most. Spark's text writer commits the files, so lost executors
and retried tasks leave no half files, and any file system that Spark knows will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.llm import simple8b
from lineweave.llm.bpe import MEMO, Encoder, kept, tokenizer_json
from lineweave.llm.common import Scratch, small_batches

MAGIC = b"LWTOKEN2"
HEAD = struct.Struct("<8s4IQI")
#: Ids after which a segment is closed; it bounds a task's memory.
SEGMENT_IDS = 1 << 20
#: Segments of a file, some 150 MB of common text; a part with more goes on in further files.
FILE_SEGMENTS = 64
#: Ids coded in one go, so that the coder's arrays stay in cache.
SLICE = 1 << 16


def pack_segment(doc_ids: list[int | None], ids: list[bytes], block: int = simple8b.BLOCK) -> bytes:
    """A segment of documents, each given as little-endian u32 ids."""
    values = np.frombuffer(b"".join(ids), "<u4").astype(np.uint64)
    words, offsets, base = [], [], 0
    step = max(1, SLICE // block) * block
    for i in range(0, len(values), step):
        w, o = simple8b.encode(values[i : i + step], block)
        words.append(w)
        offsets.append(o + np.uint32(base))
        base += len(w)
    offset = np.concatenate(offsets) if offsets else np.zeros(0, np.uint32)
    body = b"".join(
        [
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([len(x) // 4 for x in ids], "<u4").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            offset.astype("<u4").tobytes(),
            *(w.astype("<u8").tobytes() for w in words),
        ]
    )
    return HEAD.pack(MAGIC, block, len(doc_ids), len(offset), base, len(values), zlib.crc32(body)) + body


def unpack_segments(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, which of them are null, lengths and ids of each segment of a file."""
    at = 0
    while at < len(content):
        magic, _, docs, blocks, words, n, crc = HEAD.unpack_from(content, at)
        begin = at + HEAD.size
        at = begin + 13 * docs + 4 * blocks + 8 * words
        if magic != MAGIC or zlib.crc32(content[begin:at]) != crc:
            raise ValueError("not a whole token segment")
        doc_ids = np.frombuffer(content, "<i8", docs, begin)
        lengths = np.frombuffer(content, "<u4", docs, begin + 8 * docs)
        null = np.frombuffer(content, np.uint8, docs, begin + 12 * docs).astype(bool)
        offset = np.frombuffer(content, "<u4", blocks, begin + 13 * docs)
        coded = np.frombuffer(content, "<u8", words, begin + 13 * docs + 4 * blocks)
        block = HEAD.unpack_from(content, begin - HEAD.size)[1]
        per = max(1, SLICE // block)
        parts = []
        for b in range(0, blocks, per):
            end = offset[b + per] if b + per < blocks else words
            parts.append(simple8b.decode(coded[offset[b] : end], min(per * block, n - b * block)))
        yield doc_ids, null, lengths, np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        at += 1  # the line end


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, memo: int = MEMO) -> None:
    """Writes the ids of ``docs`` (doc_id integer, text) with ``end_id`` after each document.

    One range exchange puts documents in doc_id order (nulls first; equal ids by their text, so the
    files are the same on every run); its partitions are as many as Spark's settings say. The last
    range key is where a row was read, so rows that are alike in all else spread over ranges too; so
    ``docs`` should come from files or written tables, whose rows stay where they are when a task runs again.
    Texts are encoded after it. A null text is empty and has the end id alone.
    """
    spec = tokenizer_json(tokenizer)
    end = struct.pack("<I", end_id)
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(Encoder, spec, memo)
        doc_ids, ids, n = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), encoder.texts(batch.column("text")), strict=True):
                doc_ids.append(doc_id)
                ids.append(text + end)
                n += len(ids[-1]) // 4
                if n >= SEGMENT_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([pack_segment(doc_ids, ids)], pa.binary())], ["value"])
                    doc_ids, ids, n = [], [], 0
        if doc_ids:
            yield pa.RecordBatch.from_arrays([pa.array([pack_segment(doc_ids, ids)], pa.binary())], ["value"])

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("read"))
        .repartitionByRange("doc_id", "tie", "read")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    segments = ordered.mapInArrow(encode, "value binary")
    # bytes pass through the text writer unchanged; nothing checks that they are UTF-8
    segments.select(F.col("value").cast("string")).write.mode("overwrite").option("compression", "none").option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """One row per stored document: file, place (its rank in the file), doc_id, at (ids before it in
    the file), n_tokens, ids_crc32, and the ids themselves if asked for."""
    small_batches(spark)
    more = ", ids array<long>" if ids else ""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                place, at = 0, 0
                for doc_ids, null, lengths, values in unpack_segments(content.as_py()):
                    ends = np.cumsum(lengths, dtype=np.int64)
                    raw = memoryview(values.astype("<u4").tobytes())
                    crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                    k = len(doc_ids)
                    columns = {
                        "file": pa.array([file] * k, pa.string()),
                        "place": pa.array(np.arange(place, place + k)),
                        "doc_id": pa.array(doc_ids.astype(np.int64), mask=null),
                        "at": pa.array(ends - lengths + at),
                        "n_tokens": pa.array(lengths.astype(np.int64)),
                        "ids_crc32": pa.array(crcs, pa.int64()),
                    }
                    if ids:
                        offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                        columns["ids"] = pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int64)))
                    place, at = place + k, at + int(ends[-1]) if k else at
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    schema = f"file string, place long, doc_id long, at long, n_tokens long, ids_crc32 long{more}"
    return files.mapInArrow(decode, schema)


def token_store_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the store, reads it back, and gives per document: doc_id, start (ids of all documents
    before it), n_tokens (with the end id), ids_crc32.

    The files are read and decoded once. ``start`` comes from each file's total, a row per file,
    summed over the files before it, plus the document's place within its file. Null texts are
    empty (one id); null doc_ids sort first; repeated rows are stored each. An empty table writes
    no segment and gives no row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    path = scratch.path("store")
    write_tokens(docs, path, tokenizer, end_id)
    stored = scratch.table(read_tokens(spark, path), "digest")
    number = [F.regexp_extract("file", p, 1).cast("long") for p in (r"part-(\d+)", r"-c(\d+)\.")]
    files = stored.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy(*number).rowsBetween(Window.unboundedPreceding, -1))
    base = files.select("file", F.coalesce(before, F.lit(0)).alias("base"))
    return stored.join(base, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
