"""Token sequences as length-delimited binary records, with an offset index for shuffled reads.

A folder holds ``shards``, files of frames in ascending order of id, and ``index``, a Parquet table with one
row per record.  A frame, numbers little-endian:

    length of the payload, 8 bytes | masked checksum of those 8 bytes, 4 | payload | masked checksum of it, 4 | line feed

and a payload: bytes of one token id (2 or 4), whether the record has an id, that id in 8 bytes, the token
ids.  A masked checksum is a CRC-32 rotated right by 15 bits plus a constant, so that a payload which itself
holds frames is not taken for one.  The line feed is what Spark's text sink ends a row with: frames go
through that sink, so shards are written by its commit protocol to any storage Spark writes to, and a
lost or repeated task leaves no partial file behind.

Documents are range-partitioned by id once, as text, and encoded in order inside the tasks; rows of one id
are spread by their text and place in the input, so no id has to fit one task.  Ids of all documents
before a shard come from one sum per shard and one per ``GROUP`` shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlab.llm import words as W
from pairlab.llm.tables import text_bytes
from pairlab.llm.tokens import word_tokens

#: Bytes of text that go to one shard, about; a shard is read whole by one task, with some copies of it in memory.
SHARD_BYTES = 8 << 20
#: Shards whose sizes are added up together, on the way to the ids before each.
GROUP = 1000

# The usual constant of masked checksums, and the sizes of a frame's parts.
_MASK_DELTA = 0xA282EAD8
_HEAD, _FOOT, _OWN = "<QI", "<IB", "<BBq"
_HEAD_BYTES, _FOOT_BYTES, _OWN_BYTES = 12, 5, 10


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack(_FOOT, masked(payload), 0x0A)


def payload_at(data: bytes | memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the frame at ``at``, and where the next frame begins; a damaged frame is an error."""
    view = memoryview(data)
    if at + _HEAD_BYTES > len(view):
        raise ValueError(f"the frame at {at} is cut off")
    size, check = struct.unpack_from(_HEAD, view, at)
    if masked(view[at: at + 8]) != check:
        raise ValueError(f"the length at {at} is damaged")
    begin = at + _HEAD_BYTES
    if begin + size + _FOOT_BYTES > len(view):
        raise ValueError(f"the frame at {at} is cut off")
    payload = view[begin: begin + size]
    if struct.unpack_from(_FOOT, view, begin + size) != (masked(payload), 0x0A):
        raise ValueError(f"the record at {at} is damaged")
    return payload, begin + size + _FOOT_BYTES


def payload_of(name: int | None, width: int, ids: bytes) -> bytes:
    return struct.pack(_OWN, width, name is not None, name or 0) + ids


def record(payload: memoryview | bytes) -> tuple[int | None, np.ndarray]:
    """Id and token ids of a payload."""
    width, has_id, name = struct.unpack_from(_OWN, payload)
    return name if has_id else None, np.frombuffer(payload, dtype=f"<u{width}", offset=_OWN_BYTES)


def record_at(file: BinaryIO, offset: int) -> tuple[int | None, np.ndarray]:
    """The record at an offset of a shard that is open for reading: what a data loader needs beside the index."""
    file.seek(offset)
    head = file.read(_HEAD_BYTES)
    size = struct.unpack(_HEAD, head)[0] if len(head) == _HEAD_BYTES else 0
    if len(head) == _HEAD_BYTES and masked(head[:8]) != struct.unpack(_HEAD, head)[1]:
        raise ValueError(f"the length at {offset} is damaged")
    return record(payload_at(head + file.read(size + _FOOT_BYTES), 0)[0])


def _frames(tokenizer: str, end: int):
    out = pa.schema([("frame", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        width = 2 if max(tokens.whole.get_vocab_size(with_added_tokens=True), end) <= 0xFFFF else 4
        for batch in batches:
            buf, offsets = W.text_buffer(batch.column(1))
            names = batch.column(0).to_pylist()
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + W.SLICE_BYTES, side="right")) - 1)
                ids, n = tokens.encode_buffer(buf[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                after = np.cumsum(n) + np.arange(1, j - i + 1)
                ids = np.insert(ids, np.cumsum(n), end).astype(f"<u{width}").tobytes()
                found, at = [], 0
                for name, stop in zip(names[i:j], (after * width).tolist(), strict=True):
                    found.append(frame(payload_of(name, width, ids[at:stop]))[:-1])  # the sink adds the line feed
                    at = stop
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], schema=out)
                i = j

    return run


def _parse(shard: str, content: memoryview, with_ids: bool) -> pa.RecordBatch:
    rows: dict[str, list] = {k: [] for k in ("record", "offset", "bytes", "doc_id", "before", "n_tokens", "ids_crc32", "ids")}
    at = before = number = 0
    while at < len(content):
        payload, after = payload_at(content, at)
        name, ids = record(payload)
        ids = ids.astype("<u4").tobytes()
        n = len(ids) // 4
        for key, value in zip(rows, (number, at, after - at, name, before, n, zlib.crc32(ids), ids if with_ids else None), strict=True):
            rows[key].append(value)
        at, before, number = after, before + n, number + 1
    columns = [pa.array([shard] * number, pa.string()), *[pa.array(v, t) for v, t in zip(rows.values(), [pa.int64()] * 7 + [pa.binary()], strict=True)]]
    return pa.RecordBatch.from_arrays(columns, names=["shard", *rows])


_PARSED = "shard string, record long, offset long, bytes long, doc_id long, before long, n_tokens long, ids_crc32 long, ids binary"


def _shards(spark: SparkSession, folder: str, with_ids: bool) -> DataFrame:
    """Records of all shards, checked and in order within each; ``before`` counts the ids before a record in its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0), batch.column(1), strict=True):
                part = _parse(shard.as_py(), memoryview(content.as_buffer()), with_ids)
                for at in range(0, part.num_rows, 4096):
                    yield part.slice(at, 4096)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/shards")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content").mapInArrow(run, _PARSED)


def write_records(
    docs: DataFrame, tokenizer: str, folder: str, id_column: str = "doc_id", text: str = "text", end: int = 2, shard_bytes: int = SHARD_BYTES
) -> None:
    """Write each text's token ids and ``end`` as one record, in ascending order of id, with the index.

    Defined cases: null and empty texts are records of ``end`` alone; rows with a null id come first;
    repeated rows and ids are records of their own, equal ids in order of a hash of their texts; a text of any
    length is one record; an empty table gives no shards and an empty index; other columns are left out.
    """
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    parts = max(1, -(-text_bytes(source, "text") // shard_bytes))
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("place")]
    dealt = source.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    frames = dealt.select("id", "text").mapInArrow(_frames(tokenizer, end), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.text(f"{folder}/shards", lineSep="\n")
    spark = docs.sparkSession
    found = _shards(spark, folder, False).select("shard", "record", "offset", "bytes", "doc_id", "before", "n_tokens")
    found.write.parquet(f"{folder}/index")


def _bases(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, base): ids of all records in the shards before, by the numbers that Spark gives files of a sorted table."""
    sizes = spark.read.parquet(f"{folder}/index").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    sizes = sizes.withColumn("number", F.regexp_extract("shard", r"^part-(\d+)", 1).cast("long")).withColumn("many", F.floor(F.col("number") / GROUP))
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("inside", F.coalesce(F.sum("n").over(before.partitionBy("many")), F.lit(0)))
    groups = sizes.groupBy("many").agg(F.sum("n").alias("n"), F.min("number").alias("number"))
    groups = groups.select("many", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return inside.join(groups, "many").select("shard", (F.col("base") + F.col("inside")).alias("base"))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: shard, record, offset, bytes, doc_id, start, n_tokens; ``start`` counts all ids before."""
    index = spark.read.parquet(f"{folder}/index").join(_bases(spark, folder), "shard")
    return index.select("shard", "record", "offset", "bytes", "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens")


def read_records(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Records as the shards hold them: shard, record, doc_id, start, n_tokens, ids_crc32, and ids (32-bit) if asked."""
    found = _shards(spark, folder, with_ids).join(_bases(spark, folder), "shard")
    columns = ["shard", "record", "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"]
    return found.select(*columns, *(["ids"] if with_ids else []))


def read_shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """Records in an order that depends on ``seed`` alone: the index is dealt by a hash, the records follow."""
    order = F.xxhash64(F.lit(seed), "shard", "record")
    records = read_records(spark, folder)
    return records.withColumn("turn", order).repartitionByRange("turn", "shard", "record").sortWithinPartitions("turn", "shard", "record")
