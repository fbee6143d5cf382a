"""Token ids as length-delimited binary records with an offset index.

A record is: length of the payload (unsigned 64-bit), masked crc32 of those eight bytes, payload,
masked crc32 of the payload (both unsigned 32-bit), and a line feed; all little-endian. The payload
holds the doc_id (signed 64-bit; a null id is the smallest number), then the ids, in unsigned 16-bit
numbers if all fit (marked by a leading byte 2, else 4).
Files are written by Spark's text writer, which passes bytes on unchanged and ends rows with the
line feed, so any file system and Spark's commit protocol serve; ``binaryFile`` reads them back.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import parts_for, steps, text_bytes
from cohortlens.llm.tokens import END_ID, word_tokenizer
from cohortlens.session import shared_dir

NULL_ID = -(1 << 63)
#: Bytes of text in one file, so that a reader can hold a file; about as many bytes of records.
FILE_BYTES = 12_000_000
_HEAD = struct.Struct("<QI")
INDEX = "shard int, doc_id long, offset long, size long, n_tokens long, ids_crc32 long, before long"


def masked(crc: int) -> int:
    """Rotated and shifted, so that checksums of data that hold checksums stay useful."""
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    small = not len(ids) or int(ids.max()) < 1 << 16
    payload = struct.pack("<Bq", 2 if small else 4, NULL_ID if doc_id is None else doc_id) + ids.astype("<u2" if small else "<u4").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(zlib.crc32(length))) + payload + struct.pack("<I", masked(zlib.crc32(payload)))


def parse(data: bytes, offset: int = 0):
    """(doc_id, ids, offset, size) of each record; a wrong checksum raises."""
    while offset < len(data):
        length, check = _HEAD.unpack_from(data, offset)
        if masked(zlib.crc32(data[offset:offset + 8])) != check:
            raise ValueError(f"length checksum differs at byte {offset}")
        payload = data[offset + 12:offset + 12 + length]
        if masked(zlib.crc32(payload)) != struct.unpack_from("<I", data, offset + 12 + length)[0]:
            raise ValueError(f"payload checksum differs at byte {offset}")
        width, doc_id = struct.unpack_from("<Bq", payload)
        size = length + 17
        yield None if doc_id == NULL_ID else doc_id, np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4"), offset, size
        offset += size


@dataclass
class RecordFiles:
    """Record files under ``data`` (numbered in doc_id order) and their Parquet index under ``index``."""

    data: str
    index: str

    def read_index(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(INDEX).parquet(self.index)

    def read(self, spark: SparkSession) -> DataFrame:
        """(shard, doc_id, ids binary, offset, size) of every record, checksums verified."""
        def open_file(batches):
            for batch in batches:
                for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                    rows = [(_shard(path), d, i.tobytes(), o, s) for d, i, o, s in parse(data)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))],
                        ["shard", "doc_id", "ids", "offset", "size"])

        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(self.data)
        return files.select("path", "content").mapInArrow(open_file, "shard int, doc_id long, ids binary, offset long, size long")


def _shard(path: str) -> int:
    return int(path.rsplit("/part-", 1)[1].split("-")[0])


def write_records(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID,
                  file_bytes: int = FILE_BYTES) -> RecordFiles:
    """Encode every whole text, append the end id, and write framed records in ascending doc_id order.

    Texts are dealt by doc_id ranges, so file order is doc_id order; a file is one task, which
    encodes as it writes. The index is then read from the files as they are: shard, byte offset and
    size of each record for shuffled reads, number and crc32 of its ids, and the ids before it.
    A null or empty text holds the end id alone. Null doc_ids come first; rows of one doc_id are
    all written, ordered by text. Other columns are ignored; an empty table gives no records.
    """
    spark = docs.sparkSession
    root = path or f"{shared_dir(spark).rstrip('/')}/records/{uuid.uuid4().hex[:12]}"
    files = RecordFiles(f"{root}/data", f"{root}/index")

    def encode(batches):
        encoder, tail = word_tokenizer(tokenizer), struct.pack("<I", end_id)
        for batch in steps(batches):
            ids = encoder.all_ids(batch.column("text").to_pylist())
            out = [frame(d, np.frombuffer(i + tail, "<u4")) for d, i in zip(batch.column("doc_id").to_pylist(), ids)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = parts_for(spark, text_bytes(rows), file_bytes)
    ranged = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ranged.mapInArrow(encode, "frame binary").select(F.col("frame").cast("string").alias("value")).write.text(files.data)

    def describe(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                shard, before, out = _shard(path), 0, []
                for doc_id, ids, offset, size in parse(data):
                    out.append((shard, doc_id, offset, size, len(ids), zlib.crc32(ids.tobytes()), before))
                    before += len(ids)
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(zip(*out))],
                        [x.split()[0] for x in INDEX.split(", ")])

    written = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(files.data)
    written.select("path", "content").mapInArrow(describe, INDEX).write.parquet(files.index)
    return files


def positions(files: RecordFiles, spark: SparkSession) -> DataFrame:
    """Index rows with ``start``: the ids of all documents before, over all files.

    Totals are one row per file; their running sum is the only thing one task makes.
    """
    from pyspark.sql import Window

    index = files.read_index(spark)
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return index.join(base, "shard").withColumn("start", F.col("base") + F.col("before")).drop("base")
