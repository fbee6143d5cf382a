"""Packing by power-of-two decomposition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cohortlens.llm.common import steps
from cohortlens.llm.tokens import END_ID, word_tokenizer

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
          "offset long, bucket int")
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())


def piece_lengths(n: int, most: int) -> list[int]:
    """Binary lengths that add up to n: full sequences first, then the set bits of the rest downwards."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if (n % most) >> k & 1]


def pack(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = END_ID) -> DataFrame:
    """Cut each document into pieces of power-of-two lengths, each a sequence of its own.

    A document of n ids (its end id included) becomes n // most full sequences and one for each set
    bit of the rest. No sequence crosses documents and none needs padding; sequences of one
    ``bucket`` (log2 of the length) have equal lengths and batch together. Narrow: no shuffle, so no
    key can be hot. Rows: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset (always 0), bucket.

    ``sequence_id`` is the partition number times 2^40 plus the running number in the partition, as
    in ``monotonically_increasing_id``: unique, and the same when a lost task is run again.
    A null or empty text is one piece holding the end id. Null and repeated doc_ids are kept row by
    row; other columns are ignored. ``most`` must be a power of two.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")

    def cut(batches):
        encode = word_tokenizer(tokenizer).all_ids
        tail = np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        out, held = [[] for _ in KINDS], 0
        for batch in steps(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                ids += tail
                n = len(ids) // 4
                lengths = piece_lengths(n, most)
                k, start = len(lengths), 0
                out[0] += [doc_id] * k
                out[2] += lengths
                for length in lengths:
                    out[1].append(start)
                    out[3].append(ids[4 * start:4 * (start + length)])
                    start += length
                out[4] += [n] * k
                out[5] += range(number, number + k)
                number, held = number + k, held + len(ids)
                if held > 8_000_000:
                    yield _rows(out)
                    out, held = [[] for _ in KINDS], 0
        if out[0]:
            yield _rows(out)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(cut, SCHEMA)


def _rows(columns: list[list]) -> pa.RecordBatch:
    length = np.array(columns[2], np.int64)
    columns = [*columns[:6], np.zeros(len(length), np.int64), np.log2(length).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], [x.split()[0] for x in SCHEMA.split(", ")])


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences in one folder per length."""
    pieces.write.partitionBy("bucket").parquet(path)
