"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import stage

#: Characters that separate words; every other character belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Distinct words that one Python worker remembers at most; the memory is emptied beyond it.
REMEMBERED_WORDS = 250_000
#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
STEP_BYTES = 8_000_000

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_ODD = U64(0xD1B54A32D192ED03)


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash, computed once per distinct word."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


#: Shared by all operators that run in one Python worker.
WORD_HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(32))) * _GOLDEN
    x = (x ^ (x >> U64(29))) * _ODD
    return x ^ (x >> U64(32))


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hashed things."""
    return mix(left * _GOLDEN + right)


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def steps(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about STEP_BYTES of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum([len(x) if x is not None else 0 for x in batch.column(column).to_pylist()]) // STEP_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def ordered_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a 64-bit hash by its high bits."""
    return ((h >> U64(32)) * U64(buckets)) >> U64(32)


def planes(values: np.ndarray) -> bytes:
    """Integers as byte planes: high bytes that are mostly zero then compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences in byte planes."""
    return planes(np.diff(keys, prepend=U64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, U64), dtype=U64) if data else np.empty(0, U64)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of text in the whole table; one number for choosing partition counts."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts_for(spark: SparkSession, size: int, target: int, least: int | None = None) -> int:
    """Partitions so that each holds about ``target`` bytes."""
    return max(least or int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // target), 1)


def crc_fold(column: str, modulus: int) -> Column:
    """Remainder of the crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, component), the component
    being the smallest node. Alternates large-star and small-star rounds until every node hangs on a
    node that hangs on none; links that are so from the start take no round. Each round is one written
    table, so lost executors repeat one round at most. Hot nodes are aggregated on the map side and
    their joins are ordinary joins that adaptive execution splits. Links of a node to itself are ignored.
    """
    def settled(df: DataFrame) -> bool:
        ends = df.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(df.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs > 1 or hangs = 1 and holds = 1").isEmpty()

    e = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    rounds = 0
    while not settled(e):
        if rounds == max_rounds:
            raise RuntimeError("components did not settle")
        rounds += 1
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))).distinct())
        e = stage(small, "cc")
    return (e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))


def joined_components(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``found``, as returned by ``components``, after further edges (a, b): these are lifted to the components
    of their ends, so rounds run over the new edges alone."""
    ends = edges
    for side in ("a", "b"):
        of = found.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        ends = ends.join(of, side, "left")
    top = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))).select(F.col("node").alias("was"), F.col("component").alias("now"))
    moved = found.join(top, found["component"] == top["was"], "left").select("node", F.coalesce("now", "component").alias("component"))
    fresh = top.join(found.select(F.col("node").alias("was")), "was", "left_anti").select(F.col("was").alias("node"), F.col("now").alias("component"))
    return stage(moved.union(fresh), "cc-joined")
